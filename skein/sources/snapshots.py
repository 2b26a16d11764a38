"""Snapshots that a node's RPC gives, a JSON document each: parameters, services and the samples of cores by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITY = "provided_count long, provided_size long, refinement_count long, refinement_gas_used long, imports long, extrinsic_count long, extrinsic_size long, exports long, accumulate_count long, accumulate_gas_used long"
CORE = "gas_used long, da_load long, popularity int, imports int, extrinsic_count int, extrinsic_size long"


def _struct(columns: str) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in columns.split(", "))) + ">"


SNAPSHOT = f"source string, arrival long, slot long, cores array<{_struct(CORE)}>, services array<struct<id: long, balance: long, min_item_gas: long, min_memo_gas: long, items: long, bytes: long, creation_slot: long, activity: {_struct(ACTIVITY)}>>"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON document a line; fields that a document lacks are null, and a line that is none gives nothing (``malformed`` counts those)."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """file and lines: how many lines of each file are no document; files without any are not told."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    bad = lines.where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def stream_snapshots(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def core_samples(snapshots: DataFrame) -> DataFrame:
    """A row for each core of a snapshot: slot, core_index and what the core did."""
    return snapshots.select("source", "arrival", "slot", F.posexplode("cores").alias("core_index", "c")).select("source", "arrival", "slot", "core_index", "c.*")


def services(snapshots: DataFrame) -> DataFrame:
    """Every service as the newest snapshot that names it tells."""
    rows = snapshots.select("slot", "arrival", F.explode("services").alias("s"))
    newest = rows.groupBy("s.id").agg(F.max_by("s", F.struct("slot", "arrival")).alias("s"))
    return newest.select("s.*")


def services_totals(services: DataFrame) -> DataFrame:
    """Totals over services (id, balance, items, bytes, activity), and how many did anything."""
    a = lambda name: F.coalesce(F.sum(f"activity.{name}"), F.lit(0)).cast("long").alias(f"total_{name}")
    busy = (F.coalesce("activity.refinement_count", F.lit(0)) > 0) | (F.coalesce("activity.accumulate_count", F.lit(0)) > 0)
    names = [c.split(" ")[0] for c in ACTIVITY.split(", ")]
    return services.agg(F.count(F.lit(1)).alias("services"), F.count_if(busy).alias("active_services"), F.coalesce(F.sum("balance"), F.lit(0)).cast("long").alias("total_balance"), *map(a, names))
