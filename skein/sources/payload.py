"""Received events as the telemetry model: columns from the paths of their JSON bodies, and packages by what links their events.

A body is an object with one key, the name of its variant, so a field that several variants have is the
first of its paths that is there.  A work package is named by its hash, which one event alone tells; the
others name it by share or submission id, by the hash of its report, by the erasure root of its bundle or by
the request that asked for a shard.  Each of these is a hash join on the id; ids are matched as they are,
so they must be unique among the nodes of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hex_to_bytes, one_of
from .adapter import Telemetry
from .links import linked
from .sinks import ingested

#: event types of the pipeline
PACKAGE_TYPES = (92, 93, 94, 95, 96, 97, 98, 99, 100, 101, 102, 105, 109)
CHAIN_TYPES, TRANSFER_TYPES = (112, 113), (120, 124, 125)
#: what the pipeline's events name
PACKAGE_COLUMNS = ("share", "hash", "report", "root", "core", "gas", "gas_limit", "reason")


def body_where(events: DataFrame, types) -> DataFrame:
    """Events of some types with their body parsed; other rows are left out before that."""
    return events.where(one_of("event_type", types)).withColumn("body", F.try_parse_json("data"))


def packages_of(events: DataFrame) -> DataFrame:
    """The pipeline's events with what each names: share (id), hash, report, root, core, gas, gas_limit and reason."""
    own = linked(events.where(one_of("event_type", PACKAGE_TYPES)), *PACKAGE_COLUMNS, types=PACKAGE_TYPES)
    return own.select("timestamp", "node_id", "event_type", *PACKAGE_COLUMNS)


def parsed(events: DataFrame) -> DataFrame:
    """What ``telemetry`` reads of received ``events``, parsed once and stored: their links, without the bodies."""
    return ingested(events, *PACKAGE_COLUMNS, "request", types=PACKAGE_TYPES + CHAIN_TYPES + TRANSFER_TYPES)


def telemetry(events: DataFrame, model: Telemetry | None = None, hashes: list[str] | None = None) -> Telemetry:
    """The packages, chain and shards of received ``events`` (timestamp, node_id, event_type, data), keyed by package hash in hex.

    What other plans read (events, dimensions, services) is taken from ``model``.  With ``hashes`` only packages
    of those are told; their ids, a row for each hash and node that received it, are broadcast to the events.
    """
    own = packages_of(events)
    names = own.where("hash IS NOT NULL AND share IS NOT NULL").select("share", F.col("hash").alias("package")).distinct()
    few = F.broadcast if hashes is not None else lambda df: df
    if hashes is not None:
        names = names.where(F.col("package").isin(*hashes))
    named = own.join(few(names), "share")
    received = F.when(F.col("event_type") == 94, F.col("timestamp"))
    packages = named.select("package", "node_id", "event_type", "timestamp", "core", "gas", "gas_limit", received.alias("submitted"), "reason", F.lit(None).cast("bigint").alias("part"))
    reports = named.where("event_type = 102")
    by_report = reports.where("report IS NOT NULL").select("package", "report").distinct()
    by_root = reports.where("root IS NOT NULL").select("package", "root").distinct()
    told = linked(events.where(one_of("event_type", CHAIN_TYPES)), "report", "reason", types=CHAIN_TYPES).select("timestamp", "node_id", "event_type", "report", "reason")
    chain = told.join(few(by_report), "report").select("package", "event_type", "reason", "timestamp")
    moved = linked(events.where(one_of("event_type", TRANSFER_TYPES)), "root", "request", types=TRANSFER_TYPES).select("timestamp", "node_id", "event_type", "root", "request")
    asked = moved.where("event_type <> 125").join(few(by_root), "root").select("package", "node_id", "event_type", "timestamp", "request")
    requests = asked.where("request IS NOT NULL").select("package", "request").distinct()
    sent = moved.where("event_type = 125").join(few(requests), "request").select("package", "node_id", "event_type", "timestamp")
    shards = asked.drop("request").unionByName(sent)
    audits = packages.where(F.col("event_type").between(105, 113)).select("package", "node_id", "event_type", "timestamp", F.lit(None).cast("int").alias("tranche"))
    audits = audits.unionByName(told.join(by_report, "report").select("package", "node_id", "event_type", "timestamp", F.lit(None).cast("int").alias("tranche")))
    tables = {"packages": packages, "chain": chain, "shards": shards, "audits": audits, "payloads": events, "typed_packages": lambda: packages_of(events)}
    return model.having(**tables) if model else Telemetry(events=events, bodies=events, **tables)


def with_hash(events: DataFrame, hashes: list[str]) -> DataFrame:
    """Received packages with one of the hashes, which are compared as the arrays of bytes they are in the bodies."""
    found = F.try_variant_get("body", "$.WorkPackageReceived.outline.work_package_hash", "array<int>")
    wanted = [hex_to_bytes(F.lit(h)) for h in hashes]
    return body_where(events, (94,)).where(found.isin(*wanted)).drop("body")


def accumulate_costs(events: DataFrame) -> DataFrame:
    """A row for each pair of a service and its cost in the bodies of executed blocks: timestamp, node_id, service, gas, elapsed_ns."""
    pairs = F.try_variant_get("body", "$.BlockExecuted.accumulate_costs", "array<variant>")
    rows = body_where(events, (47,)).select("timestamp", "node_id", F.explode(pairs).alias("pair"))
    return rows.select(
        "timestamp",
        "node_id",
        F.try_variant_get("pair", "$[0]", "bigint").alias("service"),
        F.try_variant_get("pair", "$[1].total.gas_used", "bigint").alias("gas"),
        F.try_variant_get("pair", "$[1].total.elapsed_ns", "bigint").alias("elapsed_ns"),
    )
