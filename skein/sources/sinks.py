"""Where telemetry goes: the partitioned event table, the node table, retention."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at
from .links import bloom_options, index_rows, linked

#: Days that raw events, minutes and hours are kept (fixed values).
RETENTION_DAYS = {"events": 7, "stats_1m": 30, "stats_1h": 365}


def append_events(events: DataFrame, path: str, batch: str | int | None = None, spread: int = 32, partitions: tuple[str, ...] = ("event_date", "event_hour")) -> None:
    """Append to the event table: partitioned by date and hour, within a file ordered for the statistics of type and time.

    A batch has a folder of its own, by its number in a stream or a fresh name, and one that is written again replaces itself.
    Events with a body get its typed columns (``links``), the ids among them with bloom filters.  An hour of a batch is up to
    ``spread`` files: 1 for micro-batches, which ``compact`` merges later.
    """
    typed = linked(events) if "data" in events.columns else events
    stamped = typed.withColumns({name: made for name, made in {"event_date": F.to_date("timestamp"), "event_hour": F.hour("timestamp")}.items() if name in partitions})
    dealt = stamped.repartition(*partitions, F.pmod(F.xxhash64("node_id"), F.lit(spread))).sortWithinPartitions(*partitions, "event_type", "timestamp")
    folder = f"{path}/batch={uuid.uuid4().hex if batch is None else batch}"
    dealt.write.mode("overwrite").partitionBy(*partitions).options(compression="zstd", **bloom_options()).parquet(folder)


def append_index(spark: SparkSession, path: str, index: str, batch: str | int) -> None:
    """Append to the index (``links.Lookup``) what a batch of the event table holds; written again, it replaces itself."""
    rows = index_rows(spark.read.parquet(f"{path}/batch={batch}"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{index}/batch={batch}")


def compact(spark: SparkSession, path: str, batches: list[str], into: str) -> None:
    """Write whole batches of the event table as one, and delete them; readers of the table list both for a moment only after the new one is whole.

    The merged folder notes what it replaces, so a run that was cut off while deleting is finished by ``finish_compaction``.
    """
    own = spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches)).drop("batch", "event_date", "event_hour")
    append_events(own, f"{path}/.merge", into)
    spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").text(f"{path}/.merge/replaced={into}")
    finish_compaction(spark, path)


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Take the merged batches that are whole in place of those that they replace."""
    for fs, done in _folders(spark, f"{path}/.merge/replaced=*/_SUCCESS"):
        note = done.getParent()
        into = note.getName().removeprefix("replaced=")
        for row in spark.read.text(note.toString()).collect():  # names of batches
            for other, folder in _folders(spark, f"{path}/batch={row[0]}"):
                other.delete(folder, True)
        for other, folder in _folders(spark, f"{path}/.merge/batch={into}"):
            other.rename(folder, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={into}"))
        fs.delete(note, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names; without it, which only a local master may be, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ingested(events: DataFrame, *names: str, types: tuple[int, ...] = ()) -> DataFrame:
    """Received events as a stored table with the typed columns of their bodies: parsed once, however often a plan reads them.

    With ``names`` only these columns are parsed and stored, of events of ``types`` (none: all), without the bodies: for plans that read
    the table whole, to which order and bloom filters are of no use.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession, "events")
    if names:
        own = events.where(F.col("event_type").isin(*types)) if types else events
        linked(own, *names, types=types).select("timestamp", "node_id", "event_type", *names).write.parquet(path)
    else:
        linked(events).sortWithinPartitions("event_type").write.options(**bloom_options()).parquet(path)
    return spark.read.parquet(path)


def event_sink(events: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """The streaming form: a micro-batch is one commit, whatever its size, and leaves the same rows if it comes again."""
    return events.writeStream.foreachBatch(lambda batch, number: append_events(batch, path, number)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """The node table after a batch of changes (node_id, kind connect|disconnect|count, at, peer_id, events).

    The first connect time and peer id stay; the last connect or disconnect decides the state;
    counts add up.  One aggregation over the union of old rows and changes does it all.
    """
    z = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    old = nodes.select("node_id", F.lit("old").alias("kind"), F.col("last_seen_at").alias("at"), "peer_id", F.col("event_count").alias("events"), "connected_at", "disconnected_at", "is_connected")
    both = old.unionByName(changes, allowMissingColumns=True)
    state = F.max_by(F.coalesce("is_connected", F.col("kind") == "connect"), F.when(F.col("kind").isin("old", "connect", "disconnect"), F.struct("at", F.col("kind") != "old")))
    return both.groupBy("node_id").agg(
        F.coalesce(F.max(z("old", "peer_id")), F.max(z("connect", "peer_id"))).alias("peer_id"),
        F.coalesce(F.max("connected_at"), F.min(z("connect", "at"))).alias("connected_at"),
        F.max(F.greatest(z("disconnect", "at"), F.col("disconnected_at"))).alias("disconnected_at"),
        F.max("at").alias("last_seen_at"),
        F.coalesce(state, F.lit(False)).alias("is_connected"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("event_count"),
    )


def _folders(spark: SparkSession, pattern: str) -> list:
    """(file system, path) of the folders and files that match; none is read."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(fs, found.getPath()) for found in fs.globStatus(glob) or []]


def expired_partitions(spark: SparkSession, path: str, table: str, as_of: datetime) -> list:
    """(file system, folder) of the date partitions that are older than the table's retention."""
    cutoff = str((as_of - timedelta(days=RETENTION_DAYS[table])).date())
    found = [*_folders(spark, f"{path}/event_date=*"), *_folders(spark, f"{path}/batch=*/event_date=*")]
    return [(fs, folder) for fs, folder in found if folder.getName().removeprefix("event_date=") < cutoff]


def drop_expired(spark: SparkSession, path: str, table: str, as_of: datetime) -> int:
    """Delete the expired partitions' folders; returns how many days they are."""
    gone = expired_partitions(spark, path, table, as_of)
    for fs, folder in gone:
        fs.delete(folder, True)
    return len({folder.getName() for _, folder in gone})


def truncate(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """Leave an empty table of the same columns; a table of partitions keeps them."""
    df.limit(0).write.mode("overwrite").partitionBy(*partitions).parquet(path)


class MinuteStats:
    """The one-minute aggregate as a stored table, partitioned by date, that covers all minutes before ``until``."""

    step, time = timedelta(minutes=1), "timestamp"

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def build(events: DataFrame) -> DataFrame:
        from ..plans.rollups import stats_1m

        return stats_1m(events)

    def refresh(self, source: DataFrame, as_of: datetime, start: timedelta = timedelta(hours=1), lag: timedelta = timedelta(minutes=1)) -> None:
        """Compute the days anew that hold buckets from the table's end, less ``start``, to ``as_of`` less ``lag``.

        Whole days are replaced, so a refresh that runs again leaves the same table.
        """
        midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        high = midnight + (as_of - lag - midnight) // self.step * self.step
        until = self.until(source.sparkSession)
        rows = source.where(F.col(self.time) < at(high))
        if until is not None:
            rows = rows.where(F.col(self.time) >= at((until - start).replace(hour=0, minute=0, second=0, microsecond=0)))
        made = self.build(rows).withColumn("event_date", F.to_date("bucket"))
        made.repartition("event_date", F.pmod(F.xxhash64("node_id"), F.lit(8))).sortWithinPartitions("event_date", "event_type", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(self.path)

    def until(self, spark: SparkSession) -> datetime | None:
        """The end of the last stored bucket, from the newest day's partition; None before the first refresh."""
        days = sorted(folder.getName() for _, folder in _folders(spark, f"{self.path}/event_date=*"))
        if not days:
            return None
        newest = spark.read.parquet(f"{self.path}/{days[-1]}").agg(F.max("bucket")).first()[0]
        return newest and newest + self.step

    def read(self, source: DataFrame, since: datetime | None = None) -> DataFrame:
        """The stored buckets, and those since then from the source, so that late refreshes change no result."""
        spark, until = source.sparkSession, self.until(source.sparkSession)
        fresh = max((x for x in (until, since) if x is not None), default=None)
        live = self.build(source if fresh is None else source.where(F.col(self.time) >= at(fresh)))
        if until is None:
            return live
        stored = spark.read.parquet(self.path)
        if since is not None:
            stored = stored.where((F.col("event_date") >= F.lit(since.date())) & (F.col("bucket") >= at(since)))
        return stored.drop("event_date").unionByName(live)


class HourStats(MinuteStats):
    """The same for hours, from the one-minute aggregate; ``refresh`` with the lag of an hour's end."""

    step, time = timedelta(hours=1), "bucket"

    @staticmethod
    def build(minutes: DataFrame) -> DataFrame:
        from ..plans.rollups import stats_1h

        return stats_1h(minutes)
