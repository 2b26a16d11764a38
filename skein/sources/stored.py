"""Tables that a stream keeps up to date: nodes by version, and rollups by the buckets that changed.

Both commit by a note whose name is a number: it is written aside and renamed, which succeeds once, so a reader that takes the
highest note sees a whole version, and a batch that comes again finds its number in the note and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import at
from .sinks import RETENTION_DAYS, _folders, append_events


class Notes:
    """Numbered notes in a folder, of which the highest holds."""

    def __init__(self, path: str):
        self.path = path

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder

    def last(self, spark: SparkSession) -> dict | None:
        found = max((int(p.getName().removeprefix("note-")) for _, p in _folders(spark, f"{self.path}/note-*")), default=None)
        if found is None:
            return None
        return json.loads("\n".join(r[0] for r in spark.read.text(f"{self.path}/note-{found}").collect())) | {"number": found}

    def commit(self, spark: SparkSession, number: int, told: dict) -> None:
        """Write note ``number``; raises if another writer was first."""
        jvm, fs, folder = self._fs(spark)
        aside = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(folder, f"note-{number}")
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError(f"version {number} of {self.path} was written by another")


def _delete(spark: SparkSession, pattern: str) -> None:
    for fs, folder in _folders(spark, pattern):
        fs.delete(folder, True)


class NodeTable:
    """Nodes as a fold of batches of events; a version is a folder, and the one before stays for those who read it."""

    def __init__(self, path: str):
        self.path, self.notes = path, Notes(f"{path}/notes")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version: node_id, user_id, connected_at, disconnected_at, last_seen, total_events."""
        note = self.notes.last(spark)
        if note is None:
            raise ValueError(f"{self.path} holds no version yet")
        return spark.read.parquet(f"{self.path}/{note['folder']}")

    def update(self, events: DataFrame, batch: int) -> bool:
        """Merge a batch once; returns whether it was new.  One aggregation over the old rows and the batch's fold."""
        from ..plans.nodes import fold

        spark = events.sparkSession
        note = self.notes.last(spark)
        if note and batch <= note["batch"]:
            return False
        both = fold(events)
        if note:
            both = spark.read.parquet(f"{self.path}/{note['folder']}").unionByName(both)
        merged = both.groupBy("node_id").agg(
            F.min("user_id").alias("user_id"), F.max("connected_at").alias("connected_at"), F.max("disconnected_at").alias("disconnected_at"), F.max("last_seen").alias("last_seen"), F.sum("total_events").alias("total_events")
        )
        number = note["number"] + 1 if note else 0
        folder = f"version-{number}-{uuid.uuid4().hex[:8]}"
        merged.write.parquet(f"{self.path}/{folder}")
        self.notes.commit(spark, number, {"folder": folder, "batch": batch})
        _delete(spark, f"{self.path}/version-{number - 2}-*")
        return True


class ChangedBuckets:
    """A rollup of which only changed buckets are computed anew.

    The sink notes the buckets that a batch touches (``touched``).  A refresh computes those that the policy lets it, into a folder
    of its own, and the state says for each bucket which refresh holds it; a touched bucket that no refresh has computed
    since is pending.  A reader takes the state's rows, and pending buckets from the source, so its result is always that of
    the source.  The state has a row a bucket, ``RETENTION_DAYS`` of minutes (43,200) or hours at most, and is broadcast.
    """

    def __init__(self, path: str, build: Callable[[DataFrame], DataFrame], time: str = "timestamp", step: str = "minute"):
        self.path, self.build, self.time, self.step = path, build, time, step
        self.notes = Notes(f"{path}/notes")

    @classmethod
    def minutes(cls, path: str) -> ChangedBuckets:
        from ..plans.rollups import stats_1m

        return cls(path, stats_1m)

    @classmethod
    def hours(cls, path: str) -> ChangedBuckets:
        """From the rows of the one-minute rollup."""
        from ..plans.rollups import stats_1h

        return cls(path, stats_1h, "bucket", "hour")

    def _bucket(self):
        return F.date_trunc(self.step, self.time).cast("timestamp_ntz").alias("bucket")

    def touched(self, rows: DataFrame, batch: int) -> None:
        """Note a batch's buckets; written again, the note replaces itself."""
        rows.select(self._bucket()).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/touched/batch={batch}")

    def _pending(self, spark: SparkSession, note: dict | None) -> DataFrame:
        """Buckets to be computed: those pending in the state, and those that batches since then touched."""
        new = [b for b in self._batches(spark) if note is None or b > note["batch"]]
        out = spark.createDataFrame([], "bucket timestamp_ntz")
        if note:
            out = out.unionByName(self._state(spark, note).where("refresh IS NULL").select("bucket"))
        if new:
            out = out.unionByName(spark.read.parquet(*(f"{self.path}/touched/batch={b}" for b in new)).select("bucket"))
        return out.distinct()

    def _batches(self, spark: SparkSession) -> list[int]:
        done = [p.getParent().getName() for _, p in _folders(spark, f"{self.path}/touched/batch=*/_SUCCESS")]
        return sorted(int(name.removeprefix("batch=")) for name in done)

    def _state(self, spark: SparkSession, note: dict) -> DataFrame:
        return spark.read.schema("bucket timestamp_ntz, refresh int").parquet(f"{self.path}/state-{note['number']}")

    def _computed(self, source: DataFrame, buckets: DataFrame) -> DataFrame:
        """The rollup of some buckets; their bounds reach the source's scan."""
        low, high = buckets.agg(F.min("bucket"), F.max("bucket")).first()
        if low is None:
            return self.build(source.where("false"))
        end = high + (timedelta(minutes=1) if self.step == "minute" else timedelta(hours=1))
        rows = source.where((F.col(self.time) >= at(low)) & (F.col(self.time) < at(end)))
        if "event_date" in source.columns:  # a stored table's partitions
            rows = rows.where(F.col("event_date").between(F.lit(low.date()), F.lit(end.date())))
        return self.build(rows.join(F.broadcast(buckets.withColumnRenamed("bucket", "_bucket")), F.date_trunc(self.step, self.time).cast("timestamp_ntz") == F.col("_bucket"), "left_semi"))

    def refresh(self, source: DataFrame, as_of: datetime, lag: timedelta = timedelta(minutes=1), start: timedelta | None = None) -> int:
        """Compute pending buckets that ended ``lag`` before ``as_of`` and, where ``start`` is given, began within it; returns how many.

        Later and earlier ones stay pending.
        """
        spark = source.sparkSession
        note = self.notes.last(spark)
        number = note["number"] + 1 if note else 0
        step = timedelta(minutes=1) if self.step == "minute" else timedelta(hours=1)
        due = F.col("bucket") <= at(as_of - lag - step)
        if start is not None:
            due &= F.col("bucket") >= at(as_of - start)
        pending = self._pending(spark, note)
        old = self._state(spark, note) if note else spark.createDataFrame([], "bucket timestamp_ntz, refresh int")
        state = old.join(pending, "bucket", "left_anti").unionByName(pending.select("bucket", F.when(due, F.lit(number)).cast("int").alias("refresh")))
        kept = as_of - timedelta(days=RETENTION_DAYS["stats_1m" if self.step == "minute" else "stats_1h"])
        state = state.where(F.col("bucket") >= at(kept))
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state-{number}")
        mine = spark.read.schema("bucket timestamp_ntz, refresh int").parquet(f"{self.path}/state-{number}").where(F.col("refresh") == number).select("bucket")
        made = self._computed(source, mine).withColumn("event_date", F.to_date("bucket"))
        made.repartition("event_date").sortWithinPartitions("event_type", "bucket").write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/data/refresh={number}")
        self.notes.commit(spark, number, {"batch": max(self._batches(spark), default=-1)})
        _delete(spark, f"{self.path}/state-{number - 2}")
        return mine.count()

    def read(self, source: DataFrame, since: datetime | None = None) -> DataFrame:
        """The rollup of ``source`` from ``since`` on: stored buckets, and pending ones from the source."""
        spark = source.sparkSession
        after = (lambda df: df) if since is None else (lambda df: df.where(F.col("bucket") >= at(since)))
        note = self.notes.last(spark)
        pending = after(self._pending(spark, note))
        live = self._computed(source, pending)
        if note is None:
            return live
        valid = after(self._state(spark, note)).where("refresh IS NOT NULL").join(F.broadcast(pending), "bucket", "left_anti")
        stored = after(spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data"))
        if since is not None:
            stored = stored.where(F.col("event_date") >= F.lit(since.date()))
        own = stored.join(F.broadcast(valid), ["bucket", "refresh"], "left_semi").drop("refresh", "event_date")
        return own.select(live.columns).unionByName(live)

    def compact(self, spark: SparkSession) -> None:
        """Write the valid rows of all refreshes as one refresh, and drop the others' folders."""
        note = self.notes.last(spark)
        number = note["number"] + 1
        state = self._state(spark, note)
        stored = spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        rows = stored.join(F.broadcast(state.where("refresh IS NOT NULL")), ["bucket", "refresh"], "left_semi").drop("refresh")
        rows.repartition("event_date").sortWithinPartitions("event_type", "bucket").write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/data/refresh={number}")
        state.select("bucket", F.when(F.col("refresh").isNotNull(), F.lit(number)).cast("int").alias("refresh")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state-{number}")
        self.notes.commit(spark, number, {"batch": note["batch"]})
        for fs, folder in _folders(spark, f"{self.path}/data/refresh=*"):
            if folder.getName() != f"refresh={number}":
                fs.delete(folder, True)


#: Parts of a batch that are numbered on their own.
PARTS = 32


def arrival_numbers(batch: DataFrame, start: int) -> tuple[DataFrame, int]:
    """``batch`` with ``arrival``, gapless from ``start`` on, and the number behind the last; the same rows get the same numbers again.

    Parts by hash are counted and then numbered each for itself, so no task sorts the batch.
    """
    rows = batch.withColumn("_part", F.pmod(F.xxhash64("node_id", "event_id"), F.lit(PARTS)).cast("int"))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``PARTS`` rows
    before, following = {}, start
    for part in range(PARTS):
        before[part], following = following, following + counts.get(part, 0)
    offset = F.get(F.array(*(F.lit(before[part]).cast("bigint") for part in range(PARTS))), F.col("_part"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("timestamp", "node_id", "event_id", "event_type"))
    return rows.withColumn("arrival", offset + own - 1).drop("_part"), following


class EventStore:
    """Events with their arrival numbers, nodes and the one-minute rollup in a folder, each batch in all of them once."""

    def __init__(self, path: str, partitions: tuple[str, ...] = ("event_date", "event_hour")):
        self.path, self.partitions, self.nodes, self.minutes = path, partitions, NodeTable(f"{path}/nodes"), ChangedBuckets.minutes(f"{path}/minutes")
        self.arrivals = Notes(f"{path}/arrivals")

    def _numbered(self, batch: DataFrame, number: int) -> DataFrame:
        """The batch with arrival numbers behind those of the batches before; one that comes again begins where it did."""
        spark = batch.sparkSession
        note = self.arrivals.last(spark)
        again = note is not None and note["batch"] == number
        rows, following = arrival_numbers(batch, note["start" if again else "next"] if note else 0)
        if not again:
            self.arrivals.commit(spark, note["number"] + 1 if note else 0, {"batch": number, "start": note["next"] if note else 0, "next": following})
        return rows

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: a batch that comes again leaves the same tables."""
        append_events(self._numbered(batch, number), f"{self.path}/events", number, spread=1, partitions=self.partitions)
        folder = f"{self.path}/events/batch={number}"
        rows = batch.sparkSession.read.parquet(folder) if _folders(batch.sparkSession, f"{folder}/*=*") else batch  # as written, unless it was empty
        self.minutes.touched(rows, number)
        self.nodes.update(rows, number)

    def sink(self, events: DataFrame, checkpoint: str, every: str = "1 second"):
        return events.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(processingTime=every)

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/events").drop("batch")
