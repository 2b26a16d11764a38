"""Operators with state of their own: the rate limiter, the ring buffer, alerts on change; all of it survives a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import _folders

#: Events a second of a node, and what it may burst beyond them (fixed values).
RATE, BURST = 1000, 200
WINDOW_MICROS = 1_000_000


def admitted(micros, budget: int, window: int, start: int | None = None, used: int = 0) -> tuple[list[bool], int | None, int]:
    """Which events pass, in order of arrival, and the window's start and use after them.

    A window opens with the first event at or after the end of the one before.
    """
    out = []
    for t in micros:
        if start is None or t - start >= window:
            start, used = t, 0
        out.append(used < budget)
        used += out[-1]
    return out, start, used


def rate_limit(events: DataFrame, budget: int = RATE + BURST, window: int = WINDOW_MICROS) -> DataFrame:
    """The events that pass (node_id, event_id, arrival_us): a fold over each node's events in order.

    Rows stream through the task, so its memory does not grow with a node's events.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, start, used = None, None, 0
        for pdf in batches:
            keep = []
            for name, part in pdf.groupby("node_id", sort=False):
                if name != node:
                    node, start, used = name, None, 0
                passed, start, used = admitted(part["arrival_us"].tolist(), budget, window, start, used)
                keep += passed
            yield pdf[keep]

    ordered = events.select("node_id", "event_id", "arrival_us").repartition("node_id").sortWithinPartitions("node_id", "arrival_us", "event_id")
    return ordered.mapInPandas(run, "node_id string, event_id long, arrival_us long")


def rate_limit_stream(events: DataFrame, budget: int = RATE + BURST, window: int = WINDOW_MICROS) -> DataFrame:
    """The same on a stream: the state of a node is its window's start and use."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        start = None if start == -1 else start
        pdf = pd.concat(frames).sort_values(["arrival_us", "event_id"])
        passed, start, used = admitted(pdf["arrival_us"].tolist(), budget, window, start, used)
        state.update((-1 if start is None else start, used))
        yield pdf[passed][["node_id", "event_id", "arrival_us"]]

    by = events.select("node_id", "event_id", "arrival_us").groupBy("node_id")
    return by.applyInPandasWithState(run, "node_id string, event_id long, arrival_us long", "start long, used int", "append", "NoTimeout")


class RingBuffer:
    """The newest events by arrival number, kept across micro-batches and restarts as a table in a folder.

    A turn is a folder named by its batch; the newest whole one holds the buffer, and a turn deletes those
    before the one it read, so a batch that comes again finds what it needs and writes the same rows.
    """

    def __init__(self, path: str, size: int = 10_000):
        self.path, self.size = path, size

    def turns(self, spark: SparkSession) -> list[int]:
        """The batches whose folders are whole."""
        done = [folder.getParent().getName() for _, folder in _folders(spark, f"{self.path}/batch-*/_SUCCESS")]
        return sorted(int(name.removeprefix("batch-")) for name in done)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        before = [turn for turn in self.turns(spark) if turn < batch_id]
        held = batch.unionByName(spark.read.parquet(f"{self.path}/batch-{before[-1]}"), allowMissingColumns=True) if before else batch
        held.orderBy(F.desc("event_id")).limit(self.size).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        for turn in before[:-1]:
            for fs, folder in _folders(spark, f"{self.path}/batch-{turn}"):
                fs.delete(folder, True)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batch-{self.turns(spark)[-1]}")


class OnChange:
    """Calls ``send`` with an alert table's rows when the table differs from that sent last, of which a folder keeps the digest over restarts.

    The digest covers every row: their number and the sum of their hashes.  ``MOST`` rows, in order, are sent.
    """

    MOST = 1000

    def __init__(self, alerts, send, path: str):
        self.alerts, self.send, self.path = alerts, send, path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: the rows are sent before they are noted, so none is lost; a batch that comes again may send them twice."""
        spark, alerts = batch.sparkSession, self.alerts(batch)
        text = " ".join(map(str, alerts.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*alerts.columns).cast("decimal(38,0)"))).first()))
        kept = spark.read.text(self.path, wholetext=True).collect() if _folders(spark, f"{self.path}/_SUCCESS") else []  # one line
        if not kept or kept[0][0].rstrip("\n") != text:
            self.send(sorted(map(tuple, alerts.orderBy(*alerts.columns).limit(self.MOST).collect()), key=repr))
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
