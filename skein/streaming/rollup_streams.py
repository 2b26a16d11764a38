"""The rollups and live views as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats_1m_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """One-minute counts by node and type.  Events later than the watermark still reach the raw sink, but not this table."""
    by = events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", "1 minute"), "node_id", "event_type")
    counted = by.agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"))
    return counted.select("window", F.col("window.start").alias("bucket"), "node_id", "event_type", "event_count", "first_event", "last_event")


def stats_1h_stream(minutes: DataFrame) -> DataFrame:
    """One-hour sums chained on the one-minute stream (append mode)."""
    by = minutes.groupBy(F.window(F.window_time("window"), "1 hour"), "node_id", "event_type")
    summed = by.agg(F.sum("event_count").alias("event_count"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))
    return summed.select(F.col("window.start").alias("bucket"), "node_id", "event_type", "event_count", "first_event", "last_event")


def per_second_stream(events: DataFrame, lateness: str = "30 seconds") -> DataFrame:
    by = events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", "1 second"))
    return by.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == 42).alias("blocks")).select(F.col("window.start").alias("second"), "events", "blocks")


def filtered(events: DataFrame, node_id: str | None = None, event_type: int | None = None, type_range: tuple[int, int] | None = None) -> DataFrame:
    """A subscriber's filter: all events, those of a node, of a type, or of a range of types."""
    out = events
    if node_id is not None:
        out = out.where(F.col("node_id") == node_id)
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if type_range is not None:
        out = out.where(F.col("event_type").between(*type_range))
    return out


def changed_slots(samples: DataFrame) -> DataFrame:
    """Of consecutive samples (source, slot, arrival) of a source only those whose slot differs from the one before: not a global distinct."""
    before = F.lag("slot").over(Window.partitionBy("source").orderBy("arrival", "slot"))
    return samples.withColumn("_before", before).where("_before IS NULL OR slot <> _before").drop("_before")


def changed_slots_stream(samples: DataFrame) -> DataFrame:
    """The same on a stream: the state of a source is its last slot."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(frames).sort_values(["arrival", "slot"])
        last = state.get[0] if state.exists else None
        changed = pdf["slot"] != pdf["slot"].shift(1)
        if len(pdf):
            changed.iloc[0] = last is None or pdf["slot"].iloc[0] != last
            state.update((int(pdf["slot"].iloc[-1]),))
        yield pdf[changed]

    columns = "source string, slot long, arrival long"
    return samples.select("source", "slot", "arrival").groupBy("source").applyInPandasWithState(run, columns, "slot long", "append", "NoTimeout")


#: Event types of a bucket of the subscribers' index; subscribers that are looked up by a broadcast.
TYPES_A_BUCKET, MOST_SUBSCRIBERS = 16, 10_000


def subscriber_index(subscribers: DataFrame) -> DataFrame:
    """A row for each key under which a subscriber's events come: all, their node, their buckets of types, or both."""
    low, high = F.coalesce("low", F.lit(0)), F.coalesce("high", F.lit(255))
    bucket = lambda c: F.floor(c / TYPES_A_BUCKET)
    typed = F.col("low").isNotNull() | F.col("high").isNotNull()
    buckets = F.when(typed & (low <= high), F.sequence(bucket(low), bucket(high))).when(typed, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(-1).cast("bigint")))
    rows = subscribers.withColumn("_bucket", F.explode(buckets))
    return rows.select("subscriber", low.alias("low"), high.alias("high"), F.coalesce("node_id", F.lit("")).alias("_node"), "_bucket")


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """A row for each event and subscriber (subscriber, node_id, low, high) whose filter it passes; a null criterion takes all.

    An event looks under its four keys (any node or its own, any type or its bucket), so subscribers are met by equality of
    keys; a bucket's bounds are checked then.  The index is broadcast if the subscribers counted are few.
    """
    index = subscriber_index(subscribers)
    if subscribers.limit(MOST_SUBSCRIBERS + 1).count() <= MOST_SUBSCRIBERS:
        index = F.broadcast(index)  # that many rows for each of 16 buckets at most
    keys = F.array(*(F.struct(n.alias("_node"), b.cast("bigint").alias("_bucket")) for n in (F.lit(""), F.col("node_id")) for b in (F.lit(-1), F.floor(F.col("event_type") / TYPES_A_BUCKET))))
    spread = events.withColumn("_key", F.explode(keys)).select("*", "_key._node", "_key._bucket").drop("_key")
    inside = (F.col("_bucket") == -1) | F.col("event_type").between(F.col("low"), F.col("high"))
    return spread.join(index, ["_node", "_bucket"]).where(inside).drop("_node", "_bucket", "low", "high")
