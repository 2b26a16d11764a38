"""The one-minute and one-hour aggregates, as batch tables and as refreshed windows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at
from .constants import PRESETS
from .registry import query


def stats_1m(events: DataFrame) -> DataFrame:
    """bucket, node_id, event_type, event_count, first_event and last_event per minute."""
    minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz")
    return events.groupBy(minute.alias("bucket"), "node_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"))


def stats_1h(minutes: DataFrame) -> DataFrame:
    """The same per hour, from the one-minute table."""
    hour = F.date_trunc("hour", "bucket").cast("timestamp_ntz")
    return minutes.groupBy(hour.alias("bucket"), "node_id", "event_type").agg(F.sum("event_count").alias("event_count"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))


def refresh(events: DataFrame, materialised: DataFrame, as_of: datetime, start: timedelta, end: timedelta) -> DataFrame:
    """``materialised`` after a refresh of the buckets that lie wholly in [as_of - start, as_of - end):
    those are computed anew, all others stay as they were, late events or not."""
    low, high = _ceil_minute(as_of - start), (as_of - end).replace(second=0, microsecond=0)
    inside = lambda c: (F.col(c) >= at(low)) & (F.col(c) < at(high))
    return materialised.where(~inside("bucket")).unionByName(stats_1m(events.where(inside("timestamp"))))


def _ceil_minute(t: datetime) -> datetime:
    floor = t.replace(second=0, microsecond=0)
    return floor if floor == t else floor + timedelta(minutes=1)


def minute_after(t: datetime) -> datetime:
    """The first minute that starts after a moment."""
    return t.replace(second=0, microsecond=0) + timedelta(minutes=1)


@query("stm1_stats_1m", "SELECT * FROM st")
def all_minutes(t):
    return t.stats_1m


@query(
    "stm2_stats_1h",
    "SELECT date_trunc('hour', bucket) AS bucket, node_id, event_type, CAST(sum(event_count) AS BIGINT) AS event_count, min(first_event) AS first_event, max(last_event) AS last_event FROM st GROUP BY 1, 2, 3",
)
def all_hours(t):
    return stats_1h(t.stats_1m)


@query(
    "stm3_refresh",
    """, b AS (
  SELECT CASE WHEN date_trunc('minute', t - INTERVAL 10 DAY) = t - INTERVAL 10 DAY THEN t - INTERVAL 10 DAY ELSE date_trunc('minute', t - INTERVAL 10 DAY) + INTERVAL 1 MINUTE END AS low,
    date_trunc('minute', t - INTERVAL 2 DAY) AS high FROM a
) SELECT st.* FROM st, b WHERE bucket >= low AND bucket < high""",
)
def first_refresh(t):
    """The first refresh of an empty table, over a window that the sparse test data fill."""
    empty = t.stats_1m.where(F.lit(False))
    return refresh(t.events, empty, t.as_of, timedelta(days=10), timedelta(days=2))


@query(
    "map11_presets",
    """SELECT '5m' AS preset, count(*) FILTER (timestamp > t - INTERVAL 5 MINUTE) AS events, count(*) FILTER (timestamp > t - INTERVAL 1 HOUR) AS longer FROM ev, a
UNION ALL SELECT '15m', count(*) FILTER (timestamp > t - INTERVAL 15 MINUTE), count(*) FILTER (timestamp > t - INTERVAL 3 HOUR) FROM ev, a
UNION ALL SELECT '1h', count(*) FILTER (timestamp > t - INTERVAL 1 HOUR), count(*) FILTER (timestamp > t - INTERVAL 24 HOUR) FROM ev, a
UNION ALL SELECT '6h', count(*) FILTER (timestamp > t - INTERVAL 6 HOUR), count(*) FILTER (timestamp > t - INTERVAL 24 HOUR) FROM ev, a
UNION ALL SELECT '24h', count(*) FILTER (timestamp > t - INTERVAL 24 HOUR), count(*) FILTER (timestamp > t - INTERVAL 24 HOUR) FROM ev, a""",
)
def presets(t):
    """Events in the primary and the secondary window of each preset, from one pass over the longest."""
    longest = max(longer for _, longer in PRESETS.values())
    rows = F.array(*(F.struct(F.lit(name).alias("preset"), F.count_if(t.within(short)).alias("events"), F.count_if(t.within(longer)).alias("longer")) for name, (short, longer) in PRESETS.items()))
    return t.last(longest).agg(rows.alias("rows")).select(F.inline("rows"))


@query("stm9_rate_limit")
def rate_limited(t):
    """Events that pass a budget of two a day, each day opened by the first event after the last one's end."""
    from ..functions.columns import micros
    from ..streaming.stateful import rate_limit

    return rate_limit(t.events.select("node_id", "event_id", micros(F.col("timestamp")).alias("arrival_us")), budget=2, window=86_400_000_000)


def stored(t):
    """The model with its events in a store: three batches, the second of late events and added twice, a refresh after each of the
    first two, so the rollup is read from refreshed, late and pending buckets, and the nodes from a version of their table."""
    from ..sources.sinks import scratch
    from ..sources.stored import EventStore

    spark = t.events.sparkSession
    store = EventStore(scratch(spark, "store"), partitions=("event_date",))  # the test tables have few events an hour
    late, last = F.col("event_id") % 7 == 3, t.as_of - timedelta(days=2)
    batches = [t.events.where(~late & (F.col("timestamp") <= at(last))), t.events.where(late & (F.col("timestamp") <= at(last))), t.events.where(F.col("timestamp") > at(last))]
    for number, batch in enumerate(batches):
        for _ in range(1 + (number == 1)):
            store.add(batch, number)
        if number < 2:
            store.minutes.refresh(store.events(spark), last)
    kept = t.having(events=lambda: store.events(spark), raw=lambda: store.events(spark))
    kept.node_table, kept.minute_table = store.nodes, store.minutes
    return kept


def stored_forms() -> None:
    """The plans that read nodes or minutes, over the stored tables."""
    from . import blocks, network, nodes, timelines
    from .registry import PLANS, SQL

    own = {
        "q01_nodes": nodes.nodes, "q02_recent_events": nodes.recent_events, "q05_health_metrics": network.health_metrics, "q08_network_info": network.network_info, "q10_block_stats": blocks.block_stats,
        "q22_timeseries_throughput": timelines.timeseries_throughput, "q30_failure_rates": network.failure_rates,
    }
    for name, plan in own.items():
        PLANS[f"{name}_stored"] = lambda t, plan=plan: plan(stored(t))
        SQL[f"{name}_stored"] = SQL[name]


@query("stm4_changed_minutes", "SELECT * FROM st")
def changed_minutes(t):
    """The one-minute rollup as the store keeps it, late and pending buckets included."""
    kept = stored(t)
    return kept.minute_table.read(kept.events)
