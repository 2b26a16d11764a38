"""Series over time: live counters, gap-filled grids, grouped series, sync and connections."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, floor_minutes, micros, one_of, ratio, time_bucket
from ..operators.joins import time_grid
from .constants import FAILURES_ANALYTICS, FAILURES_ANOMALY, SERIES_CATEGORIES
from .registry import query

DAY, WEEK = 1440, 7 * 1440


def _kind(*ids):
    return one_of("event_type", ids)


@query(
    "q20_per_second",
    """SELECT date_trunc('second', timestamp) AS second, count(*) AS events, count(*) FILTER (event_type = 42) AS blocks, count(DISTINCT node_id) AS nodes FROM ev, a WHERE timestamp > t - INTERVAL 1 DAY GROUP BY 1""",
)
def per_second(t, seconds: int = 86_400):
    second = F.date_trunc("second", "timestamp").cast("timestamp_ntz")
    return t.last(seconds / 60).groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("events"), count_if(_kind(42)).alias("blocks"), F.count_distinct("node_id").alias("nodes"))


@query(
    "q20_realtime_metrics",
    """SELECT count(*) AS events, count(*) FILTER (event_type = 42) AS blocks, count(*) FILTER (event_type = 12) AS finalized, count(DISTINCT node_id) AS active_nodes, round(count(*) / 86400.0, 6) AS events_per_second FROM ev, a WHERE timestamp > t - INTERVAL 1 DAY""",
)
def realtime_metrics(t, seconds: int = 86_400):
    return t.last(seconds / 60).agg(
        F.count(F.lit(1)).alias("events"),
        count_if(_kind(42)).alias("blocks"),
        count_if(_kind(12)).alias("finalized"),
        F.count_distinct("node_id").alias("active_nodes"),
        F.round(F.count(F.lit(1)) / float(seconds), 6).alias("events_per_second"),
    )


@query(
    "q21_live_counters",
    """, s AS (SELECT max(slot) FILTER (event_type = 11) AS best_slot, max(slot) FILTER (event_type = 12) AS finalized_slot, count(*) FILTER (event_type = 94) AS packages FROM ev, a WHERE timestamp > t - INTERVAL 6 HOUR),
l AS (SELECT coalesce(CAST(sum(event_count) AS BIGINT), 0) AS events, count(DISTINCT node_id) AS nodes FROM st, a WHERE bucket > t - INTERVAL 1 DAY) SELECT * FROM s, l""",
)
def live_counters(t, short: int = 360, long: int = DAY):
    """A short window on the events beside a long one on the aggregate."""
    top = lambda i: F.max(F.when(_kind(i), F.col("slot")))
    now = t.last(short).agg(top(11).alias("best_slot"), top(12).alias("finalized_slot"), count_if(_kind(94)).alias("packages"))
    longer = t.stats(long).agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), F.count_distinct("node_id").alias("nodes"))
    return now.crossJoin(F.broadcast(longer))  # one row each


_GRID = """, g AS (SELECT unnest(generate_series(date_trunc('hour', t - INTERVAL 1 DAY), date_trunc('hour', t), INTERVAL 60 MINUTE)) AS bucket FROM a)"""


def _grid(t, hours: int, minutes: int):
    """Every bucket from that of as_of - hours to that of as_of."""
    floor = lambda m: m.replace(minute=m.minute // minutes * minutes if minutes < 60 else 0, second=0, microsecond=0)
    return time_grid(t.events.sparkSession, floor(t.as_of - timedelta(hours=hours)), floor(t.as_of), minutes)


def _series(t, hours: int, minutes: int, **counts):
    if not (1 <= minutes <= 60 and 60 % minutes == 0 and 1 <= hours <= 24):
        raise ValueError("minutes must divide 60, hours must be in 1..24")
    total = lambda cond: F.sum(F.when(cond, F.col("event_count"))) if cond is not None else F.sum("event_count")
    recent = t.stats((hours + 1) * 60)
    sums = recent.groupBy(time_bucket(F.col("bucket"), minutes * 60).alias("bucket")).agg(*(total(c).alias(n) for n, c in counts.items()))
    filled = _grid(t, hours, minutes).join(sums, "bucket", "left")
    return filled.select("bucket", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts)).orderBy(F.desc("bucket")).limit(500)


def _series_sql(**counts) -> str:
    parts = ", ".join(f"sum(event_count){f' FILTER ({c})' if c else ''} AS {n}" for n, c in counts.items())
    return _GRID + f", h AS (SELECT date_trunc('hour', bucket) AS bucket, {parts} FROM st GROUP BY 1) SELECT bucket, " + ", ".join(f"coalesce(CAST({n} AS BIGINT), 0) AS {n}" for n in counts)


@query("q22_timeseries_events", _series_sql(events="") + ", round(coalesce(CAST(events AS DOUBLE), 0) / 3600, 8) AS events_per_second FROM g LEFT JOIN h USING (bucket)")
def timeseries_events(t, hours: int = 24, minutes: int = 60):
    return _series(t, hours, minutes, events=None).withColumn("events_per_second", F.round(F.col("events") / (60.0 * minutes), 8))


@query("q22_timeseries_blocks", _series_sql(best="event_type = 11", finalized="event_type = 12", authored="event_type = 42") + " FROM g LEFT JOIN h USING (bucket)")
def timeseries_blocks(t, hours: int = 24, minutes: int = 60):
    return _series(t, hours, minutes, best=_kind(11), finalized=_kind(12), authored=_kind(42))


@query("q22_timeseries_throughput", _series_sql(blocks="event_type IN (11, 12, 42, 62)", packages="event_type BETWEEN 90 AND 113", guarantees="event_type BETWEEN 105 AND 113") + " FROM g LEFT JOIN h USING (bucket)")
def timeseries_throughput(t, hours: int = 24, minutes: int = 60):
    return _series(t, hours, minutes, blocks=_kind(11, 12, 42, 62), packages=F.col("event_type").between(90, 113), guarantees=F.col("event_type").between(105, 113))


_BUCKET = "date_trunc('minute', timestamp) - INTERVAL 1 MINUTE * (extract(minute FROM timestamp) % 15)"


def _grouped(t, key, minutes: int, window: int, distinct=None):
    bucket = floor_minutes(F.col("timestamp"), minutes).alias("bucket")
    aggs = [F.count(F.lit(1)).alias("events")]
    if distinct is not None:
        aggs.append(F.count_distinct(distinct).alias("distinct_keys"))
    return t.last(window).groupBy(bucket, key).agg(*aggs).orderBy(F.desc("bucket"), F.desc("events"), key).limit(1000)


@query("q33_events_by_node", f"SELECT {_BUCKET} AS bucket, node_id, count(*) AS events, count(DISTINCT event_type) AS distinct_keys FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY GROUP BY 1, 2 ORDER BY bucket DESC, events DESC, node_id LIMIT 1000")
def events_by_node(t, minutes: int = 15, window: int = WEEK):
    return _grouped(t, "node_id", minutes, window, "event_type")


@query("q34_events_by_type", f"SELECT {_BUCKET} AS bucket, event_type, count(*) AS events, count(DISTINCT node_id) AS distinct_keys FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY GROUP BY 1, 2 ORDER BY bucket DESC, events DESC, event_type LIMIT 1000")
def events_by_type(t, minutes: int = 15, window: int = WEEK):
    return _grouped(t, "event_type", minutes, window, "node_id")


@query("q35_guarantees_by_core", f"SELECT {_BUCKET} AS bucket, core, count(*) AS guarantees, count(DISTINCT node_id) AS guarantors FROM ev, a WHERE event_type = 105 AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2 ORDER BY bucket DESC, guarantees DESC, core LIMIT 1000")
def guarantees_by_core(t, minutes: int = 15, window: int = 30 * DAY):
    own = t.last(window).where(_kind(105)).groupBy(floor_minutes(F.col("timestamp"), minutes).alias("bucket"), "core")
    return own.agg(F.count(F.lit(1)).alias("guarantees"), F.count_distinct("node_id").alias("guarantors")).orderBy(F.desc("bucket"), F.desc("guarantees"), "core").limit(1000)


def failure_category(event_type):
    out = F.lit("other")
    for name, ids in SERIES_CATEGORIES.items():
        out = F.when(event_type.isin(*ids), name).otherwise(out)
    return out


@query(
    "q36_failures_by_category",
    f"SELECT {_BUCKET} AS bucket, CASE WHEN event_type IN (41, 44, 46) THEN 'block_authoring' WHEN event_type = 81 THEN 'ticket_generation' ELSE 'work_package' END AS category, count(*) AS failures, count(DISTINCT node_id) AS nodes FROM ev, a WHERE event_type IN (41, 44, 46, 81, 94, 97, 99, 102, 109, 110, 112, 113) AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2 ORDER BY bucket DESC, failures DESC, category LIMIT 1000",
)
def failures_by_category(t, minutes: int = 15, window: int = 30 * DAY):
    own = t.last(window).where(_kind(*FAILURES_ANOMALY)).groupBy(floor_minutes(F.col("timestamp"), minutes).alias("bucket"), failure_category(F.col("event_type")).alias("category"))
    return own.agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("node_id").alias("nodes")).orderBy(F.desc("bucket"), F.desc("failures"), "category").limit(1000)


@query(
    "q38_sync_status_timeline",
    _GRID
    + """, b AS (SELECT date_trunc('hour', timestamp) AS bucket, node_id, max(slot) AS slot FROM ev WHERE event_type = 11 GROUP BY 1, 2),
m AS (SELECT *, max(slot) OVER (PARTITION BY bucket) AS top FROM b), c AS (SELECT bucket, count(*) AS nodes, count(*) FILTER (slot >= top - 2) AS synced FROM m GROUP BY 1)
SELECT bucket, coalesce(nodes, 0) AS nodes, coalesce(synced, 0) AS synced, CASE WHEN coalesce(nodes, 0) = 0 THEN 100.0 ELSE round(CAST(100 * CAST(synced AS DECIMAL(20, 10)) / nodes AS DOUBLE), 1) END AS percent FROM g LEFT JOIN c USING (bucket)""",
)
def sync_status_timeline(t, hours: int = 24, minutes: int = 60):
    """Nodes within two slots of the bucket's best; the grid and the data share their buckets."""
    best = t.last((hours + 1) * 60).where(_kind(11)).groupBy(time_bucket(F.col("timestamp"), minutes * 60).alias("bucket"), "node_id").agg(F.max("slot").alias("slot"))
    top = F.max("slot").over(Window.partitionBy("bucket"))
    counted = best.withColumn("top", top).groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes"), count_if(F.col("slot") >= F.col("top") - 2).alias("synced"))
    filled = _grid(t, hours, minutes).join(counted, "bucket", "left").fillna(0, ["nodes", "synced"])
    return filled.withColumn("percent", F.coalesce(ratio(F.col("synced") * 100, F.col("nodes"), 1), F.lit(100.0)))


@query("q38_sync_current", "SELECT node_id, max(slot) AS slot, (SELECT max(slot) FROM ev WHERE event_type = 11) - max(slot) AS behind, max(slot) >= (SELECT max(slot) FROM ev WHERE event_type = 11) - 2 AS synced FROM ev WHERE event_type = 11 GROUP BY node_id")
def sync_current(t):
    best = t.events.where(_kind(11)).groupBy("node_id").agg(F.max("slot").alias("slot"))
    joined = best.crossJoin(F.broadcast(best.agg(F.max("slot").alias("top"))))  # one row
    return joined.select("node_id", "slot", (F.col("top") - F.col("slot")).alias("behind"), (F.col("slot") >= F.col("top") - 2).alias("synced"))


@query(
    "q39_connections_timeline",
    _GRID
    + """, c AS (SELECT date_trunc('hour', timestamp) AS bucket, count(*) FILTER (event_type IN (23, 26)) AS connects, count(*) FILTER (event_type = 27) AS disconnects, count(DISTINCT node_id) FILTER (event_type IN (23, 26)) AS nodes
  FROM ev WHERE event_type IN (23, 26, 27) GROUP BY 1) SELECT bucket, coalesce(connects, 0) AS connects, coalesce(disconnects, 0) AS disconnects, coalesce(nodes, 0) AS nodes FROM g LEFT JOIN c USING (bucket)""",
)
def connections_timeline(t, hours: int = 24, minutes: int = 60):
    own = t.last((hours + 1) * 60).where(_kind(23, 26, 27)).groupBy(time_bucket(F.col("timestamp"), minutes * 60).alias("bucket"))
    counts = own.agg(count_if(_kind(23, 26)).alias("connects"), count_if(_kind(27)).alias("disconnects"), F.count_distinct(F.when(_kind(23, 26), F.col("node_id"))).alias("nodes"))
    return _grid(t, hours, minutes).join(counts, "bucket", "left").fillna(0, ["connects", "disconnects", "nodes"])


@query("q39_connections_by_day", "SELECT date_trunc('day', timestamp) AS day, count(*) FILTER (event_type IN (23, 26)) AS connects, count(*) FILTER (event_type = 27) AS disconnects FROM ev WHERE event_type IN (23, 26, 27) GROUP BY 1")
def connections_by_day(t):
    own = t.events.where(_kind(23, 26, 27)).groupBy(F.to_date("timestamp").cast("timestamp_ntz").alias("day"))
    return own.agg(count_if(_kind(23, 26)).alias("connects"), count_if(_kind(27)).alias("disconnects"))


@query(
    "q39_connections_by_node",
    """SELECT node_id, min(timestamp) AS first_seen, max(timestamp) AS last_seen, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600000000.0, 6) AS uptime_hours,
  count(DISTINCT CAST(timestamp AS DATE)) AS days_active, count(*) AS total_events, round(count(*) / greatest((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600000000.0, 1), 6) AS events_per_hour
FROM ev, a WHERE created_at > t - INTERVAL 7 DAY GROUP BY node_id""",
)
def connections_by_node(t, hours: int = 7 * 24):
    """How long each node was seen, on how many days, and its events an hour."""
    hours_up = (micros(F.max("timestamp")) - micros(F.min("timestamp"))) / F.lit(3_600_000_000.0)
    return t.events.where(t.within(hours * 60, "created_at")).groupBy("node_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.round(hours_up, 6).alias("uptime_hours"),
        F.count_distinct(F.to_date("timestamp")).alias("days_active"),
        F.count(F.lit(1)).alias("total_events"),
        F.round(F.count(F.lit(1)) / F.greatest(hours_up, F.lit(1.0)), 6).alias("events_per_hour"),
    )


@query(
    "q39_connection_health",
    """SELECT count(DISTINCT node_id) AS nodes_seen, count(DISTINCT node_id) FILTER (created_at > t - INTERVAL 1 HOUR) AS currently_active, count(DISTINCT node_id) FILTER (created_at > t - INTERVAL 1 DAY) AS active_of_late
FROM ev, a WHERE created_at > t - INTERVAL 7 DAY""",
)
def connection_health(t, hours: int = 7 * 24, now: int = 60, late: int = DAY):
    seen = lambda m: F.count_distinct(F.when(t.within(m, "created_at"), F.col("node_id")))
    return t.events.where(t.within(hours * 60, "created_at")).agg(F.count_distinct("node_id").alias("nodes_seen"), seen(now).alias("currently_active"), seen(late).alias("active_of_late"))


@query(
    "q40_aggregated_metrics",
    """SELECT count(*) FILTER (created_at > t - INTERVAL 1 HOUR) AS short_events, count(*) FILTER (event_type = 11 AND created_at > t - INTERVAL 1 HOUR) AS short_blocks,
  count(*) FILTER (created_at > t - INTERVAL 6 HOUR) AS middle_events, count(*) FILTER (event_type = 11 AND created_at > t - INTERVAL 6 HOUR) AS middle_blocks, count(*) FILTER (event_type = 12 AND created_at > t - INTERVAL 6 HOUR) AS middle_finalized,
  count(DISTINCT node_id) FILTER (created_at > t - INTERVAL 6 HOUR) AS middle_nodes, count(*) AS long_events, count(DISTINCT node_id) AS nodes,
  count(*) FILTER (event_type BETWEEN 90 AND 113) AS package_events, max(slot) FILTER (event_type = 11) AS latest_slot, max(slot) FILTER (event_type = 12) AS finalized_slot,
  CASE WHEN count(*) FILTER (event_type BETWEEN 90 AND 113) > 0 THEN round(count(*) FILTER (event_type IN (41, 44, 46, 81, 83, 92, 99, 107, 111, 113, 122, 127)) / count(*) FILTER (event_type BETWEEN 90 AND 113)::DOUBLE, 6) ELSE 0 END AS failure_rate FROM ev, a WHERE created_at > t - INTERVAL 1 DAY""",
)
def registered_aggregated(t):
    return aggregated_metrics(t, 60, 360, DAY)  # seconds of the test tables are empty


def aggregated_metrics(t, short: float = 1 / 60, middle: float = 10 / 60, longest: float = 1):
    """Events, blocks and nodes of a second, of ten and of a minute, in one pass; failures are rated against the events of work packages."""
    packages = F.col("event_type").between(90, 113)
    top = lambda i: F.max(F.when(_kind(i), F.col("slot")))
    brief, some = t.within(short, "created_at"), t.within(middle, "created_at")
    return t.events.where(t.within(longest, "created_at")).agg(
        count_if(brief).alias("short_events"),
        count_if(_kind(11) & brief).alias("short_blocks"),
        count_if(some).alias("middle_events"),
        count_if(_kind(11) & some).alias("middle_blocks"),
        count_if(_kind(12) & some).alias("middle_finalized"),
        F.count_distinct(F.when(some, F.col("node_id"))).alias("middle_nodes"),
        F.count(F.lit(1)).alias("long_events"),
        F.count_distinct("node_id").alias("nodes"),
        count_if(packages).alias("package_events"),
        top(11).alias("latest_slot"),
        top(12).alias("finalized_slot"),
        F.coalesce(F.round(count_if(_kind(*FAILURES_ANALYTICS)) / F.nullif(count_if(packages), F.lit(0)), 6), F.lit(0.0)).alias("failure_rate"),
    )
