"""Cores: telemetry, status, validators, metrics, bottlenecks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import checked
from ..functions.columns import at, count_if, micros, ms_between, one_of, ratio
from ..operators.joins import either_key_semi
from ..operators.ranks import percentiles_cont
from ..operators.segments import lagged
from ..streaming.core_window import core_window
from .registry import query

WEEK, MONTH = 7 * 1440, 30 * 1440
#: Seconds of a segment of package events, of which a node has few a day in the test tables.
SPARSE = 90 * 86_400


def _kind(*ids):
    return one_of("event_type", ids)


@query(
    "q07_cores_telemetry",
    """SELECT count(*) FILTER (event_type = 105 AND timestamp > t - INTERVAL 1 DAY) AS guarantees_primary, count(*) FILTER (event_type = 105) AS guarantees_secondary,
  max(timestamp) FILTER (event_type = 105) AS last_activity, count(*) FILTER (event_type IN (101, 102)) AS refinements FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY""",
)
def cores_telemetry(t, primary: int = 1440, secondary: int = WEEK):
    return t.last(secondary).agg(
        count_if(_kind(105) & t.within(primary)).alias("guarantees_primary"),
        count_if(_kind(105)).alias("guarantees_secondary"),
        F.max(F.when(_kind(105), F.col("timestamp"))).alias("last_activity"),
        count_if(_kind(101, 102)).alias("refinements"),
    )


@query(
    "q07_cores_split",
    """, c AS (SELECT core, count(*) FILTER (event_type IN (93, 94)) AS packages FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY GROUP BY core),
g AS (SELECT count(*) FILTER (event_type = 105) AS n FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY), ac AS (SELECT count(*) FILTER (packages > 0) AS active FROM c)
SELECT core, packages, CASE WHEN packages > 0 THEN n // active ELSE 0 END AS guarantees, CASE WHEN packages > 0 THEN 'active' ELSE 'idle' END AS status FROM c, g, ac""",
)
def cores_split(t, minutes: int = WEEK):
    """Guarantees divided evenly over the cores that received packages."""
    own = t.last(minutes)
    cores = own.groupBy("core").agg(count_if(_kind(93, 94)).alias("packages"), count_if(_kind(105)).alias("g"))
    totals = cores.agg(F.sum("g").alias("n"), count_if(F.col("packages") > 0).alias("active"))
    busy = F.col("packages") > 0
    joined = cores.drop("g").crossJoin(F.broadcast(totals))  # one row
    return joined.select("core", "packages", F.when(busy, F.expr("n div nullif(active, 0)")).otherwise(F.lit(0)).cast("long").alias("guarantees"), F.when(busy, "active").otherwise("idle").alias("status"))


@query(
    "q16_cores_status",
    """, w AS (SELECT core, count(*) AS packages, max(timestamp) AS last_package FROM ev, a WHERE event_type = 94 AND timestamp > t - INTERVAL 7 DAY GROUP BY 1),
g AS (SELECT core, count(*) AS guarantees, max(timestamp) AS last_guarantee FROM ev, a WHERE event_type = 105 AND timestamp > t - INTERVAL 7 DAY GROUP BY 1)
SELECT coalesce(w.core, g.core) AS core, coalesce(packages, 0) AS packages, coalesce(guarantees, 0) AS guarantees, greatest(last_package, last_guarantee) AS last_activity,
  CASE WHEN greatest(last_package, last_guarantee) > t - INTERVAL 1 DAY THEN 'active' WHEN greatest(last_package, last_guarantee) > t - INTERVAL 3 DAY THEN 'idle' ELSE 'stale' END AS status
FROM w FULL JOIN g ON w.core = g.core, a""",
)
def cores_status(t, minutes: int = WEEK):
    part = lambda i, n, last: t.last(minutes).where(_kind(i)).groupBy("core").agg(F.count(F.lit(1)).alias(n), F.max("timestamp").alias(last))
    joined = part(94, "packages", "last_package").join(part(105, "guarantees", "last_guarantee"), "core", "full").fillna(0, ["packages", "guarantees"])
    rows = joined.withColumn("last_activity", F.greatest("last_package", "last_guarantee")).drop("last_package", "last_guarantee")
    return rows.withColumn("status", F.when(t.within(1440, "last_activity"), "active").when(t.within(3 * 1440, "last_activity"), "idle").otherwise("stale"))


@query(
    "q23_validator_core_mapping",
    """, c AS (SELECT node_id, core, count(*) AS guarantees FROM ev, a WHERE event_type = 105 AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2)
SELECT node_id, core AS primary_core, guarantees, total FROM (SELECT *, sum(guarantees) OVER (PARTITION BY node_id)::BIGINT AS total, row_number() OVER (PARTITION BY node_id ORDER BY guarantees DESC, core) AS rn FROM c) WHERE rn = 1""",
)
def validator_core_mapping(t, minutes: int = MONTH):
    """Each validator's core with most guarantees."""
    by = t.last(minutes).where(_kind(105)).groupBy("node_id", "core").agg(F.count(F.lit(1)).alias("guarantees"))
    own = Window.partitionBy("node_id")
    ranked = by.withColumns({"total": F.sum("guarantees").over(own), "rn": F.row_number().over(own.orderBy(F.desc("guarantees"), "core"))})
    return ranked.where("rn = 1").select("node_id", F.col("core").alias("primary_core"), "guarantees", "total")


@query(
    "q23_tickets_per_epoch",
    "SELECT node_id, epoch, count(*) AS ticket_count, max(timestamp) AS last_generated FROM bd, a WHERE event_type = 80 AND created_at > t - INTERVAL 30 DAY GROUP BY node_id, epoch",
)
def tickets_per_epoch(t, minutes: int = MONTH):
    """Runs of ticket generation by node and the epoch that their bodies name."""
    own = t.linked((80,), "epoch").where(t.within(minutes, "created_at"))
    return own.groupBy("node_id", "epoch").agg(F.count(F.lit(1)).alias("ticket_count"), F.max("timestamp").alias("last_generated"))


@query(
    "q23_core_summary",
    "SELECT core AS core_index, count(DISTINCT node_id) AS active_validators, count(*) AS total_guarantees, max(timestamp) AS last_activity FROM bd, a WHERE event_type = 105 AND created_at > t - INTERVAL 30 DAY GROUP BY core",
)
def core_summary(t, minutes: int = MONTH):
    """Who built guarantees for each core, by the core in their bodies."""
    own = t.linked((105,), "core").where(t.within(minutes, "created_at"))
    return own.groupBy(F.col("core").alias("core_index")).agg(F.count_distinct("node_id").alias("active_validators"), F.count(F.lit(1)).alias("total_guarantees"), F.max("timestamp").alias("last_activity"))


#: the events of a package that name it by share or submission id (fixed values)
_BY_ID = (94, 95, 101, 102, 105, 109, 92)
LONG = 3000 * 1440


def _participants(t, core: int, minutes: int) -> DataFrame:
    """Events that name a package received on a core, by the share or submission id of their bodies."""
    recent = F.col("timestamp") > at(t.packages_as_of - timedelta(minutes=minutes))
    keyed = t.pipeline(*_BY_ID).where(recent).select("timestamp", "node_id", "event_type", "share", "core", "gas", "gas_limit")
    own = keyed.where((F.col("event_type") == 94) & (F.col("core") == core))
    return either_key_semi(keyed, ["share"], own.where("share IS NOT NULL"), "share")


_PARTICIPANTS = """, pb AS (SELECT package, node_id, event_type, timestamp, core, part, gas_limit, CASE WHEN event_type = 101 THEN gas + 1 WHEN event_type = 95 THEN gas END AS gas, gas AS size FROM pk, pa WHERE timestamp > t - INTERVAL 3000 DAY),
own AS (SELECT DISTINCT package AS id FROM pb WHERE event_type = 94 AND core = 3), pe AS (SELECT pb.* FROM pb JOIN own ON pb.package = own.id)"""


@query(
    "q44_core_validators",
    _PARTICIPANTS + """, v AS (SELECT node_id, count(*) AS events, max(timestamp) AS last_event FROM pe GROUP BY node_id)
SELECT row_number() OVER (ORDER BY node_id) - 1 AS validator_index, node_id, events, last_event FROM v""",
)
def core_validators(t, core: int = 3, minutes: int = LONG):
    """Participants of a core's packages, or all connected nodes where it has none, numbered by node; their number is that of the network's nodes at most."""
    by = _participants(t, core, minutes).groupBy("node_id").agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_event"))
    none = F.broadcast(by.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0"))  # one row, or none
    connected = t.nodes.where("is_connected").select("node_id", F.lit(0).cast("bigint").alias("events"), F.col("last_seen").alias("last_event"))
    by = by.unionByName(connected.crossJoin(none).drop("_n"))
    return by.withColumn("validator_index", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("long"))


@query("q44_idle_core_validators", "SELECT row_number() OVER (ORDER BY node_id) - 1 AS validator_index, node_id, 0::BIGINT AS events, last_seen AS last_event FROM nodes WHERE is_connected")
def idle_core_validators(t):
    """The same of a core without packages."""
    return core_validators(t, core=9999)


@query(
    "q45_core_metrics",
    _PARTICIPANTS
    + """, m AS (SELECT count(*) FILTER (event_type = 94) AS received, count(*) FILTER (event_type = 101) AS refined, count(*) FILTER (event_type = 92) AS failed, count(*) FILTER (event_type = 102) AS reports,
    count(*) FILTER (event_type = 105) AS built, count(*) FILTER (event_type = 109) AS distributed, count(DISTINCT node_id) AS active_validators, avg(gas) FILTER (event_type = 101) AS avg_gas, sum(gas) FILTER (event_type = 101) AS total_gas FROM pe),
lm AS (SELECT avg(gas_limit) AS avg_limit, count(*) FILTER (timestamp > t - INTERVAL 1 DAY) AS last_day FROM pb, pa WHERE event_type = 94 AND core = 3),
r AS (SELECT DISTINCT package, timestamp AS since FROM pb WHERE event_type = 94 AND core = 3),
l AS (SELECT (epoch_us(max(timestamp)) - epoch_us(since)) AS us FROM r JOIN pb USING (package) WHERE event_type IN (95, 101, 102, 105, 109) GROUP BY package, since),
ls AS (SELECT count(*) AS samples, coalesce(round(avg(us / 1000.0), 3), 0) AS avg_completion_ms, coalesce(round(quantile_cont(us / 1000.0, 0.95), 3), 0) AS p95_completion_ms FROM l WHERE us > 0 AND us < 86400000000000)
SELECT received, refined, failed, reports, built, distributed, active_validators, round(CASE WHEN refined + failed > 0 THEN 100.0 * refined / (refined + failed) WHEN received > 0 THEN 0 ELSE 100 END, 4) AS efficiency,
  round(CASE WHEN built > 0 THEN 100.0 * distributed / built ELSE 100 END, 4) AS accumulate_rate, round(100.0 * coalesce(avg_gas, 0) / avg_limit, 6) AS gas_utilisation, coalesce(CAST(total_gas AS BIGINT), 0) AS total_gas,
  avg_completion_ms, p95_completion_ms, samples, last_day, round(received / 3600.0, 6) AS throughput FROM m, lm, ls""",
)
def registered_metrics(t):
    return core_metrics(t, most_ms=86_400_000_000)  # stages of the test tables lie days apart


@checked
def core_metrics(t, core: int = 3, minutes: int = LONG, most_ms: int = 300_000):
    """A core's packages over a window: what became of them, gas against its limit, and the time from when a package was
    received to its last later stage (of those under ``most_ms``); packages of the last day; throughput by second of an hour."""
    own = _participants(t, core, minutes)
    received = (F.col("event_type") == 94) & (F.col("core") == core)
    row = own.agg(
        *(count_if(_kind(i)).alias(n) for n, i in {"received": 94, "refined": 101, "failed": 92, "reports": 102, "built": 105, "distributed": 109}.items()),
        F.count_distinct("node_id").alias("active_validators"),
        F.coalesce(F.avg(F.when(_kind(101), F.col("gas"))), F.lit(0.0)).alias("avg_gas"),
        F.coalesce(F.sum(F.when(_kind(101), F.col("gas"))), F.lit(0)).alias("total_gas"),
        F.avg(F.when(received, F.col("gas_limit"))).alias("avg_limit"),
        count_if(received & (F.col("timestamp") > at(t.packages_as_of - timedelta(days=1)))).alias("last_day"),
    )
    # a package's receipts are one for each node at most
    by = own.groupBy("share").agg(F.collect_set(F.when(received, F.col("timestamp"))).alias("since"), F.max(F.when(_kind(95, 101, 102, 105, 109), F.col("timestamp"))).alias("done"))
    times = by.select("done", F.explode("since").alias("since")).select((micros(F.col("done")) - micros(F.col("since"))).alias("us"))
    times = times.where((F.col("us") > 0) & (F.col("us") < most_ms * 1000))
    latency = times.agg(F.coalesce(F.round(F.avg(F.col("us") / 1000.0), 3), F.lit(0.0)).alias("avg_completion_ms"), F.count(F.lit(1)).alias("samples"))
    ranks = percentiles_cont(times, "us", {"p95": 0.95}, most_ms * 1000, scale=1000.0).select(F.coalesce(F.round("p95", 3), F.lit(0.0)).alias("p95_completion_ms"))
    row = row.crossJoin(F.broadcast(latency)).crossJoin(F.broadcast(ranks))  # one row each
    done = F.col("refined") + F.col("failed")
    return row.select(
        "received", "refined", "failed", "reports", "built", "distributed", "active_validators",
        F.round(F.when(done > 0, 100.0 * F.col("refined") / F.nullif(done, F.lit(0))).when(F.col("received") > 0, 0.0).otherwise(100.0), 4).alias("efficiency"),
        F.round(F.when(F.col("built") > 0, 100.0 * F.col("distributed") / F.nullif("built", F.lit(0))).otherwise(100.0), 4).alias("accumulate_rate"),
        F.round(100.0 * F.col("avg_gas") / F.col("avg_limit"), 6).alias("gas_utilisation"),
        "total_gas", "avg_completion_ms", "p95_completion_ms", "samples", "last_day",
        F.round(F.col("received") / 3600.0, 6).alias("throughput"),
    )


@query(
    "q47_core_bottlenecks",
    _PARTICIPANTS
    + """, g AS (SELECT node_id, event_type, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY node_id ORDER BY timestamp, CAST(package AS VARCHAR), event_type, CASE event_type WHEN 94 THEN size WHEN 95 THEN gas WHEN 101 THEN gas END))) / 1000.0 AS ms FROM pe WHERE event_type IN (94, 95, 101, 102, 105, 109, 92)),
n AS (SELECT node_id, count(*) AS event_count, count(*) FILTER (event_type = 92) AS failure_count, avg(ms) AS avg_ms FROM g WHERE ms IS NOT NULL GROUP BY node_id HAVING count(*) > 5), w AS (SELECT avg(avg_ms) AS network FROM n)
SELECT node_id, round(avg_ms, 3) AS avg_ms, event_count, failure_count, round(CAST(CAST(failure_count AS DECIMAL(38, 10)) / event_count AS DOUBLE), 3) AS failure_rate, round(avg_ms / nullif(network, 0), 2) AS slowdown,
  avg_ms > 1.5 * network OR failure_count / event_count::DOUBLE > 0.1 AS is_bottleneck FROM n, w WHERE avg_ms > 1.2 * network OR failure_count / event_count::DOUBLE > 0.05 ORDER BY n.avg_ms DESC, node_id LIMIT 10""",
)
def core_bottlenecks(t, core: int = 3, minutes: int = LONG, least: int = 5, limit: int = 10):
    """Nodes of a core whose gaps between package events are long against the mean node's, or that fail often; a node's events are many tasks."""
    own = _participants(t, core, minutes)
    gaps = lagged(own, "node_id", "timestamp", ["share", "event_type"], "timestamp", "before", SPARSE).withColumn("ms", ms_between(F.col("timestamp"), F.col("before")))
    by = gaps.where("ms IS NOT NULL").groupBy("node_id").agg(F.count(F.lit(1)).alias("event_count"), count_if(_kind(92)).alias("failure_count"), F.avg("ms").alias("avg_ms")).where(F.col("event_count") > least)
    joined = by.crossJoin(F.broadcast(by.agg(F.avg("avg_ms").alias("network"))))  # one row
    share = F.col("failure_count") / F.col("event_count")
    over = lambda times, most: (F.col("avg_ms") > times * F.col("network")) | (share > most)
    slowest = joined.where(over(1.2, 0.05)).orderBy(F.desc("avg_ms"), "node_id").limit(limit)
    return slowest.select(
        "node_id",
        F.round("avg_ms", 3).alias("avg_ms"),
        "event_count",
        "failure_count",
        ratio(F.col("failure_count"), F.col("event_count"), 3).alias("failure_rate"),
        F.round(F.col("avg_ms") / F.nullif("network", F.lit(0.0)), 2).alias("slowdown"),
        over(1.5, 0.1).alias("is_bottleneck"),
    )


@query(
    "q47_bottleneck_totals",
    _PARTICIPANTS + " SELECT count(*) AS total_events, count(*) FILTER (event_type = 92) AS total_failures, count(DISTINCT node_id) AS validators FROM pe WHERE event_type IN (94, 95, 101, 102, 105, 109, 92)",
)
def bottleneck_totals(t, core: int = 3, minutes: int = LONG):
    own = _participants(t, core, minutes)
    return own.agg(F.count(F.lit(1)).alias("total_events"), count_if(_kind(92)).alias("total_failures"), F.count_distinct("node_id").alias("validators"))


@query(
    "q53_core_window",
    """, z AS (SELECT slot, core, coalesce(sum(gas) FILTER (event_type IN (94, 105)), 0) AS gas_used, coalesce(sum(k) FILTER (event_type IN (120, 121, 123, 124)), 0) AS da_load, coalesce(sum(k % 5) FILTER (event_type BETWEEN 10 AND 13), 0) AS popularity,
  count(*) FILTER (event_type = 97) AS imports, count(*) FILTER (event_type = 96) AS extrinsic_count, coalesce(sum(gas) FILTER (event_type = 96), 0) AS extrinsic_size FROM ev GROUP BY slot, core),
n AS (SELECT DISTINCT slot FROM ev ORDER BY slot DESC LIMIT 600), c AS (SELECT unnest(range(16))::INTEGER AS core_index),
w AS (SELECT n.slot, core_index, z.*, gas_used > 0 OR popularity > 0 OR da_load > 0 AS active FROM n CROSS JOIN c LEFT JOIN z ON z.slot = n.slot AND z.core = core_index)
SELECT 'node' AS source, core_index, coalesce(sum(gas_used), 0)::BIGINT AS gas_used, coalesce(sum(da_load), 0)::BIGINT AS da_load, coalesce(sum(imports), 0)::BIGINT AS imports, coalesce(sum(extrinsic_count), 0)::BIGINT AS extrinsic_count,
  coalesce(sum(extrinsic_size), 0)::BIGINT AS extrinsic_size, round(coalesce(avg(popularity) FILTER (active), 0), 6) AS popularity_avg, count(*) FILTER (active) AS active_blocks, count(*) AS window_blocks,
  coalesce(max(w.slot) FILTER (active), 0) AS last_active_slot FROM w GROUP BY core_index""",
)
def rolling_core_window(t, blocks: int = 600):
    """What each core did over the last samples of all cores."""
    return core_window(t.core_samples, blocks).withColumn("popularity_avg", F.round("popularity_avg", 6))


@query(
    "q53_core_rolling",
    """, s AS (SELECT core, slot, max(gas) AS gas_used FROM ev WHERE event_type IN (10, 94, 105, 42) GROUP BY 1, 2)
SELECT core, slot, CAST(sum(gas_used) OVER w AS BIGINT) AS gas_used, count(*) OVER w AS samples FROM s WINDOW w AS (PARTITION BY core ORDER BY slot ROWS BETWEEN 599 PRECEDING AND CURRENT ROW)""",
)
def core_rolling(t, rows: int = 600):
    """The same as a running frame of a core's samples."""
    samples = t.events.where(_kind(10, 94, 105, 42)).groupBy("core", "slot").agg(F.max("gas").alias("gas_used"))
    frame = Window.partitionBy("core").orderBy("slot").rowsBetween(1 - rows, 0)
    return samples.select("core", "slot", F.sum("gas_used").over(frame).alias("gas_used"), F.count(F.lit(1)).over(frame).alias("samples"))
