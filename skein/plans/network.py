"""The network as a whole: information, topology, failures, health, alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at, count_if, micros, one_of, ratio
from ..sources.footers import table_figures
from ..sources.snapshots import services_totals
from .constants import CATEGORIES, FAILURE_NAMES, FAILURES_ANALYTICS, FAILURES_ANOMALY
from .registry import query

DAY, WEEK, MONTH = 1440, 7 * 1440, 30 * 1440


def _kind(*ids):
    return one_of("event_type", ids)


@query(
    "q05_health_metrics",
    "SELECT (SELECT count(*) FROM nodes WHERE is_connected) AS connected_nodes, (SELECT count(*) FROM ev) AS total_events, (SELECT coalesce(CAST(sum(event_count) AS BIGINT), 0) FROM st, a WHERE bucket > t - INTERVAL 1 DAY) AS recent_events",
)
def health_metrics(t, minutes: int = DAY):
    """Connected nodes, all events by the footers of their files, and the events of a window by the minute."""
    connected = t.nodes.agg(count_if(F.col("is_connected")).alias("connected_nodes"))
    recent = t.stats(minutes).agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("recent_events"))
    total = table_figures({"events": t.raw}).select(F.col("rows").alias("total_events"))
    return connected.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(recent))  # one row each


@query("agg20_table_rows", "SELECT 'events' AS name, (SELECT count(*) FROM events) AS rows, true AS has_bytes")
def table_rows(t):
    """Rows and size of the event table from its files' footers; no column is read."""
    return table_figures({"events": t.raw}).select("name", "rows", (F.col("bytes") > 0).alias("has_bytes"))


@query(
    "q08_network_info",
    """, p AS (SELECT arg_min(n_nationkey, node_id) FILTER (is_connected) AS x FROM nodes LEFT JOIN nation ON n_name = implementation)
SELECT count(*) AS total_nodes, count(*) FILTER (is_connected) AS connected_nodes, count(DISTINCT implementation) AS implementations,
  (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT implementation AS i FROM nodes)) AS names,
  coalesce(max(16 + x), 0) AS core_count, coalesce(max(1000 + x), 0) AS val_count, coalesce(max(600), 0) AS epoch_period, coalesce(max(6), 6) AS slot_period_sec, max(lower(hex(x))) AS genesis FROM nodes, p""",
)
def network_info(t):
    """Counts and implementations, and the parameters and genesis that a connected node told; without one, the defaults."""
    names = F.array_join(F.sort_array(F.collect_set("implementation")), ",")
    any_connected = F.min_by("params", F.when(F.col("is_connected"), F.col("node_id")))
    told = t.nodes.agg(F.count(F.lit(1)).alias("total_nodes"), count_if(F.col("is_connected")).alias("connected_nodes"), F.count_distinct("implementation").alias("implementations"), names.alias("names"), any_connected.alias("p"))
    default = {"core_count": 0, "val_count": 0, "epoch_period": 0, "slot_period_sec": 6}
    return told.select("total_nodes", "connected_nodes", "implementations", "names", *(F.coalesce(f"p.{n}", F.lit(d)).alias(n) for n, d in default.items()), F.col("p.genesis").alias("genesis"))


def _edges(t, kind: int, least: int, minutes: int, limit: int):
    """Who sent to whom, how often and when last, the busiest pairs first."""
    by = t.last(minutes).where(_kind(kind)).groupBy(F.col("node_id").alias("from_node"), F.col("peer_id").alias("to_node"))
    edges = by.agg(F.count(F.lit(1)).alias("message_count"), F.max("timestamp").alias("last_seen")).where(F.col("message_count") > least)
    return edges.orderBy(F.desc("message_count"), "from_node", "to_node").limit(limit)


_EDGES = "SELECT node_id AS from_node, peer_id AS to_node, count(*) AS message_count, max(timestamp) AS last_seen FROM ev, a WHERE event_type = %d AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2 %s ORDER BY message_count DESC, from_node, to_node LIMIT 5000"


@query("q24_peer_topology", _EDGES % (62, "HAVING count(*) > 1"))
def peer_topology(t, minutes: int = MONTH, limit: int = 5000):
    """Edges of more than one announcement."""
    return _edges(t, 62, 1, minutes, limit)


@query("q24_ticket_topology", _EDGES % (84, ""))
def ticket_topology(t, minutes: int = MONTH, limit: int = 5000):
    return _edges(t, 84, 0, minutes, limit)


@query(
    "q24_block_transfers",
    "SELECT node_id, count(*) AS blocks_transferred, count(DISTINCT slot) AS unique_slots, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, max(timestamp) AS last_transfer FROM bd, a WHERE event_type = 68 AND timestamp > t - INTERVAL 30 DAY GROUP BY node_id",
)
def block_transfers(t, minutes: int = MONTH):
    """Blocks that nodes got, the slots and bytes that the bodies name."""
    own = t.linked((68,), "slot", "bytes").where(t.within(minutes)).groupBy("node_id")
    return own.agg(F.count(F.lit(1)).alias("blocks_transferred"), F.count_distinct("slot").alias("unique_slots"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.max("timestamp").alias("last_transfer"))


@query(
    "q24_topology_stats",
    """, own AS (SELECT ev.* FROM ev, a WHERE event_type IN (62, 68, 84) AND timestamp > t - INTERVAL 30 DAY), e AS (SELECT node_id, peer_id FROM own WHERE event_type = 62 GROUP BY 1, 2 HAVING count(*) > 1 LIMIT 5000)
SELECT (SELECT count(*) FROM e) AS total_connections, count(*) FILTER (event_type = 62) AS announcements, count(*) FILTER (event_type = 68) AS transfers, count(*) FILTER (event_type = 84) AS ticket_transfers,
  count(DISTINCT node_id) AS active_nodes, CASE WHEN count(DISTINCT node_id) > 0 THEN (SELECT count(*) FROM e) // count(DISTINCT node_id) ELSE 0 END AS avg_peers FROM own""",
)
def topology_stats(t, minutes: int = MONTH):
    """Counts of messages and nodes, and the whole number of connections a node."""
    own = t.last(minutes).where(_kind(62, 68, 84))
    counts = own.agg(*(count_if(_kind(i)).alias(n) for i, n in ((62, "announcements"), (68, "transfers"), (84, "ticket_transfers"))), F.count_distinct("node_id").alias("active_nodes"))
    links = peer_topology(t, minutes).agg(F.count(F.lit(1)).alias("total_connections"))
    return counts.crossJoin(F.broadcast(links)).withColumn("avg_peers", F.coalesce(F.expr("total_connections div nullif(active_nodes, 0)"), F.lit(0)))  # one row each


@query(
    "q30_failure_rates",
    """SELECT CAST(sum(event_count) AS BIGINT) AS total, coalesce(CAST(sum(event_count) FILTER (event_type IN (41, 44, 46, 81, 83, 92, 99, 107, 111, 113, 122, 127)) AS BIGINT), 0) AS failures,
  round(CAST(CAST(coalesce(sum(event_count) FILTER (event_type IN (41, 44, 46, 81, 83, 92, 99, 107, 111, 113, 122, 127)), 0) AS DECIMAL(38, 10)) / sum(event_count) AS DOUBLE), 4) AS rate FROM st, a WHERE bucket > t - INTERVAL 7 DAY""",
)
def failure_rates(t, minutes: int = WEEK):
    failed = F.coalesce(F.sum(F.when(_kind(*FAILURES_ANALYTICS), F.col("event_count"))), F.lit(0))
    totals = t.stats(minutes).agg(F.sum("event_count").alias("total"), failed.alias("failures"))
    return totals.withColumn("rate", ratio(F.col("failures"), F.col("total"), 4))


@query(
    "q30_failure_categories",
    """, n AS (SELECT event_type AS y, CAST(sum(event_count) AS BIGINT) AS n FROM st, a WHERE bucket > t - INTERVAL 7 DAY GROUP BY 1), c AS (
  SELECT 'block_authoring' AS category, coalesce(sum(n) FILTER (y IN (40, 41, 42, 44, 46)), 0) AS attempts, coalesce(sum(n) FILTER (y IN (41, 44, 46)), 0) AS failures FROM n
  UNION ALL SELECT 'work_package', coalesce(sum(n) FILTER (y IN (94, 95, 101, 102, 92, 99)), 0), coalesce(sum(n) FILTER (y IN (92, 99)), 0) FROM n
  UNION ALL SELECT 'ticket_generation', coalesce(sum(n) FILTER (y BETWEEN 80 AND 84), 0), coalesce(sum(n) FILTER (y IN (81, 83)), 0) FROM n
  UNION ALL SELECT 'guarantee', coalesce(sum(n) FILTER (y BETWEEN 105 AND 109), 0), coalesce(sum(n) FILTER (y = 107), 0) FROM n)
SELECT category, CAST(attempts AS BIGINT) AS attempts, CAST(failures AS BIGINT) AS failures, round(CAST(CAST(failures AS DECIMAL(38, 10)) / attempts AS DOUBLE), 4) AS rate FROM c WHERE attempts > 0""",
)
def failure_categories(t, minutes: int = WEEK):
    """Attempts and failures by category, from one pass; a row a category by unpivoting."""
    total = lambda ids: F.coalesce(F.sum(F.when(_kind(*ids), F.col("event_count"))), F.lit(0))
    rows = F.array(*(F.struct(F.lit(n).alias("category"), F.col(f"{n}_a").alias("attempts"), F.col(f"{n}_f").alias("failures")) for n in CATEGORIES))
    sums = t.stats(minutes).agg(*(total(ids).alias(f"{n}_{'af'[j]}") for n, both in CATEGORIES.items() for j, ids in enumerate(both)))
    return sums.select(F.inline(rows)).where("attempts > 0").withColumn("rate", ratio(F.col("failures"), F.col("attempts"), 4))


@query(
    "q30_failures_by_node",
    """, f AS (SELECT node_id, event_type, CAST(sum(event_count) AS BIGINT) AS n FROM st, a WHERE event_type IN (41, 44, 46, 81, 83, 92, 99, 107, 111, 113, 122, 127) AND bucket > t - INTERVAL 30 DAY GROUP BY 1, 2)
SELECT f.node_id, max(total) AS total_events, CAST(sum(n) AS BIGINT) AS failures, round(CAST(CAST(sum(n) AS DECIMAL(38, 10)) / max(total) AS DOUBLE), 4) AS failure_rate, arg_max(event_type, (n, -event_type)) AS top_type
FROM f JOIN (SELECT node_id, CAST(sum(event_count) AS BIGINT) AS total FROM st, a WHERE bucket > t - INTERVAL 30 DAY GROUP BY 1) z ON z.node_id = f.node_id GROUP BY f.node_id ORDER BY failures DESC, f.node_id LIMIT 20""",
)
def failures_by_node(t, minutes: int = MONTH, limit: int = 20):
    """The nodes with most failures, of all their events, and what fails most at each; one pass and one shuffle by node."""
    failed = _kind(*FAILURES_ANALYTICS)
    by = t.stats(minutes).groupBy("node_id", "event_type").agg(F.sum("event_count").alias("n"))
    rows = by.groupBy("node_id").agg(
        F.sum("n").alias("total_events"),
        F.sum(F.when(failed, F.col("n"))).alias("failures"),
        F.max_by(F.when(failed, F.col("event_type")), F.when(failed, F.struct("n", -F.col("event_type")))).alias("top_type"),
    )
    rated = rows.where("failures > 0").withColumn("failure_rate", ratio(F.col("failures"), F.col("total_events"), 4))
    return rated.orderBy(F.desc("failures"), "node_id").limit(limit)


@query(
    "q30_recent_failures",
    """SELECT timestamp, node_id, event_id, event_type, ([""" + ", ".join(f"'{n}'" for n in FAILURE_NAMES.values()) + "])[list_position([" + ", ".join(map(str, FAILURE_NAMES)) + """], event_type)] AS event_name, coalesce(reason, 'unknown') AS reason
FROM bd, a WHERE event_type IN (41, 44, 46, 81, 83, 92, 99, 107, 111, 113, 122, 127) AND timestamp > t - INTERVAL 7 DAY ORDER BY timestamp DESC, event_id DESC LIMIT 20""",
)
def recent_failures(t, minutes: int = WEEK, limit: int = 20):
    """The newest failures with the names that reports give them, and why, where the body says it."""
    names = F.create_map(*(F.lit(x) for pair in FAILURE_NAMES.items() for x in pair))
    newest = t.linked(FAILURES_ANALYTICS, "reason").where(t.within(minutes)).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)
    return newest.select("timestamp", "node_id", "event_id", "event_type", F.coalesce(names[F.col("event_type")], F.lit("Unknown")).alias("event_name"), F.coalesce("reason", F.lit("unknown")).alias("reason"))


# fixed values: inputs of the health components
_H = {"authored": (42,), "author_failed": (41,), "author_tries": (40,), "da_ops": (120, 124), "da_failed": (122,), "guarantees": (105,), "wp_failed": (92,), "wp_received": (94,)}
#: The least score of a healthy and of a degraded component, by component.
_LEVELS = {"connectivity": (80.0, 50.0), "blocks": (80.0, 50.0), "da": (90.0, 60.0), "packages": (90.0, 60.0), "throughput": (80.0, 50.0)}


def health_scores(t, recent: int, minutes: int) -> DataFrame:
    """One row: the inputs, the score of each component and their mean; ``recent`` and ``minutes`` are the short and the long window."""
    total = lambda ids: F.coalesce(F.sum(F.when(_kind(*ids), F.col("event_count"))), F.lit(0))
    now = t.within(recent, "bucket")
    m = t.stats(minutes).agg(
        *(total(ids).alias(n) for n, ids in _H.items()),
        F.coalesce(F.sum(F.when(now, F.col("event_count"))), F.lit(0)).alias("recent_events"),
        F.count_distinct("node_id").alias("active_long"),
        F.count_distinct(F.when(now, F.col("node_id"))).alias("active_recent"),
    )
    share = lambda a, b: 100.0 * F.col(a) / F.nullif(b, F.lit(0))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    a_minute = F.col("recent_events") / float(recent)
    scored = m.withColumns({
        "a_minute": a_minute,
        "connectivity": F.coalesce(F.least(share("active_recent", F.col("active_long")), F.lit(100.0)), F.lit(0.0)),
        "blocks": F.when(F.col("author_tries") > 0, clamp(share("authored", F.col("author_tries")))).when(a_minute > 0, 70.0).otherwise(0.0),
        "da": F.when(F.col("da_ops") > 0, clamp(100.0 * (1 - F.col("da_failed") / F.nullif("da_ops", F.lit(0))))).otherwise(50.0),
        "packages": F.coalesce(share("wp_received", F.col("wp_received") + F.col("wp_failed")), F.lit(50.0)),
        "throughput": F.when(a_minute > 100, 100.0).when(a_minute > 10, 80.0).when(a_minute > 0, 50.0).otherwise(0.0),
    })
    return scored.withColumn("health_score", sum((F.col(p) for p in list(_LEVELS)[1:]), F.col("connectivity")) / 5)


_HEALTH = """, m AS (SELECT coalesce(CAST(sum(event_count) FILTER (event_type = 42) AS BIGINT), 0) AS authored, coalesce(CAST(sum(event_count) FILTER (event_type = 41) AS BIGINT), 0) AS author_failed,
  coalesce(CAST(sum(event_count) FILTER (event_type = 40) AS BIGINT), 0) AS author_tries, coalesce(CAST(sum(event_count) FILTER (event_type IN (120, 124)) AS BIGINT), 0) AS da_ops,
  coalesce(CAST(sum(event_count) FILTER (event_type = 122) AS BIGINT), 0) AS da_failed, coalesce(CAST(sum(event_count) FILTER (event_type = 105) AS BIGINT), 0) AS guarantees,
  coalesce(CAST(sum(event_count) FILTER (event_type = 92) AS BIGINT), 0) AS wp_failed, coalesce(CAST(sum(event_count) FILTER (event_type = 94) AS BIGINT), 0) AS wp_received,
  coalesce(CAST(sum(event_count) FILTER (bucket > t - INTERVAL 1 DAY) AS BIGINT), 0) / 1440.0 AS a_minute, count(DISTINCT node_id) AS active_long, count(DISTINCT node_id) FILTER (bucket > t - INTERVAL 1 DAY) AS active_recent
  FROM st, a WHERE bucket > t - INTERVAL 7 DAY),
s AS (SELECT *, CASE WHEN active_long > 0 THEN least(100.0 * active_recent / active_long, 100.0) ELSE 0.0 END AS connectivity,
  CASE WHEN author_tries > 0 THEN least(greatest(100.0 * authored / author_tries, 0.0), 100.0) WHEN a_minute > 0 THEN 70.0 ELSE 0.0 END AS blocks,
  CASE WHEN da_ops > 0 THEN least(greatest(100.0 * (1 - da_failed / da_ops::DOUBLE), 0.0), 100.0) ELSE 50.0 END AS da,
  CASE WHEN wp_received + wp_failed > 0 THEN 100.0 * wp_received / (wp_received + wp_failed) ELSE 50.0 END AS packages,
  CASE WHEN a_minute > 100 THEN 100.0 WHEN a_minute > 10 THEN 80.0 WHEN a_minute > 0 THEN 50.0 ELSE 0.0 END AS throughput FROM m)"""


def _level(score, healthy: float, degraded: float):
    return F.when(score >= healthy, "healthy").when(score >= degraded, "degraded").otherwise("unhealthy")


@query(
    "q37_network_health",
    _HEALTH
    + """ SELECT round(connectivity, 4) AS connectivity, round(blocks, 4) AS blocks, round(da, 4) AS da, round(packages, 4) AS packages, CAST(throughput AS DOUBLE) AS throughput,
  round((connectivity + blocks + da + packages + throughput) / 5, 4) AS health_score,
  CASE WHEN (connectivity + blocks + da + packages + throughput) / 5 >= 75 THEN 'healthy' WHEN (connectivity + blocks + da + packages + throughput) / 5 >= 45 THEN 'degraded' ELSE 'unhealthy' END AS status FROM s""",
)
def network_health(t, recent: int = DAY, minutes: int = WEEK):
    s = health_scores(t, recent, minutes)
    return s.select(*(F.round(p, 4).alias(p) for p in _LEVELS), F.round("health_score", 4).alias("health_score"), _level(F.col("health_score"), 75.0, 45.0).alias("status"))


@query(
    "q37_health_components",
    _HEALTH
    + """ SELECT 'connectivity' AS component, CASE WHEN connectivity >= 80 THEN 'healthy' WHEN connectivity >= 50 THEN 'degraded' ELSE 'unhealthy' END AS status, CAST(round(connectivity) AS BIGINT) AS score,
  CASE WHEN active_recent = 0 THEN 'no nodes reporting' WHEN connectivity < 80 THEN 'nodes have gone offline' ELSE '' END AS issues FROM s
UNION ALL SELECT 'blocks', CASE WHEN blocks >= 80 THEN 'healthy' WHEN blocks >= 50 THEN 'degraded' ELSE 'unhealthy' END, CAST(round(blocks) AS BIGINT),
  concat_ws(';', CASE WHEN author_failed > 0 THEN 'authoring failures' END, CASE WHEN author_tries > 0 AND authored = 0 THEN 'no blocks despite attempts' END) FROM s
UNION ALL SELECT 'da', CASE WHEN da >= 90 THEN 'healthy' WHEN da >= 60 THEN 'degraded' ELSE 'unhealthy' END, CAST(round(da) AS BIGINT), CASE WHEN da_failed > 0 THEN 'shard request failures' ELSE '' END FROM s
UNION ALL SELECT 'packages', CASE WHEN packages >= 90 THEN 'healthy' WHEN packages >= 60 THEN 'degraded' ELSE 'unhealthy' END, CAST(round(packages) AS BIGINT), CASE WHEN wp_failed > 0 THEN 'work package failures' ELSE '' END FROM s
UNION ALL SELECT 'throughput', CASE WHEN throughput >= 80 THEN 'healthy' WHEN throughput >= 50 THEN 'degraded' ELSE 'unhealthy' END, CAST(round(throughput) AS BIGINT), CASE WHEN a_minute = 0 THEN 'no events' WHEN a_minute < 10 THEN 'few events' ELSE '' END FROM s""",
)
def health_components(t, recent: int = DAY, minutes: int = WEEK):
    """A row a component: its status, rounded score and what is wrong."""
    c = F.col
    issues = {
        "connectivity": [(c("active_recent") == 0, "no nodes reporting"), ((c("active_recent") > 0) & (c("connectivity") < 80), "nodes have gone offline")],
        "blocks": [(c("author_failed") > 0, "authoring failures"), ((c("author_tries") > 0) & (c("authored") == 0), "no blocks despite attempts")],
        "da": [(c("da_failed") > 0, "shard request failures")],
        "packages": [(c("wp_failed") > 0, "work package failures")],
        "throughput": [(c("a_minute") == 0, "no events"), ((c("a_minute") > 0) & (c("a_minute") < 10), "few events")],
    }
    row = lambda p: F.struct(F.lit(p).alias("component"), _level(c(p), *_LEVELS[p]).alias("status"), F.round(p).cast("long").alias("score"), F.concat_ws(";", *(F.when(when, text) for when, text in issues[p])).alias("issues"))
    return health_scores(t, recent, minutes).select(F.inline(F.array(*map(row, _LEVELS))))


@query(
    "q37_health_alerts",
    _HEALTH
    + """ SELECT 'critical' AS severity, 'connectivity' AS component, CAST(0 AS BIGINT) AS number FROM s WHERE active_recent = 0 UNION ALL SELECT 'warning', 'block_production', author_failed FROM s WHERE author_failed > 3
UNION ALL SELECT 'warning', 'data_availability', da_failed FROM s WHERE da_failed > 5 UNION ALL SELECT 'warning', 'work_packages', wp_failed FROM s WHERE wp_failed > 0""",
)
def health_alerts(t, recent: int = DAY, minutes: int = WEEK):
    alert = lambda when, severity, component, number: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(component).alias("component"), number.cast("long").alias("number")))
    c = F.col
    rows = F.array(
        alert(c("active_recent") == 0, "critical", "connectivity", F.lit(0)),
        alert(c("author_failed") > 3, "warning", "block_production", c("author_failed")),
        alert(c("da_failed") > 5, "warning", "data_availability", c("da_failed")),
        alert(c("wp_failed") > 0, "warning", "work_packages", c("wp_failed")),
    )
    return health_scores(t, recent, minutes).select(F.explode(F.array_compact(rows)).alias("x")).select("x.*")


@query(
    "q43_anomalies",
    """, f AS (SELECT CAST(sum(event_count) AS BIGINT) AS total, CAST(sum(event_count) FILTER (event_type IN (41, 44, 46, 81, 94, 97, 99, 102, 109, 110, 112, 113)) AS BIGINT) AS failed FROM st, a WHERE bucket > t - INTERVAL 1 DAY),
dropped AS (SELECT node_id, CAST(sum(event_count) AS DOUBLE) AS value FROM st, a WHERE event_type = 0 AND bucket > t - INTERVAL 30 DAY GROUP BY node_id HAVING sum(event_count) > 1),
best AS (SELECT node_id, max(slot) AS slot FROM ev, a WHERE event_type = 11 AND timestamp > t - INTERVAL 30 DAY GROUP BY node_id), top AS (SELECT max(slot) AS top FROM best),
seen AS (SELECT node_id, max(timestamp) AS last_seen FROM ev, a WHERE created_at > t - INTERVAL 1 DAY GROUP BY node_id)
SELECT 'high_failure_rate' AS rule, NULL AS node_id, round(CAST(failed AS DOUBLE) / total, 4) AS value FROM f WHERE total > 100 AND CAST(failed AS DOUBLE) / total > 0.05
UNION ALL SELECT * FROM (SELECT 'dropped_events' AS rule, node_id, value FROM dropped ORDER BY value DESC, node_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'node_behind' AS rule, node_id, CAST(top - slot AS DOUBLE) AS value FROM best, top WHERE top - slot > 10 ORDER BY value DESC, node_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'node_inactive' AS rule, node_id, round((epoch_us(t) - epoch_us(last_seen)) / 1000000.0, 3) AS value FROM seen, a WHERE last_seen < t - INTERVAL 5 MINUTE ORDER BY value DESC, node_id LIMIT 5)""",
)
def anomalies(t, short: int = DAY, long: int = MONTH, silent: int = 5, dropped: int = 1, behind: int = 10, most: int = 5) -> DataFrame:
    """The alerts of all rules: rule, node (null: the network) and value.

    On a live network the windows are minutes and more than ten dropped events are told; the test data are
    sparse, so they are days here.  Nodes are inactive that were seen within the short window, but not of late.
    """
    failed = F.coalesce(F.sum(F.when(_kind(*FAILURES_ANOMALY), F.col("event_count"))), F.lit(0))
    rate = t.stats(short).agg(F.sum("event_count").alias("total"), failed.alias("failed"))
    share = F.col("failed").cast("double") / F.nullif("total", F.lit(0))
    rule = lambda df, name, node, value: df.select(F.lit(name).alias("rule"), node.alias("node_id"), value.alias("value"))
    top = lambda df: df.orderBy(F.desc("value"), "node_id").limit(most)
    high = rule(rate.where((F.col("total") > 100) & (share > 0.05)), "high_failure_rate", F.lit(None).cast("string"), F.round(share, 4))
    lost = t.stats(long).where(_kind(0)).groupBy("node_id").agg(F.sum("event_count").alias("n")).where(F.col("n") > dropped)
    lost = top(rule(lost, "dropped_events", F.col("node_id"), F.col("n").cast("double")))
    best = t.last(long).where(_kind(11)).groupBy("node_id").agg(F.max("slot").alias("slot"))
    late = best.crossJoin(F.broadcast(best.agg(F.max("slot").alias("top")))).where(F.col("top") - F.col("slot") > behind)  # one row
    late = top(rule(late, "node_behind", F.col("node_id"), (F.col("top") - F.col("slot")).cast("double")))
    seen = t.events.where(t.within(short, "created_at")).groupBy("node_id").agg(F.max("timestamp").alias("last_seen"))
    silence = F.round((micros(at(t.as_of)) - micros(F.col("last_seen"))) / 1_000_000.0, 3)
    gone = top(rule(seen.where(F.col("last_seen") < at(t.as_of - timedelta(minutes=silent))), "node_inactive", F.col("node_id"), silence))
    return high.unionByName(lost).unionByName(late).unionByName(gone)


@query(
    "q54_services_totals",
    """, w AS (SELECT l_suppkey AS id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS gas, count(*) FILTER (l_returnflag = 'R') AS done FROM lineitem GROUP BY 1)
SELECT count(*) AS services, count(*) FILTER (coalesce(n, 0) > 0 OR coalesce(done, 0) > 0) AS active_services, CAST(sum(CAST(trunc(s_acctbal) AS BIGINT)) AS BIGINT) AS total_balance,
  coalesce(CAST(sum(n) AS BIGINT), 0) AS total_refinement_count, coalesce(CAST(sum(gas) AS BIGINT), 0) AS total_refinement_gas_used, coalesce(CAST(sum(done) AS BIGINT), 0) AS total_accumulate_count FROM supplier LEFT JOIN w ON id = s_suppkey""",
)
def services(t):
    """Totals over the services that a network reports, and over what they did."""
    return services_totals(t.services).select("services", "active_services", "total_balance", "total_refinement_count", "total_refinement_gas_used", "total_accumulate_count")
