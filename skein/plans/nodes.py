"""Nodes: their table as a fold of events, and the queries about one or all of them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import checked
from ..functions.columns import at, count_if, one_of
from .registry import query

NODE = "0" * 63 + "7"


def fold(events: DataFrame) -> DataFrame:
    """Nodes from connects, disconnects and counts; totals count every event once."""
    when = lambda ids: F.max(F.when(one_of("event_type", ids), F.col("timestamp")))
    return events.groupBy("node_id").agg(
        F.min("user_id").alias("user_id"), when((23, 26)).alias("connected_at"), when((27,)).alias("disconnected_at"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("total_events")
    )


def fold_nodes(events: DataFrame, dims: DataFrame) -> DataFrame:
    """The node table from the events."""
    return named_nodes(fold(events), dims)


def named_nodes(folded: DataFrame, dims: DataFrame) -> DataFrame:
    """Folded nodes with what their dimension says, and whether they are connected."""
    connected = F.col("connected_at").isNotNull() & (F.col("disconnected_at").isNull() | (F.col("connected_at") > F.col("disconnected_at")))
    named = folded.withColumn("dim", (F.col("user_id") % 25).cast("int")).join(F.broadcast(dims), "dim", "left")  # 25 dimension rows
    return named.select("node_id", "implementation", "region", "connected_at", "disconnected_at", "last_seen", "total_events", connected.alias("is_connected"), "params")


@query("q01_nodes", "SELECT * FROM nodes")
def nodes(t):
    return t.nodes.drop("params").orderBy(F.desc("is_connected"), F.desc("last_seen"), "node_id")


@query(
    "q02_recent_events",
    "SELECT timestamp, node_id, event_id, event_type, implementation FROM ev JOIN nodes USING (node_id) ORDER BY timestamp DESC, event_id DESC LIMIT 50 OFFSET 10",
)
def recent_events(t, limit: int = 50, offset: int = 10):
    """The newest events with what is known of their nodes: from the stored node table, or a fold of those nodes' events only."""
    newest = t.events.select("timestamp", "node_id", "event_id", "event_type").orderBy(F.desc("timestamp"), F.desc("event_id")).offset(offset).limit(limit)
    if t.node_table is not None:
        return newest.join(t.nodes.select("node_id", "implementation"), "node_id")
    few = F.broadcast(newest.select("node_id").distinct())  # ``limit`` rows at most
    return newest.join(fold_nodes(t.events.join(few, "node_id", "left_semi"), t.dims).select("node_id", "implementation"), "node_id")


@query(
    "q03_recent_events_by_node",
    f"SELECT timestamp, node_id, event_id, event_type, implementation FROM ev JOIN nodes USING (node_id) WHERE node_id = '{NODE}' ORDER BY timestamp DESC, event_id DESC LIMIT 50",
)
def recent_events_by_node(t, node_id: str = NODE, limit: int = 50):
    own = t.events.where(F.col("node_id") == node_id)
    info = fold_nodes(own, t.dims).select("node_id", "implementation")
    return own.select("timestamp", "node_id", "event_id", "event_type").orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit).join(F.broadcast(info), "node_id")


@query("q06_node_by_id", f"SELECT * FROM nodes WHERE node_id = '{NODE}'")
def node_by_id(t, node_id: str = NODE):
    return fold_nodes(t.events.where(F.col("node_id") == node_id), t.dims).drop("params")


_STATUS_SQL = f"""SELECT '{NODE}' AS node_id, max(slot) FILTER (event_type = 11) AS best_slot, max(slot) FILTER (event_type = 12) AS finalized_slot,
  arg_max(peer_id, (timestamp, event_id)) FILTER (event_type = 11) AS best_hash, arg_max(k, (timestamp, event_id)) FILTER (event_type = 10) AS num_peers,
  arg_max(k % 2 = 0, (timestamp, event_id)) FILTER (event_type = 13) AS synced, count(*) AS total_events FROM ev WHERE node_id = '{NODE}'"""


@query("q11_node_status", _STATUS_SQL)
def node_status(t, node_id: str = NODE):
    newest = lambda value, kind: F.max_by(F.when(F.col("event_type") == kind, value), F.when(F.col("event_type") == kind, F.struct("timestamp", "event_id")))
    top = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("slot")))
    return t.events.where(F.col("node_id") == node_id).agg(
        F.lit(node_id).alias("node_id"),
        top(11).alias("best_slot"),
        top(12).alias("finalized_slot"),
        newest(F.col("peer_id"), 11).alias("best_hash"),
        newest(F.col("k"), 10).alias("num_peers"),
        newest(F.col("k") % 2 == 0, 13).alias("synced"),
        F.count(F.lit(1)).alias("total_events"),
    )


@query("q11_node_event_types", f"SELECT event_type, count(*) AS events FROM ev WHERE node_id = '{NODE}' GROUP BY 1")
def node_event_types(t, node_id: str = NODE):
    return t.events.where(F.col("node_id") == node_id).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "q12_node_peers",
    f""", own AS (SELECT ev.* FROM ev, a WHERE node_id = '{NODE}' AND timestamp > t - INTERVAL 7 DAY)
SELECT arg_max(k, (timestamp, event_id)) FILTER (event_type = 10) AS total_peers, arg_max(k // 2, (timestamp, event_id)) FILTER (event_type = 10) AS validator_peers,
  greatest(arg_max(k - k // 2, (timestamp, event_id)) FILTER (event_type = 10), 0) AS other_peers, count(DISTINCT peer_id) FILTER (event_type IN (62, 63, 68)) AS stream_peers FROM own""",
)
def node_peers(t, node_id: str = NODE, minutes: int = 7 * 1440):
    newest = lambda value: F.max_by(F.when(F.col("event_type") == 10, value), F.when(F.col("event_type") == 10, F.struct("timestamp", "event_id")))
    half = F.expr("k div 2").cast("int")
    return (
        t.last(minutes)
        .where(F.col("node_id") == node_id)
        .agg(
            newest(F.col("k")).alias("total_peers"),
            newest(half).alias("validator_peers"),
            F.greatest(newest(F.col("k") - half), F.lit(0)).alias("other_peers"),
            F.count_distinct(F.when(one_of("event_type", (62, 63, 68)), F.col("peer_id"))).alias("stream_peers"),
        )
    )


@query("q12_peer_history", f"SELECT timestamp, k AS total_peers, k // 2 AS validator_peers, greatest(k - k // 2, 0) AS other_peers FROM ev WHERE node_id = '{NODE}' AND event_type = 10 ORDER BY created_at DESC, event_id DESC LIMIT 100")
def peer_history(t, node_id: str = NODE, limit: int = 100):
    """The peers that a node reported, newest first."""
    half = F.expr("k div 2").cast("int")
    own = t.events.where((F.col("node_id") == node_id) & (F.col("event_type") == 10)).orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    return own.select("timestamp", F.col("k").alias("total_peers"), half.alias("validator_peers"), F.greatest(F.col("k") - half, F.lit(0)).alias("other_peers"))


@query("q25_node_report", f"""{_STATUS_SQL.replace(" FROM ev WHERE", ", count(*) FILTER (event_type = 105 AND timestamp > t - INTERVAL 30 DAY) AS guarantees_built, count(*) FILTER (event_type = 82 AND timestamp > t - INTERVAL 30 DAY) AS tickets_generated FROM ev, a WHERE")}""")
def node_report(t, node_id: str = NODE):
    """A node's status and its recent activity in one row."""
    return node_status(t, node_id).crossJoin(F.broadcast(node_status_enhanced(t, node_id).select("guarantees_built", "tickets_generated")))  # one row each


@query(
    "q25_node_status_enhanced",
    f""", own AS (SELECT ev.* FROM ev, a WHERE node_id = '{NODE}' AND timestamp > t - INTERVAL 30 DAY),
by_core AS (SELECT core, count(*) AS n FROM own WHERE event_type IN (94, 105) GROUP BY core)
SELECT (SELECT core FROM by_core ORDER BY n DESC, core LIMIT 1) AS assigned_core, (SELECT count(*) FROM by_core) AS cores,
  count(*) FILTER (event_type = 105) AS guarantees_built, count(*) FILTER (event_type = 109) AS guarantees_distributed,
  count(*) FILTER (event_type = 82) AS tickets_generated, max(timestamp) FILTER (event_type = 105) AS last_guarantee FROM own""",
)
def node_status_enhanced(t, node_id: str = NODE, minutes: int = 30 * 1440):
    own = t.last(minutes).where(F.col("node_id") == node_id)
    by_core = own.where(one_of("event_type", (94, 105))).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    assigned = by_core.agg(F.max_by("core", F.struct("n", -F.col("core"))).alias("assigned_core"), F.count(F.lit(1)).alias("cores"))
    kind = lambda i: F.col("event_type") == i
    activity = own.agg(
        count_if(kind(105)).alias("guarantees_built"),
        count_if(kind(109)).alias("guarantees_distributed"),
        count_if(kind(82)).alias("tickets_generated"),
        F.max(F.when(kind(105), F.col("timestamp"))).alias("last_guarantee"),
    )
    return assigned.crossJoin(F.broadcast(activity))  # one row each


_TIMELINE = f""", own AS (SELECT *, CASE WHEN event_type BETWEEN 10 AND 13 THEN 'status' WHEN event_type BETWEEN 20 AND 28 THEN 'connection' WHEN event_type BETWEEN 40 AND 47 THEN 'blockAuthoring'
  WHEN event_type BETWEEN 60 AND 68 THEN 'blockAnnouncement' WHEN event_type BETWEEN 80 AND 84 THEN 'tickets' WHEN event_type BETWEEN 90 AND 101 THEN 'workPackage' WHEN event_type BETWEEN 102 AND 113 THEN 'guarantee'
  WHEN event_type BETWEEN 120 AND 125 THEN 'shard' WHEN event_type BETWEEN 126 AND 131 THEN 'assurance' WHEN event_type BETWEEN 140 AND 153 THEN 'bundleShard' WHEN event_type BETWEEN 160 AND 178 THEN 'segment'
  WHEN event_type BETWEEN 190 AND 199 THEN 'preimage' ELSE 'other' END AS category FROM ev, a WHERE node_id = '{NODE}' AND created_at >= t - INTERVAL 30 DAY AND created_at <= t)"""


def _timeline(t, node_id: str, start: datetime | None, end: datetime | None) -> DataFrame:
    from .search import category

    own = t.events.where(F.col("node_id") == node_id)
    if start is not None:
        own = own.where(F.col("created_at") >= at(start))
    if end is not None:
        own = own.where(F.col("created_at") <= at(end))
    return own.withColumn("category", category(F.col("event_type")))


@query("q51_node_timeline", _TIMELINE + " SELECT created_at, timestamp, event_id, event_type, category FROM own WHERE category IN ('blockAuthoring', 'workPackage', 'guarantee') ORDER BY created_at DESC, event_id DESC LIMIT 100")
def registered_timeline(t):
    return node_timeline(t, start=t.as_of - timedelta(days=30), end=t.as_of, categories=("blockAuthoring", "workPackage", "guarantee"))


@checked
def node_timeline(t, node_id: str = NODE, start: datetime | None = None, end: datetime | None = None, categories: tuple[str, ...] | None = None, limit: int = 100):
    """A node's events, newest first; each criterion that is None is not applied."""
    own = _timeline(t, node_id, start, end)
    chosen = own.where(F.col("category").isin(*categories)) if categories else own
    return chosen.select("created_at", "timestamp", "event_id", "event_type", "category").orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


@query("q51_timeline_categories", _TIMELINE + " SELECT category, count(*) AS events FROM own GROUP BY category")
def timeline_categories(t, node_id: str = NODE):
    own = _timeline(t, node_id, t.as_of - timedelta(days=30), t.as_of)
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("events"))
