"""Block production and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import count_if, micros, one_of
from ..operators.ranks import percentiles_cont
from .registry import query

WEEK = 7 * 1440


@query(
    "q04_stats",
    """SELECT count(*) FILTER (event_type = 42) AS blocks_authored, max(slot) FILTER (event_type = 11 AND timestamp > t - INTERVAL 1 DAY) AS best_slot,
  max(slot) FILTER (event_type = 12 AND timestamp > t - INTERVAL 1 DAY) AS finalized_slot FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY""",
)
def stats(t, minutes: int = WEEK):
    day = t.within(1440)
    return t.last(minutes).agg(
        count_if(F.col("event_type") == 42).alias("blocks_authored"),
        F.max(F.when((F.col("event_type") == 11) & day, F.col("slot"))).alias("best_slot"),
        F.max(F.when((F.col("event_type") == 12) & day, F.col("slot"))).alias("finalized_slot"),
    )


# fixed values
_COUNTS = {"authoring": 40, "authoring_failed": 41, "authored": 42, "importing": 43, "verification_failed": 44, "verified": 45, "execution_failed": 46, "executed": 47, "best_block_changes": 11, "finalized_block_changes": 12}


@query(
    "q10_block_stats",
    """, c AS (SELECT event_type, CAST(sum(event_count) AS BIGINT) AS n FROM st, a WHERE bucket > t - INTERVAL 7 DAY GROUP BY 1), v AS (SELECT coalesce(max(n), 0) AS n, y FROM (VALUES (40), (41), (42), (43), (44), (45), (46), (47), (11), (12)) z(y) LEFT JOIN c ON event_type = y GROUP BY y)
SELECT max(n) FILTER (y = 40) AS authoring, max(n) FILTER (y = 41) AS authoring_failed, max(n) FILTER (y = 42) AS authored, max(n) FILTER (y = 43) AS importing, max(n) FILTER (y = 44) AS verification_failed,
  max(n) FILTER (y = 45) AS verified, max(n) FILTER (y = 46) AS execution_failed, max(n) FILTER (y = 47) AS executed, max(n) FILTER (y = 11) AS best_block_changes, max(n) FILTER (y = 12) AS finalized_block_changes FROM v""",
)
def block_stats(t, minutes: int = WEEK):
    """Counts from the one-minute aggregate."""
    total = lambda i: F.coalesce(F.sum(F.when(F.col("event_type") == i, F.col("event_count"))), F.lit(0)).cast("long")
    return t.stats(minutes).agg(*(total(i).alias(n) for n, i in _COUNTS.items()))


@query(
    "q10_authoring_by_node",
    """SELECT node_id, CAST(sum(event_count) FILTER (event_type = 42) AS BIGINT) AS authored, coalesce(CAST(sum(event_count) FILTER (event_type = 41) AS BIGINT), 0) AS failed
FROM st, a WHERE bucket > t - INTERVAL 30 DAY AND event_type IN (41, 42) GROUP BY node_id HAVING sum(event_count) FILTER (event_type = 42) > 0 ORDER BY authored DESC, node_id LIMIT 20""",
)
def authoring_by_node(t, minutes: int = 30 * 1440):
    total = lambda i: F.sum(F.when(F.col("event_type") == i, F.col("event_count"))).cast("long")
    by = t.stats(minutes).where(one_of("event_type", (41, 42))).groupBy("node_id")
    return by.agg(total(42).alias("authored"), F.coalesce(total(41), F.lit(0)).alias("failed")).where("authored > 0").orderBy(F.desc("authored"), "node_id").limit(20)


@query("q10_recent_blocks", "SELECT timestamp, node_id, slot, event_id FROM ev WHERE event_type = 42 ORDER BY timestamp DESC, event_id DESC LIMIT 50")
def recent_blocks(t, limit: int = 50):
    return t.events.where("event_type = 42").select("timestamp", "node_id", "slot", "event_id").orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


def _delays(t, minutes: float):
    """Per slot, the delay from one node's first announcement to another's first transfer."""
    first = lambda i, name: t.last(minutes).where(F.col("event_type") == i).groupBy("slot", "node_id").agg(F.min("timestamp").alias(name))
    announced, transferred = first(62, "sent"), first(68, "received").withColumnRenamed("node_id", "receiver")
    pairs = announced.join(transferred, "slot").where("node_id <> receiver AND received > sent")
    return pairs.withColumn("us", micros(F.col("received")) - micros(F.col("sent")))


_DELAYS = """, an AS (SELECT slot, node_id, min(timestamp) AS sent FROM ev, a WHERE event_type = 62 AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2),
tr AS (SELECT slot, node_id AS receiver, min(timestamp) AS received FROM ev, a WHERE event_type = 68 AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2),
dl AS (SELECT *, (epoch_us(received) - epoch_us(sent)) / 1000.0 AS ms FROM an JOIN tr USING (slot) WHERE node_id <> receiver AND received > sent)"""


@query(
    "q31_block_propagation",
    _DELAYS
    + """ SELECT count(*) AS samples, round(avg(ms), 3) AS avg_ms, round(quantile_cont(ms, 0.5), 3) AS p50_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms, round(quantile_cont(ms, 0.99), 3) AS p99_ms
FROM dl WHERE ms > 0 AND ms < 86400000""",
)
def block_propagation(t, minutes: float = 30 * 1440, most_ms: float = 86_400_000):
    """The reference window of one minute would hold no pair in the sparse test data; it is a parameter."""
    near = _delays(t, minutes).where((F.col("us") > 0) & (F.col("us") < int(most_ms * 1000)))
    mean = near.agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.col("us") / 1000.0), 3).alias("avg_ms"))
    ranks = percentiles_cont(near, "us", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, int(most_ms * 1000), scale=1000.0)
    return mean.crossJoin(F.broadcast(ranks.select(*(F.round(c, 3).alias(c) for c in ranks.columns))))  # one row each


@query(
    "q31_propagation_by_node",
    """SELECT node_id, count(*) FILTER (event_type = 62) AS announced, count(*) FILTER (event_type = 68) AS transferred,
  count(DISTINCT slot) FILTER (event_type = 62) AS slots_announced, count(DISTINCT slot) FILTER (event_type = 68) AS slots_transferred FROM ev WHERE event_type IN (62, 68) GROUP BY node_id""",
)
def propagation_by_node(t):
    own = t.events.where(one_of("event_type", (62, 68)))
    slots = lambda i: F.count_distinct(F.when(F.col("event_type") == i, F.col("slot")))
    return own.groupBy("node_id").agg(
        count_if(F.col("event_type") == 62).alias("announced"), count_if(F.col("event_type") == 68).alias("transferred"), slots(62).alias("slots_announced"), slots(68).alias("slots_transferred")
    )
