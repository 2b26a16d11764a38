"""Guarantees and data availability."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import checked
from ..functions.columns import at, count_if, ms_between, one_of, ratio
from ..operators.joins import latest_per_key, range_join, range_pair_totals
from .registry import query

MONTH = 30 * 1440


def _kind(*ids):
    return one_of("event_type", ids)


@query(
    "q13_da_stats",
    """, s AS (SELECT node_id, arg_max(k, (timestamp, event_id)) AS num_shards, arg_max(gas, (timestamp, event_id)) AS shard_bytes FROM ev, a WHERE event_type = 10 AND timestamp > t - INTERVAL 30 DAY GROUP BY node_id)
SELECT count(*) AS nodes, CAST(sum(num_shards) AS BIGINT) AS total_shards, CAST(sum(shard_bytes) AS BIGINT) AS total_bytes, round(avg(num_shards), 4) AS avg_shards FROM s""",
)
def da_stats(t, minutes: int = MONTH):
    newest = latest_per_key(t.last(minutes).where(_kind(10)).withColumnsRenamed({"k": "num_shards", "gas": "shard_bytes"}), ["node_id"], [F.col("timestamp"), F.col("event_id")], ["num_shards", "shard_bytes"])
    return newest.agg(F.count(F.lit(1)).alias("nodes"), F.sum("num_shards").alias("total_shards"), F.sum("shard_bytes").alias("total_bytes"), F.round(F.avg("num_shards"), 4).alias("avg_shards"))


@query(
    "q13_da_by_node",
    """SELECT node_id, arg_max(k, (timestamp, event_id)) AS num_shards, max(timestamp) AS reported_at FROM ev, a WHERE event_type = 10 AND timestamp > t - INTERVAL 30 DAY GROUP BY node_id
ORDER BY num_shards DESC NULLS LAST, node_id LIMIT 50""",
)
def da_by_node(t, minutes: int = MONTH, limit: int = 50):
    own = t.last(minutes).where(_kind(10)).groupBy("node_id").agg(F.max_by("k", F.struct("timestamp", "event_id")).alias("num_shards"), F.max("timestamp").alias("reported_at"))
    return own.orderBy(F.desc_nulls_last("num_shards"), "node_id").limit(limit)


@query("q13_preimage_counts", "SELECT event_type, count(*) AS events, count(DISTINCT node_id) AS nodes FROM ev WHERE event_type BETWEEN 190 AND 199 GROUP BY event_type")
def preimage_counts(t):
    return t.events.where(F.col("event_type").between(190, 199)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("node_id").alias("nodes"))


# fixed values
_G = {"built": 105, "sending": 106, "send_failed": 107, "sent": 108, "distributed": 109, "receiving": 110, "receive_failed": 111, "received": 112, "discarded": 113}


@query(
    "q19_guarantee_stats",
    """SELECT count(*) FILTER (event_type = 105) AS built, count(*) FILTER (event_type = 106) AS sending, count(*) FILTER (event_type = 107) AS send_failed, count(*) FILTER (event_type = 108) AS sent,
  count(*) FILTER (event_type = 109) AS distributed, count(*) FILTER (event_type = 110) AS receiving, count(*) FILTER (event_type = 111) AS receive_failed, count(*) FILTER (event_type = 112) AS received,
  count(*) FILTER (event_type = 113) AS discarded, CASE WHEN count(*) FILTER (event_type IN (107, 108)) = 0 THEN '100.00%' ELSE printf('%.2f%%', 100.0 * count(*) FILTER (event_type = 108) / count(*) FILTER (event_type IN (107, 108))) END AS success_rate
FROM ev, a WHERE timestamp > t - INTERVAL 7 DAY""",
)
def guarantee_stats(t, minutes: int = 7 * 1440):
    sent, tried = count_if(_kind(108)), count_if(_kind(107, 108))
    rate = F.when(tried == 0, "100.00%").otherwise(F.format_string("%.2f%%", 100.0 * sent / F.when(tried > 0, tried)))
    return t.last(minutes).agg(*(count_if(_kind(i)).alias(n) for n, i in _G.items()), rate.alias("success_rate"))


@query("q19_guarantees_by_node", "SELECT node_id, count(*) AS guarantees, max(timestamp) AS last_built FROM ev, a WHERE event_type = 105 AND timestamp > t - INTERVAL 7 DAY GROUP BY node_id ORDER BY guarantees DESC, node_id LIMIT 50")
def guarantees_by_node(t, minutes: int = 7 * 1440, limit: int = 50):
    by = t.last(minutes).where(_kind(105)).groupBy("node_id").agg(F.count(F.lit(1)).alias("guarantees"), F.max("timestamp").alias("last_built"))
    return by.orderBy(F.desc("guarantees"), "node_id").limit(limit)


@query("q19_recent_guarantees", "SELECT timestamp, node_id, event_id, event_type, core FROM ev WHERE event_type IN (105, 112, 113) ORDER BY timestamp DESC, event_id DESC LIMIT 50")
def recent_guarantees(t, limit: int = 50):
    return t.events.where(_kind(105, 112, 113)).select("timestamp", "node_id", "event_id", "event_type", "core").orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


_BY_GUARANTOR = """, g AS (
  SELECT node_id, count(*) FILTER (event_type = 105) AS built, count(*) FILTER (event_type = 108) AS accumulated, count(*) FILTER (event_type IN (109, 110)) AS failed,
    count(*) FILTER (event_type = 105 AND timestamp > t - INTERVAL 1 DAY) AS recent, count(DISTINCT core) FILTER (event_type = 105) AS cores, max(timestamp) FILTER (event_type = 105) AS last_guarantee
  FROM ev, a WHERE event_type IN (105, 108, 109, 110) AND timestamp > t - INTERVAL 30 DAY GROUP BY node_id
), m0 AS (
  SELECT node_id, core, count(*) AS n FROM ev, a WHERE event_type = 105 AND timestamp > t - INTERVAL 30 DAY GROUP BY 1, 2
), m AS (
  SELECT node_id, core AS main_core FROM m0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, core) = 1
), r AS (
  SELECT g.*, main_core, round(CAST(CAST(built - failed AS DECIMAL(38, 10)) / built AS DOUBLE), 3) AS success_rate FROM g LEFT JOIN m USING (node_id) WHERE built > 0
)"""


def _by_guarantor(t, minutes: int, recent: int = 1440):
    rows = t.last(minutes).where(_kind(105, 108, 109, 110)).groupBy("node_id").agg(
        count_if(_kind(105)).alias("built"),
        count_if(_kind(108)).alias("accumulated"),
        count_if(_kind(109, 110)).alias("failed"),
        count_if(_kind(105) & t.within(recent)).alias("recent"),
        F.count_distinct(F.when(_kind(105), F.col("core"))).alias("cores"),
        F.max(F.when(_kind(105), F.col("timestamp"))).alias("last_guarantee"),
        F.expr("mode() WITHIN GROUP (ORDER BY CASE WHEN event_type = 105 THEN core END)").alias("main_core"),
    )
    return rows.where("built > 0").withColumn("success_rate", ratio(F.col("built") - F.col("failed"), F.col("built"), 3))


@query("q32_guarantees_by_guarantor", _BY_GUARANTOR + " SELECT node_id, built, accumulated, failed, recent, cores, last_guarantee, main_core, success_rate FROM r")
def guarantees_by_guarantor(t, minutes: int = MONTH):
    return _by_guarantor(t, minutes)


@query(
    "q32_performers",
    _BY_GUARANTOR
    + """ SELECT * FROM (SELECT 'top' AS list, node_id, success_rate, built FROM r ORDER BY built DESC, node_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'bottom' AS list, node_id, success_rate, built FROM r ORDER BY built, node_id DESC LIMIT 5)""",
)
def performers(t, minutes: int = MONTH, n: int = 5):
    rows = _by_guarantor(t, minutes).select("node_id", "success_rate", "built")
    top = rows.orderBy(F.desc("built"), "node_id").limit(n)
    bottom = rows.orderBy("built", F.desc("node_id")).limit(n)
    columns = ["list", "node_id", "success_rate", "built"]
    return top.withColumn("list", F.lit("top")).select(columns).unionByName(bottom.withColumn("list", F.lit("bottom")).select(columns))


_OPS = (121, 123, 124)


@query(
    "q28_da_stats_enhanced",
    """, pr AS (SELECT bd.* FROM bd, a WHERE timestamp > t - INTERVAL 7 DAY), sh AS (SELECT bd.* FROM bd, a WHERE event_type = 123 AND timestamp > t - INTERVAL 30 DAY),
so AS (SELECT node_id, count(*) FILTER (event_type = 121) AS read_ops, count(*) FILTER (event_type = 123) AS write_ops, count(*) FILTER (event_type = 124) AS transfers,
  coalesce(sum(bytes) FILTER (event_type = 123), 0) AS bytes_written, coalesce(sum(bytes) FILTER (event_type = 124), 0) AS bytes_transferred FROM pr WHERE event_type IN (121, 123, 124) GROUP BY node_id),
po AS (SELECT node_id, count(*) FILTER (event_type = 190) AS announced, count(*) FILTER (event_type = 192) AS pooled FROM pr WHERE event_type IN (190, 191, 192) GROUP BY node_id),
lc AS (SELECT r.node_id, avg((epoch_us(x.timestamp) - epoch_us(r.timestamp)) / 1000.0) AS ms FROM pr r JOIN bd x ON x.node_id = r.node_id AND x.event_type = 124 AND x.timestamp > r.timestamp AND x.timestamp < r.timestamp + INTERVAL 1 DAY WHERE r.event_type = 121 GROUP BY 1),
cs AS (SELECT node_id, count(DISTINCT shard) AS num_shards, sum(bytes) AS shard_size_bytes FROM sh GROUP BY 1),
j AS (SELECT coalesce(so.node_id, po.node_id, cs.node_id) AS node_id, coalesce(num_shards, 0) AS num_shards, coalesce(shard_size_bytes, 0) AS shard_size_bytes, coalesce(announced, 0) AS preimages_announced, coalesce(pooled, 0) AS preimages_in_pool,
  coalesce(read_ops, 0) AS read_ops, coalesce(write_ops, 0) AS write_ops, coalesce(ms, 0) AS ms, coalesce(transfers, 0) AS transfers, coalesce(bytes_written, 0) AS bytes_written, coalesce(bytes_transferred, 0) AS bytes_transferred
  FROM so FULL JOIN po ON so.node_id = po.node_id FULL JOIN lc ON coalesce(so.node_id, po.node_id) = lc.node_id FULL JOIN cs ON coalesce(so.node_id, po.node_id) = cs.node_id WHERE coalesce(so.node_id, po.node_id, cs.node_id) IS NOT NULL),
k AS (SELECT *, CASE WHEN read_ops > 0 THEN round(CAST(CAST(transfers AS DECIMAL(38, 10)) / read_ops AS DOUBLE), 3) ELSE 1 END AS transfer_success_rate FROM j)
SELECT node_id, num_shards, CAST(shard_size_bytes AS BIGINT) AS shard_size_bytes, preimages_announced, preimages_in_pool, read_ops, write_ops, round(ms, 3) AS avg_read_latency_ms, transfer_success_rate,
  CAST(bytes_written AS BIGINT) AS bytes_written, CAST(bytes_transferred AS BIGINT) AS bytes_transferred,
  CASE WHEN transfer_success_rate >= 0.9 AND read_ops + write_ops > 0 THEN 'healthy' WHEN transfer_success_rate >= 0.5 OR read_ops + write_ops > 0 THEN 'degraded' ELSE 'unhealthy' END AS health FROM k""",
)
def registered_da_stats(t):
    return da_stats_enhanced(t, 7 * 1440, MONTH, 86_400)  # a node of the test tables has an event in hours


@checked
def da_stats_enhanced(t, minutes: int = 60, longer: int = 1440, seconds: int = 10):
    """What each node reads, writes and serves of shards and preimages in a window, the shards that it stored in a longer one, and the
    mean time from a request to the transfers that follow within some seconds; one aggregation over the windows' events."""
    recent, own = t.within(minutes), t.linked((*_OPS, 190, 191, 192), "shard", "bytes").where(t.within(max(minutes, longer)))
    counted = lambda when: F.coalesce(F.count_if(when), F.lit(0))
    many = lambda i: counted(_kind(i) & recent)
    size = lambda when: F.coalesce(F.sum(F.when(when, F.col("bytes"))), F.lit(0))
    kept = _kind(123) & t.within(longer)
    by = own.where(recent | kept).groupBy("node_id").agg(
        F.count_distinct(F.when(kept, F.col("shard"))).alias("num_shards"),
        size(kept).alias("shard_size_bytes"),
        many(190).alias("preimages_announced"),
        many(192).alias("preimages_in_pool"),
        many(121).alias("read_ops"),
        many(123).alias("write_ops"),
        many(124).alias("_transfers"),
        size(_kind(123) & recent).alias("bytes_written"),
        size(_kind(124) & recent).alias("bytes_transferred"),
    )
    near = t.last(minutes).select("node_id", "timestamp", "event_type")
    pairs = range_join(near.where(_kind(121)).drop("event_type"), near.where(_kind(124)), "node_id", "timestamp", seconds, {})
    latency = pairs.groupBy("node_id").agg(F.avg(ms_between(F.col("right_ts"), F.col("timestamp"))).alias("_ms"))
    rate = F.when(F.col("read_ops") > 0, ratio(F.col("_transfers"), F.col("read_ops"), 3)).otherwise(1.0)
    rows = by.join(latency, "node_id", "left").withColumns({"avg_read_latency_ms": F.round(F.coalesce("_ms", F.lit(0.0)), 3), "transfer_success_rate": rate})
    used = F.col("read_ops") + F.col("write_ops") > 0
    health = F.when((F.col("transfer_success_rate") >= 0.9) & used, "healthy").when((F.col("transfer_success_rate") >= 0.5) | used, "degraded").otherwise("unhealthy")
    return rows.withColumn("health", health).drop("_transfers", "_ms")


@query(
    "q28_shard_distribution",
    """SELECT shard AS shard_index, count(*) AS total_ops, count(*) FILTER (event_type = 120) AS requests_sent, count(*) FILTER (event_type = 124) AS requests_received, count(DISTINCT node_id) AS nodes
FROM bd, a WHERE event_type IN (120, 124) AND timestamp > t - INTERVAL 7 DAY AND shard IS NOT NULL GROUP BY shard""",
)
def shard_distribution(t, minutes: int = 7 * 1440):
    own = t.linked((120, 124), "shard").where(t.within(minutes) & F.col("shard").isNotNull())
    many = lambda i: F.count_if(_kind(i))
    return own.groupBy(F.col("shard").alias("shard_index")).agg(F.count(F.lit(1)).alias("total_ops"), many(120).alias("requests_sent"), many(124).alias("requests_received"), F.count_distinct("node_id").alias("nodes"))


@query(
    "q17_core_guarantees",
    """, g AS (SELECT node_id, timestamp, num_guarantees, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, event_id DESC) AS rn FROM bd WHERE event_type = 10)
SELECT node_id, timestamp, num_guarantees[13] AS guarantees FROM g WHERE rn = 1 AND len(num_guarantees) > 12""",
)
def core_guarantees(t, core: int = 12):
    """What each node's latest status tells of a core, where it tells of that many."""
    newest = latest_per_key(t.linked((10,), "num_guarantees"), ["node_id"], [F.col("created_at"), F.col("event_id")], ["timestamp", "num_guarantees"])
    told = newest.where(F.size("num_guarantees") > core)
    return told.select("node_id", "timestamp", F.get("num_guarantees", F.lit(core)).cast("bigint").alias("guarantees"))


@query(
    "q17_guarantee_history",
    "SELECT date_trunc('hour', timestamp) AS hour, count(*) AS guarantees FROM bd, a WHERE event_type = 105 AND core = 3 AND created_at > t - INTERVAL 30 DAY GROUP BY 1 ORDER BY hour DESC LIMIT 24",
)
def guarantee_history(t, core: int = 3, minutes: int = MONTH, limit: int = 24):
    """Guarantees built for a core by hour, the newest hours."""
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    own = t.linked((105,), "core").where((F.col("core") == core) & t.within(minutes, "created_at"))
    return own.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("guarantees")).orderBy(F.desc("hour")).limit(limit)


@query("q17_recent_guarantors", "SELECT node_id, timestamp, report AS work_report_hash FROM bd WHERE event_type = 105 AND core = 3 ORDER BY created_at DESC, event_id DESC LIMIT 50")
def recent_guarantors(t, core: int = 3, limit: int = 50):
    own = t.linked((105,), "core", "report").where(F.col("core") == core)
    return own.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit).select("node_id", "timestamp", F.col("report").alias("work_report_hash"))


def _exchange(own: DataFrame) -> DataFrame:
    """By node: shards requested (121), stored (123) and served (124), and their bytes."""
    many = lambda i: F.count_if(_kind(i))
    size = lambda i: F.coalesce(F.sum(F.when(_kind(i), F.col("bytes"))), F.lit(0))
    return own.where(_kind(*_OPS)).groupBy("node_id").agg(
        many(121).alias("requested"), size(121).alias("bytes_requested"), many(123).alias("shards_stored"), size(123).alias("da_usage_bytes"), many(124).alias("shards_served"), size(124).alias("bytes_served")
    )


_EXCHANGE = """x AS (SELECT node_id, count(*) FILTER (event_type = 121) AS requested, coalesce(sum(bytes) FILTER (event_type = 121), 0) AS bytes_requested, count(*) FILTER (event_type = 123) AS shards_stored,
  coalesce(sum(bytes) FILTER (event_type = 123), 0) AS da_usage_bytes, count(*) FILTER (event_type = 124) AS shards_served, coalesce(sum(bytes) FILTER (event_type = 124), 0) AS bytes_served
  FROM bd, a WHERE event_type IN (121, 123, 124) AND created_at > t - INTERVAL 30 DAY GROUP BY node_id)"""
_RATIO = "CASE WHEN coalesce({b}, 0) > 0 THEN round(CAST(CAST(coalesce({a}, 0) AS DECIMAL(38, 10)) / {b} AS DOUBLE), 3) ELSE 1 END"
_USED = "coalesce(shards_stored, 0) AS shards_stored, CAST(coalesce(da_usage_bytes, 0) AS BIGINT) AS da_usage_bytes, coalesce(shards_served, 0) AS shards_served, CAST(coalesce(bytes_served, 0) AS BIGINT) AS bytes_served"
_NAMES = ("requested", "bytes_requested", "shards_stored", "da_usage_bytes", "shards_served", "bytes_served")


def _efficiency(stored: str, asked: str):
    return F.when(F.col(asked) > 0, ratio(F.col(stored), F.col(asked), 3)).otherwise(1.0)


@query(
    "q26_core_guarantors",
    f""", g AS (SELECT node_id, count(*) AS guarantees, max(timestamp) AS last_guarantee FROM bd, a WHERE event_type = 105 AND core = 3 AND created_at > t - INTERVAL 30 DAY GROUP BY node_id), {_EXCHANGE}
SELECT g.node_id, guarantees, last_guarantee, {_USED}, {_RATIO.format(a='da_usage_bytes', b='bytes_requested')} AS import_efficiency, {_RATIO.format(a='shards_served', b='requested')} AS export_efficiency FROM g LEFT JOIN x ON x.node_id = g.node_id""",
)
def core_guarantors(t, core: int = 3, minutes: int = MONTH):
    """Who built guarantees for a core, with the shards that they stored and served; both from one pass over the window."""
    own = t.linked((105, *_OPS), "core", "bytes").where(t.within(minutes, "created_at"))
    built = own.where(_kind(105) & (F.col("core") == core)).groupBy("node_id").agg(F.count(F.lit(1)).alias("guarantees"), F.max("timestamp").alias("last_guarantee"))
    rows = built.join(_exchange(own), "node_id", "left").fillna(0, list(_NAMES))
    rows = rows.withColumns({"import_efficiency": _efficiency("da_usage_bytes", "bytes_requested"), "export_efficiency": _efficiency("shards_served", "requested")})
    return rows.drop("requested", "bytes_requested")


@query(
    "q26_core_totals",
    """SELECT coalesce(CAST(sum(bytes) AS BIGINT), 0) AS total_da_bytes, count(DISTINCT node_id) AS active_guarantors FROM bd, a WHERE event_type = 123 AND created_at > t - INTERVAL 30 DAY
AND node_id IN (SELECT node_id FROM bd, a WHERE event_type = 105 AND core = 3 AND created_at > t - INTERVAL 30 DAY)""",
)
def core_totals(t, core: int = 3, minutes: int = MONTH):
    """Bytes stored by a core's guarantors, and how many of them stored any."""
    own = t.linked((105, 123), "core", "bytes").where(t.within(minutes, "created_at"))
    members = own.where(_kind(105) & (F.col("core") == core)).select("node_id").distinct()
    return own.where(_kind(123)).join(members, "node_id", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_da_bytes"), F.count_distinct("node_id").alias("active_guarantors"))


@query(
    "q48_guarantor_activity",
    f""", w AS (SELECT DISTINCT share FROM bd, a WHERE event_type = 94 AND core = 3 AND created_at > t - INTERVAL 30 DAY),
g AS (SELECT node_id, count(*) AS guarantees, max(timestamp) AS last_guarantee FROM bd, a WHERE event_type = 105 AND share IN (SELECT share FROM w) AND created_at > t - INTERVAL 30 DAY GROUP BY node_id), {_EXCHANGE}
SELECT g.node_id, guarantees, last_guarantee, {_USED}, {_RATIO.format(a='shards_stored', b='requested')} AS import_efficiency, {_RATIO.format(a='shards_served', b='requested')} AS export_efficiency FROM g LEFT JOIN x ON x.node_id = g.node_id""",
)
def guarantor_activity(t, core: int = 3, minutes: int = MONTH):
    """Who built guarantees of packages received on a core, linked by submission id, with their exchange of shards."""
    own = t.linked((94, 105, *_OPS), "core", "share", "bytes").where(t.within(minutes, "created_at"))
    packages = own.where(_kind(94) & (F.col("core") == core) & F.col("share").isNotNull()).select("share").distinct()
    built = own.where(_kind(105)).join(packages, "share", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("guarantees"), F.max("timestamp").alias("last_guarantee"))
    rows = built.join(_exchange(own), "node_id", "left").fillna(0, list(_NAMES))
    rows = rows.withColumns({"import_efficiency": _efficiency("shards_stored", "requested"), "export_efficiency": _efficiency("shards_served", "requested")})
    return rows.drop("requested", "bytes_requested")


@query(
    "q48_guarantor_sharing",
    """SELECT node_id AS sender, to_peer AS receiver, count(*) AS transfers, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes_transferred FROM bd, a
WHERE event_type = 124 AND created_at > t - INTERVAL 30 DAY AND to_peer IS NOT NULL GROUP BY 1, 2 ORDER BY transfers DESC, sender, receiver LIMIT 50""",
)
def guarantor_sharing(t, minutes: int = MONTH, limit: int = 50):
    """Who transferred shards to whom, by the peer that the body names."""
    own = t.linked((124,), "to_peer", "bytes").where(t.within(minutes, "created_at") & F.col("to_peer").isNotNull())
    by = own.groupBy(F.col("node_id").alias("sender"), F.col("to_peer").alias("receiver")).agg(F.count(F.lit(1)).alias("transfers"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_transferred"))
    return by.orderBy(F.desc("transfers"), "sender", "receiver").limit(limit)


@query(
    "q48_shard_exchange",
    """SELECT e1.node_id AS sender, e2.node_id AS receiver, count(*) AS transfers, CAST(coalesce(sum(e1.bytes), 0) AS BIGINT) AS bytes_sent FROM bd e1 JOIN bd e2 ON e1.shard = e2.shard AND e2.timestamp < e1.timestamp
  AND e1.timestamp < e2.timestamp + INTERVAL 3 DAY, a WHERE e1.event_type = 124 AND e2.event_type = 121 AND e1.created_at > t - INTERVAL 30 DAY GROUP BY 1, 2""",
)
def registered_exchange(t):
    return shard_exchange(t, MONTH, 3 * 86_400)


@checked
def shard_exchange(t, minutes: int = 60, seconds: int = 10):
    """Transfers of a shard that some node had asked for within the seconds before, by the shard's index, across nodes."""
    asked = t.linked((121,), "shard").where(F.col("shard").isNotNull()).select("shard", "timestamp", F.col("node_id").alias("receiver"))
    asked = asked.where(F.col("timestamp") > at(t.as_of - timedelta(minutes=minutes, seconds=seconds)))
    sent = t.linked((124,), "shard", "bytes").where(t.within(minutes, "created_at") & F.col("shard").isNotNull())
    totals = range_pair_totals(asked, sent.withColumnRenamed("node_id", "sender"), "shard", "timestamp", seconds, "receiver", "sender", "bytes")
    return totals.select("sender", "receiver", F.col("pairs").alias("transfers"), F.col("total").alias("bytes_sent"))
