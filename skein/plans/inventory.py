"""Constructs that no catalogue query shows on its own: joins, aggregates and scalar functions, a query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import bytes_to_hex, floor_minutes, hex_to_bytes, micros, ratio, time_bucket
from ..operators.joins import asof_backward, either_key_join, either_key_semi, range_join
from ..operators.ranks import nearest_ranks as ranks_of
from ..operators.ranks import percentiles_cont
from ..operators.segments import lagged
from .registry import query


def _kind(*ids):
    return F.col("event_type").isin(*ids)


@query(
    "jn05_either_key",
    """, l AS (SELECT event_id, CASE WHEN k % 3 < 2 THEN slot END AS k1, CASE WHEN k % 3 > 0 THEN slot + k % 2 END AS k2 FROM ev WHERE event_type = 94), r AS (SELECT slot AS id, count(*) AS n FROM ev WHERE event_type BETWEEN 105 AND 113 GROUP BY 1)
SELECT event_id, id, n FROM l JOIN r ON l.k1 = r.id OR l.k2 = r.id""",
)
def either_key(t):
    """Rows with one key, two equal ones or two that differ."""
    k = F.col("k") % 3
    l = t.events.where(_kind(94)).select("event_id", F.when(k < 2, F.col("slot")).alias("k1"), F.when(k > 0, F.col("slot") + F.col("k") % 2).alias("k2"))
    r = t.events.where(F.col("event_type").between(105, 113)).groupBy(F.col("slot").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return either_key_join(l, ["k1", "k2"], r.withColumn("key", F.col("id")), "key").select("event_id", "id", "n")


@query(
    "jn05_either_key_semi",
    """, l AS (SELECT event_id, slot AS k1, slot + k % 3 AS k2 FROM ev WHERE event_type IN (94, 95)), r AS (SELECT slot AS id FROM ev WHERE event_type BETWEEN 105 AND 113)
SELECT event_id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE l.k1 = r.id OR l.k2 = r.id)""",
)
def either_key_once(t):
    """Rows of which either key is found, each once."""
    l = t.events.where(_kind(94, 95)).select("event_id", F.col("slot").alias("k1"), (F.col("slot") + F.col("k") % 3).alias("k2"))
    return either_key_semi(l, ["k1", "k2"], t.events.where(F.col("event_type").between(105, 113)).select(F.col("slot").alias("id")), "id").select("event_id")


@query(
    "jn08_full_outer_one_row",
    ", d AS (SELECT node_id, count(*) AS n FROM ev WHERE event_type = 82 GROUP BY 1), o AS (SELECT max(slot) AS top, count(*) AS all_events FROM ev) SELECT node_id, n, top, all_events FROM d FULL OUTER JOIN o ON true",
)
def full_outer_one_row(t):
    """Every row beside a one-row aggregate; that row alone where there is no other."""
    rows = t.events.where(_kind(82)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    one = t.events.agg(F.max("slot").alias("top"), F.count(F.lit(1)).alias("all_events"))
    return F.broadcast(one).join(rows, F.lit(True), "left").select("node_id", "n", "top", "all_events")  # one row


@query(
    "jn10_range_join",
    """, l AS (SELECT node_id, event_id, timestamp FROM ev WHERE event_type = 94), r AS (SELECT node_id, event_id AS other, timestamp AS ts FROM ev WHERE event_type = 105)
SELECT l.node_id, event_id, other, timestamp, ts AS right_ts FROM l JOIN r ON l.node_id = r.node_id AND ts > timestamp AND ts < timestamp + INTERVAL 2 DAY""",
)
def interval_pairs(t):
    l = t.events.where(_kind(94)).select("node_id", "event_id", "timestamp")
    return range_join(l, t.events.where(_kind(105)).select("node_id", "event_id", "timestamp"), "node_id", "timestamp", 2 * 86_400, {"event_id": "other"}).select("node_id", "event_id", "other", "timestamp", "right_ts")


@query(
    "jn14_asof_latest",
    """, l AS (SELECT node_id, event_id, timestamp FROM ev WHERE event_type IN (94, 105)), r AS (SELECT node_id, timestamp, k FROM ev WHERE event_type = 10)
SELECT l.node_id, event_id, l.timestamp, CAST(r.k AS DOUBLE) AS k FROM l ASOF LEFT JOIN r ON l.node_id = r.node_id AND l.timestamp >= r.timestamp""",
)
def asof_latest(t):
    """Each event with its node's latest report, null if there is none yet."""
    l = t.events.where(_kind(94, 105)).select("node_id", "event_id", "timestamp")
    return asof_backward(l, t.events.where(_kind(10)).select("node_id", "timestamp", "k"), "node_id", "timestamp", ["k"]).withColumn("k", F.col("k").cast("double"))


@query("jn15_semi_join", "SELECT event_id, node_id FROM ev WHERE event_type = 105 AND node_id IN (SELECT DISTINCT node_id FROM ev WHERE event_type = 94 AND core = 3)")
def semi_join(t):
    members = t.events.where(_kind(94) & (F.col("core") == 3)).select("node_id").distinct()
    return t.events.where(_kind(105)).select("event_id", "node_id").join(members, "node_id", "left_semi")


@query(
    "jn18_latest_by_subquery",
    "SELECT DISTINCT e.node_id, CAST((SELECT max(slot) FROM ev i WHERE i.node_id = e.node_id AND i.event_type = 11) AS DOUBLE) AS best FROM ev e",
)
def latest_by_subquery(t):
    best = t.events.where(_kind(11)).groupBy("node_id").agg(F.max("slot").cast("double").alias("best"))
    return t.events.select("node_id").distinct().join(best, "node_id", "left")


@query(
    "agg10_distinct_arrays",
    """SELECT node_id, array_to_string(list_sort(list_distinct(list(core))), ',') AS cores, min(core) AS first_core, list_sort(list_distinct(list(core)))[1] AS head FROM ev WHERE event_type = 94 GROUP BY node_id""",
)
def distinct_arrays(t):
    cores = F.sort_array(F.collect_set("core"))
    by = t.events.where(_kind(94)).groupBy("node_id").agg(cores.alias("c"), F.min("core").alias("first_core"))
    return by.select("node_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("cores"), "first_core", F.try_element_at("c", F.lit(1)).alias("head"))


@query(
    "agg12_distinct_objects",
    """, d AS (SELECT DISTINCT node_id, core, event_type FROM ev WHERE event_type IN (94, 105)) SELECT node_id, count(*) AS objects, string_agg(core || ':' || event_type, ' ' ORDER BY core, event_type) AS text FROM d GROUP BY node_id""",
)
def distinct_objects(t):
    objects = F.array_sort(F.collect_set(F.struct("core", "event_type")))
    by = t.events.where(_kind(94, 105)).groupBy("node_id").agg(objects.alias("o"))
    return by.select("node_id", F.size("o").cast("long").alias("objects"), F.array_join(F.transform("o", lambda x: F.concat(x["core"].cast("string"), F.lit(":"), x["event_type"].cast("string"))), " ").alias("text"))


@query("agg08_percentile_cont", "SELECT core, quantile_cont(gas, 0.5) AS p50, round(quantile_cont(gas, 0.95), 4) AS p95, bool_or(k > 95) AS any_high FROM ev GROUP BY core")
def percentiles(t):
    """Of a number below 2^24, by rank selection: no task holds a core's values."""
    ranks = percentiles_cont(t.events, "gas", {"p50": 0.5, "p95": 0.95}, 1 << 24, ["core"])
    high = t.events.groupBy("core").agg(F.bool_or(F.col("k") > 95).alias("any_high"))
    return ranks.withColumn("p95", F.round("p95", 4)).join(high, "core")


@query(
    "agg21_nearest_rank",
    """, l AS (SELECT core, list_sort(list(gas)) AS g FROM ev WHERE event_type = 101 GROUP BY core) SELECT core, g[CAST(floor(0.5 * (len(g) - 1) + 0.5) AS INTEGER) + 1] AS p50, g[CAST(floor(0.95 * (len(g) - 1) + 0.5) AS INTEGER) + 1] AS p95 FROM l""",
)
def nearest_ranks(t):
    return ranks_of(t.events.where(_kind(101)), "gas", {"p50": 0.5, "p95": 0.95}, 1 << 24, ["core"]).select("core", "p50", "p95")


@query("win01_lag", "SELECT event_id, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY node_id ORDER BY timestamp, event_id)) AS gap_us FROM ev")
def lag_by_node(t):
    """The time since the node's event before, for all events; a node's events are many tasks."""
    rows = lagged(t.events.select("event_id", "node_id", "timestamp"), "node_id", "timestamp", ["event_id"], "timestamp", "before")
    return rows.select("event_id", (micros(F.col("timestamp")) - micros(F.col("before"))).alias("gap_us"))


@query("jsn05_struct_merge", "SELECT event_id, core AS core, slot + 1 AS slot, 'x' AS note FROM ev WHERE event_type IN (94, 105)")
def struct_merge(t):
    """Fields of a struct replaced, added and dropped."""
    body = F.struct("core", "slot", "gas")
    merged = body.withField("slot", F.col("slot") + 1).withField("note", F.lit("x")).dropFields("gas")
    return t.events.where(_kind(94, 105)).select("event_id", merged.alias("m")).select("event_id", "m.*")


@query("flt07_json_null", "SELECT event_id, k % 3 = 2 AS is_missing, k % 3 <> 0 AS text_is_null FROM ev WHERE event_type IN (94, 105) AND k % 3 <> 2")
def json_null(t):
    """A JSON null is there as a value, though its text is null; what is missing is neither."""
    data = F.when(F.col("k") % 3 == 0, F.lit('{"x":{"y":1}}')).when(F.col("k") % 3 == 1, F.lit('{"x":{"y":null}}')).otherwise(F.lit('{"x":{}}'))
    rows = t.events.where(_kind(94, 105)).select("event_id", F.variant_get(F.parse_json(data), "$.x.y", "variant").alias("v"))
    return rows.where("v IS NOT NULL").select("event_id", F.col("v").isNull().alias("is_missing"), F.is_variant_null("v").alias("text_is_null"))


@query(
    "str01_hex_bytes",
    "SELECT event_id, substr(node_id, 49) AS tail, lower(hex(user_id)) AS hex_id, CAST(('0x' || substr(node_id, 63)) AS INTEGER) AS last_byte, user_id // 256 % 256 AS byte_before FROM ev",
)
def hex_bytes(t):
    """Hex to byte array and back, the bytes taken by position."""
    b = hex_to_bytes(F.col("node_id"))
    rows = t.events.select("event_id", "user_id", b.alias("b"))
    back = bytes_to_hex(F.slice("b", 25, 8))
    return rows.select("event_id", back.alias("tail"), F.lower(F.hex("user_id")).alias("hex_id"), F.get("b", F.lit(31)).alias("last_byte"), F.get("b", F.lit(30)).cast("long").alias("byte_before"))


@query(
    "dt07_time_buckets",
    "SELECT event_id, time_bucket(INTERVAL 7 MINUTE, timestamp, TIMESTAMP '2000-01-03 00:00:00') AS seven, date_trunc('minute', timestamp) - INTERVAL 1 MINUTE * (extract(minute FROM timestamp) % 7) AS floored, CAST(extract(hour FROM timestamp) AS INTEGER) AS hour FROM ev",
)
def time_buckets(t):
    ts = F.col("timestamp")
    return t.events.select("event_id", time_bucket(ts, 420, "2000-01-03 00:00:00").alias("seven"), floor_minutes(ts, 7).alias("floored"), F.hour(ts).alias("hour"))


@query("dt10_parse_time", "SELECT event_id, try_cast(CASE WHEN k % 5 = 0 THEN 'not a time' ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS parsed FROM ev")
def parse_time(t):
    text = F.when(F.col("k") % 5 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.events.select("event_id", F.try_to_timestamp(text).cast("timestamp_ntz").alias("parsed"))


@query("mth01_rounding", "SELECT event_id, round(CAST(CAST(k AS DECIMAL(38, 10)) / nullif(shard, 0) AS DOUBLE), 2) AS ratio, greatest(k, NULL, core) AS most, coalesce(nullif(k, core), -1) AS other, least(greatest(k - 50, 0), 25) AS clamped FROM ev")
def rounding(t):
    k = F.col("k")
    return t.events.select(
        "event_id",
        ratio(k, F.col("shard"), 2).alias("ratio"),
        F.greatest(k, F.lit(None).cast("int"), F.col("core")).alias("most"),
        F.coalesce(F.nullif(k, F.col("core")), F.lit(-1)).alias("other"),
        F.least(F.greatest(k - 50, F.lit(0)), F.lit(25)).alias("clamped"),
    )


@query(
    "jsn01_json_paths",
    """SELECT event_id, CAST(json_extract_string(json_object('Authored', json_object('outline', json_object('slot', slot), 'ids', json_array(k, core))), '$.Authored.outline.slot') AS BIGINT) AS slot,
  core AS second, 2::BIGINT AS n, json_type(json_array(k)) = 'ARRAY' AS is_array, CAST(CASE WHEN event_type = 10 THEN NULL ELSE k END AS DOUBLE) AS nullable FROM ev""",
)
def json_paths(t):
    """A payload built as JSON, read back by path as VARIANT: fields, elements, lengths, types, JSON null."""
    body = F.struct(F.struct(F.struct("slot").alias("outline"), F.array("k", "core").alias("ids")).alias("Authored"))
    text = F.to_json(body)
    v = t.events.select("event_id", F.parse_json(text).alias("v"), F.parse_json(F.when(_kind(10), F.lit('{"x":null}')).otherwise(F.to_json(F.struct(F.col("k").alias("x"))))).alias("x"))
    ids = F.variant_get("v", "$.Authored.ids", "array<int>")
    return v.select(
        "event_id",
        F.variant_get("v", "$.Authored.outline.slot", "bigint").alias("slot"),
        F.get(ids, F.lit(1)).alias("second"),
        F.size(ids).cast("long").alias("n"),
        F.schema_of_variant(F.variant_get("v", "$.Authored.ids", "variant")).startswith("ARRAY").alias("is_array"),
        F.variant_get("x", "$.x", "double").alias("nullable"),
    )


@query(
    "arr01_explode_zip",
    ", z AS (SELECT event_id, unnest([k, core, shard]) AS value, unnest(['k', 'core', 'shard']) AS name FROM ev) SELECT name, count(*) AS rows, CAST(sum(value) AS BIGINT) AS total FROM z GROUP BY name",
)
def explode_zip(t):
    zipped = F.arrays_zip(F.array("k", "core", "shard").alias("value"), F.array(F.lit("k"), F.lit("core"), F.lit("shard")).alias("name"))
    rows = t.events.select(F.explode(zipped).alias("z")).select("z.value", "z.name")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))
