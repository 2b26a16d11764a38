import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.functions.columns import at
from skein.plans.blocks import block_stats
from skein.plans.rollups import refresh, stats_1h, stats_1m
from skein.sources import sinks
from skein.sources.adapter import load
from skein.streaming import rollup_streams, stateful

SF = "/root/testdata/sf0.001"


def brute(times, budget, window):
    kept, start, used = [], None, 0
    for t in times:
        if start is None or t >= start + window:
            start, used = t, 0
        if used < budget:
            used += 1
            kept.append(t)
    return kept


def arrivals(spark):
    rng = random.Random(5)
    rows = [(f"n{n}", i, t) for n in range(4) for i, t in enumerate(sorted(rng.randrange(5_000_000) for _ in range(300)))]
    return rows, spark.createDataFrame(rows, "node_id string, event_id long, arrival_us long")


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows, df = arrivals(spark)
    expected = sorted((n, t) for n in {r[0] for r in rows} for t in brute([r[2] for r in rows if r[0] == n], 20, 1_000_000))
    assert sorted((r[0], r[2]) for r in stateful.rate_limit(df, 20).collect()) == expected
    for part in range(3):
        df.where(f"arrival_us >= {part} * 2000000 AND arrival_us < {part + 1} * 2000000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.rate_limit_stream(stream, 20).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r[0], r[2]) for r in spark.table("limited").collect()) == expected


def test_rollup_streams(spark, tmp_path):
    events = load(spark, SF).events.selectExpr("CAST(timestamp AS TIMESTAMP) AS timestamp", "node_id", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    minutes = rollup_streams.stats_1m_stream(stream)
    q = minutes.drop("window").writeStream.format("memory").queryName("m1").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("m1").selectExpr("sum(event_count)").first()[0] == events.count()
    q = rollup_streams.stats_1h_stream(minutes).writeStream.format("memory").queryName("h1").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    # the hours that the watermark has not closed stay open
    assert 0.9 * events.count() < spark.table("h1").selectExpr("sum(event_count)").first()[0] <= events.count()


def test_refresh_leaves_buckets_outside_its_window(spark):
    t = load(spark, SF)
    full, as_of = stats_1m(t.events), t.as_of
    half = refresh(t.events, full.limit(0), as_of, timedelta(days=40), timedelta(days=5))
    whole = refresh(t.events, half, as_of, timedelta(days=6), timedelta(days=-1))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, full.collect()))


def test_ring_buffer_and_filters(spark, tmp_path):
    t = load(spark, SF)
    ring = stateful.RingBuffer(str(tmp_path / "ring"), 50)
    ring(t.events.where("event_id < 500"), 0)
    ring(t.events.where("event_id >= 500"), 1)
    newest = sorted(r[0] for r in t.events.select("event_id").orderBy("event_id", ascending=False).limit(50).collect())
    assert sorted(r["event_id"] for r in ring.read(spark).collect()) == newest
    # a restart goes on from the folder, a batch that comes again leaves the same rows, and old turns go
    again = stateful.RingBuffer(str(tmp_path / "ring"), 50)
    again(t.events.where("event_id >= 500"), 1)
    again(t.events.limit(0), 2)
    again(t.events.limit(0), 3)
    assert sorted(r["event_id"] for r in again.read(spark).collect()) == newest and again.turns(spark) == [2, 3]
    assert rollup_streams.filtered(t.events, type_range=(40, 47)).where("event_type NOT BETWEEN 40 AND 47").count() == 0


def test_alerts_are_sent_on_change(spark, tmp_path):
    sent = []
    for rows in ([(1,)], [(1,)], [(2,)], [(2,)]):  # each as after a restart
        stateful.OnChange(lambda df: df, sent.append, str(tmp_path / "last"))(spark.createDataFrame(rows, "x int"), 0)
    assert sent == [[(1,)], [(2,)]]


def test_a_change_beyond_the_rows_sent_is_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful.OnChange, "MOST", 2)
    sent = []
    for last in (7, 8, 8):
        stateful.OnChange(lambda df: df, sent.append, str(tmp_path / "last"))(spark.createDataFrame([(1,), (2,), (3,), (last,)], "x int"), 0)
    assert sent == [[(1,), (2,)]] * 2


def test_changed_slots_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"s{s}", slot, i) for s in range(3) for i, slot in enumerate(rng.choices(range(4), k=200))]
    expected = sorted(r for r in rows if r[2] == 0 or next(x for x in rows if x[0] == r[0] and x[2] == r[2] - 1)[1] != r[1])
    df = spark.createDataFrame(rows, "source string, slot long, arrival long")
    assert sorted(map(tuple, rollup_streams.changed_slots(df).collect())) == expected
    for part in range(4):
        df.where(f"arrival >= {part} * 50 AND arrival < {part + 1} * 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rollup_streams.changed_slots_stream(stream).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("slots").collect())) == expected


def test_fan_out(spark):
    events = spark.createDataFrame([("a", 10), ("a", 42), ("b", 42)], "node_id string, event_type int")
    people = spark.createDataFrame([("all", None, None, None), ("node", "a", None, None), ("range", None, 40, 47)], "subscriber string, node_id string, low int, high int")
    got = rollup_streams.fan_out(events, people).groupBy("subscriber").count().collect()
    assert {r[0]: r[1] for r in got} == {"all": 3, "node": 2, "range": 2}


def test_minute_table(spark, tmp_path):
    t = load(spark, SF)
    table, days = sinks.MinuteStats(str(tmp_path / "m")), [t.as_of - timedelta(days=n) for n in (9, 4, 4, 1)]
    full = sorted(map(tuple, stats_1m(t.events).collect()))
    assert table.until(spark) is None and sorted(map(tuple, table.read(t.events).collect())) == full
    for day in days:  # a refresh that runs again leaves the same table
        table.refresh(t.events.where(F.col("timestamp") <= at(day)), day)
        assert sorted(map(tuple, table.read(t.events).collect())) == full
    assert table.until(spark) <= days[-1]
    t.minute_table = table
    hours, whole = sinks.HourStats(str(tmp_path / "h")), sorted(map(tuple, stats_1h(stats_1m(t.events)).collect()))
    for day in days[:2]:
        hours.refresh(table.read(t.events), day, lag=timedelta(hours=1))
        assert sorted(map(tuple, hours.read(table.read(t.events)).collect())) == whole and hours.until(spark) <= day
    stored, raw = block_stats(t).collect(), block_stats(load(spark, SF)).collect()
    assert stored == raw


def test_a_trailing_window_of_minutes_reaches_the_scan(spark):
    plan = block_stats(load(spark, SF))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan and "user_id" in scan


def test_upsert_nodes(spark):
    d = lambda n: datetime(2025, 1, n)
    schema = "node_id string, peer_id string, connected_at timestamp, disconnected_at timestamp, last_seen_at timestamp, is_connected boolean, event_count long"
    nodes = spark.createDataFrame([("a", "pa", d(1), None, d(1), True, 5), ("b", "pb", d(1), d(2), d(2), False, 7)], schema)
    changes = spark.createDataFrame([("a", "disconnect", d(3), None, 0), ("b", "connect", d(4), "other", 0), ("b", "count", d(5), None, 3), ("c", "connect", d(6), "pc", 0)], "node_id string, kind string, at timestamp, peer_id string, events long")
    got = {r["node_id"]: r for r in sinks.upsert_nodes(nodes, changes).collect()}
    assert (got["a"]["is_connected"], got["a"]["disconnected_at"], got["a"]["event_count"]) == (False, d(3), 5)
    assert (got["b"]["is_connected"], got["b"]["peer_id"], got["b"]["connected_at"], got["b"]["event_count"]) == (True, "pb", d(1), 10)
    assert (got["c"]["is_connected"], got["c"]["peer_id"]) == (True, "pc")


def test_event_table_and_retention(spark, tmp_path):
    t = load(spark, SF)
    path = str(tmp_path / "events")
    sinks.append_events(t.events.where("event_id < 300").drop("user_id"), path, 0)
    for _ in range(2):  # the same batch again
        sinks.append_events(t.events.where("event_id >= 300").drop("user_id"), path, 1)
    assert spark.read.parquet(path).count() == t.events.count()
    assert sinks.drop_expired(spark, path, "events", t.as_of) > 0
    assert spark.read.parquet(path).selectExpr("min(event_date)").first()[0] >= (t.as_of - timedelta(days=7)).date()
