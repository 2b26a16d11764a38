"""Tables that a stream keeps: versions of nodes, rollups by changed buckets, the rolling window of cores, and fan-out by index."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from skein.functions.columns import at
from skein.plans.nodes import fold
from skein.plans.rollups import stats_1h, stats_1m
from skein.sources import stored
from skein.sources.adapter import load
from skein.streaming import core_window, rollup_streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def t(spark):
    return load(spark, SF)


def test_nodes_are_merged_once_by_batch(spark, t, tmp_path):
    table = stored.NodeTable(str(tmp_path / "nodes"))
    with pytest.raises(ValueError, match="no version"):
        table.read(spark)
    batches = [t.events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == n) for n in range(4)]
    held = None
    for number, batch in enumerate(batches):
        assert table.update(batch, number) and not table.update(batch, number)
        if number == 2:
            held = table.read(spark)  # a reader keeps the version that it found
    assert not table.update(batches[0], 1)
    assert rows(table.read(spark)) == rows(fold(t.events))
    assert rows(held) == rows(fold(batches[0].unionByName(batches[1]).unionByName(batches[2])))
    folders = [p.name for p in (tmp_path / "nodes").iterdir() if p.name.startswith("version")]
    assert len(folders) == 2
    # a version that was written but not committed is no version
    fold(t.events.limit(1)).write.parquet(str(tmp_path / "nodes" / "version-9-lost"))
    assert rows(table.read(spark)) == rows(fold(t.events))
    with pytest.raises(RuntimeError, match="by another"):
        table.notes.commit(spark, 3, {"folder": "x", "batch": 9})


def test_a_late_event_rewrites_one_bucket(spark, t, tmp_path):
    source = t.events.where("event_id <> 500")
    late = t.events.where("event_id = 500")
    table = stored.ChangedBuckets.minutes(str(tmp_path / "m"))
    assert rows(table.read(source)) == []  # nothing has been noted
    table.touched(source, 0)
    assert rows(table.read(source)) == rows(stats_1m(source))  # all pending
    assert table.refresh(source, t.as_of + timedelta(minutes=3)) == source.select(F.date_trunc("minute", "timestamp")).distinct().count()
    assert rows(table.read(source)) == rows(stats_1m(source))
    for _ in range(2):
        table.touched(late, 1)
    assert rows(table.read(t.events)) == rows(stats_1m(t.events))  # pending, from the source
    assert table.refresh(t.events, t.as_of + timedelta(minutes=3)) == 1
    written = spark.read.parquet(str(tmp_path / "m" / "data" / "refresh=1"))
    assert written.select("bucket").distinct().count() == 1
    assert rows(table.read(t.events)) == rows(stats_1m(t.events))
    assert table.refresh(t.events, t.as_of + timedelta(minutes=3)) == 0
    table.compact(spark)
    assert [p.name for p in (tmp_path / "m" / "data").iterdir() if p.name.startswith("refresh")] == ["refresh=3"]
    assert rows(table.read(t.events)) == rows(stats_1m(t.events))


def test_the_policy_leaves_buckets_pending(spark, t, tmp_path):
    table, as_of = stored.ChangedBuckets.minutes(str(tmp_path / "m")), t.as_of
    table.touched(t.events, 0)
    half = table.refresh(t.events, as_of - timedelta(days=10), timedelta(minutes=1), timedelta(days=8))
    minutes = t.events.select(F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("b")).distinct()
    inside = minutes.where((F.col("b") >= at(as_of - timedelta(days=18))) & (F.col("b") <= at(as_of - timedelta(days=10, minutes=2)))).count()
    assert half == inside > 0
    assert rows(table.read(t.events)) == rows(stats_1m(t.events))
    since = as_of.replace(second=0, microsecond=0) - timedelta(days=12)
    assert rows(table.read(t.events, since)) == rows(stats_1m(t.events).where(F.col("bucket") >= at(since)))
    assert table.refresh(t.events, as_of + timedelta(minutes=3)) == minutes.count() - inside


def test_hours_follow_changed_minutes(spark, t, tmp_path):
    minutes, hours = stats_1m(t.events), stored.ChangedBuckets.hours(str(tmp_path / "h"))
    hours.touched(minutes, 0)
    assert hours.refresh(minutes, t.as_of, timedelta(hours=1)) > 0
    assert rows(hours.read(minutes)) == rows(stats_1h(minutes))


def test_a_stream_fills_the_store_once(spark, t, tmp_path):
    for part in range(3):
        t.events.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = stored.EventStore(str(tmp_path / "store"), partitions=("event_date",))
    q = stream.writeStream.foreachBatch(store.add).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    store.add(t.events.where("false"), 3)  # a batch may be empty
    assert store.events(spark).count() == t.events.count() and rows(store.minutes.read(store.events(spark))) == rows(stats_1m(t.events))
    assert store.nodes.read(spark).agg(F.sum("total_events")).first()[0] == t.events.count()
    store = stored.EventStore(str(tmp_path / "store2"), partitions=("event_date",))
    for number in (0, 1, 1):
        store.add(t.events.where(f"event_id % 2 = {number}"), number)
        store.minutes.refresh(store.events(spark), t.as_of)
    assert store.events(spark).count() == t.events.count()
    assert rows(store.nodes.read(spark)) == rows(fold(t.events))
    assert rows(store.minutes.read(store.events(spark))) == rows(stats_1m(t.events))


def test_arrival_numbers_run_on_over_batches(spark, t, tmp_path):
    store = stored.EventStore(str(tmp_path / "store"), partitions=("event_date",))
    told = lambda: {r["event_id"]: r["arrival"] for r in store.events(spark).collect()}
    seen = {}
    for number in (0, 1, 1, 2):  # the second one comes again, in another order of its rows
        batch = t.events.where(F.col("event_id") % 3 == number).where("event_id < 300")
        store.add(batch.repartition(3) if number == 1 else batch, number)
        now = told()
        assert {k: now[k] for k in seen} == seen and sorted(now.values()) == list(range(len(now)))
        seen = now
    by_batch = [[seen[i] for i in range(300) if i % 3 == n] for n in range(3)]
    assert max(by_batch[0]) < min(by_batch[1]) and max(by_batch[1]) < min(by_batch[2])


# cores
def samples_of(spark, seed, n=90, cores=3):
    rng, slot, out = random.Random(seed), 100, []
    for arrival in range(n):
        slot += rng.choice([0, 0, 1, 3])
        for core in range(cores):
            busy = rng.random() < 0.5
            out.append(("s", arrival, slot, core, *(rng.randrange(9) if busy else 0 for _ in range(6))))
    columns = "source string, arrival long, slot long, core_index int, gas_used long, da_load long, popularity int, imports int, extrinsic_count int, extrinsic_size long"
    return out, spark.createDataFrame(out, columns)


def brute_window(samples, blocks):
    out = []
    for core in sorted({s[3] for s in samples}):
        held = []
        for s in sorted(x for x in samples if x[3] == core):
            if not held or held[-1][2] != s[2]:
                held.append(s)
        held = held[-blocks:]
        active = [s for s in held if s[4] or s[5] or s[6]]
        sums = [sum(s[i] for s in held) for i in (4, 5, 7, 8, 9)]
        out.append(("s", core, *sums, sum(s[6] for s in active) / len(active) if active else 0.0, len(active), len(held), active[-1][2] if active else 0))
    return out


@pytest.mark.parametrize("seed, blocks", [(1, 20), (2, 600), (3, 1)])
def test_core_window_batch_and_stream(spark, tmp_path, seed, blocks):
    samples, df = samples_of(spark, seed)
    columns = [c.split(" ")[0] for c in core_window.WINDOW.split(", ")]
    want = brute_window(samples, blocks)
    assert sorted(map(tuple, core_window.core_window(df, blocks).select(*columns).collect())) == [pytest.approx(w) for w in want] or sorted(map(tuple, core_window.core_window(df, blocks).select(*columns).collect())) == want
    if seed > 2:
        return
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(3):
        df.where(f"arrival >= {part} * 30 AND arrival < {part + 1} * 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, number):
        seen.update({(r["source"], r["core_index"]): tuple(r[c] for c in columns) for r in batch.collect()})

    q = core_window.core_window_stream(stream, blocks).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(seen.values()) == want


# fan-out
def test_fan_out_by_index_equals_brute_force(spark):
    rng = random.Random(6)
    nodes = [f"n{i}" for i in range(12)]
    people = [(f"p{i}", rng.choice([None, *nodes]), *rng.choice([(None, None), (40, 47), (42, 42), (0, 255), (None, 90), (100, None), (50, 40)])) for i in range(2048)]
    events = [(i, rng.choice(nodes), rng.choice([0, 10, 40, 42, 47, 62, 94, 128, 191])) for i in range(60)]
    want = sorted((i, p) for i, node, kind in events for p, n, low, high in people if n in (None, node) and (low is None or kind >= low) and (high is None or kind <= high))
    found = rollup_streams.fan_out(spark.createDataFrame(events, "event_id int, node_id string, event_type int"), spark.createDataFrame(people, "subscriber string, node_id string, low int, high int"))
    assert found.columns == ["event_id", "node_id", "event_type", "subscriber"]
    assert sorted((r["event_id"], r["subscriber"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan
