"""Distributed ranks, segmented windows, typed link columns, lookup by id, footers, and pages by continuation."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import joins, ranks, segments
from skein.plans import blocks, packages, search
from skein.sources import footers, links, sinks
from skein.sources.adapter import load, payloads
from skein.sources.payload import packages_of, telemetry

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ranks
@pytest.mark.parametrize("top, low", [(1 << 45, 0), (1 << 52, -(1 << 52)), (1000, 0), (1, 0), (2, -3)])
def test_percentiles_equal_those_of_the_sorted_values(spark, top, low):
    rng = random.Random(top)
    kinds = [lambda: rng.randrange(low, top), lambda: min(top - 1, low + rng.randrange(5)), lambda: top - 1]
    rows = [(k, rng.choice(kinds)()) for k in ("a", "b", None) for _ in range(rng.randrange(1, 200))] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    places = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in ranks.percentiles_cont(df, "v", places, top, ["k"], low=low).collect()}
    near = {r["k"]: r for r in ranks.nearest_ranks(df, "v", places, top, ["k"], low=low).collect()}
    assert set(got) == {k for k, v in rows}
    for k in got:
        values = sorted(v for x, v in rows if x == k and v is not None)
        for name, p in places.items():
            assert got[k][name] == pytest.approx(np.percentile(np.array(values, float), 100 * p), rel=1e-12)
            assert near[k][name] == values[int(np.floor(p * (len(values) - 1) + 0.5))]
        assert near[k]["samples"] == len(values)
    one = ranks.percentiles_cont(df, "v", places, top, scale=8.0, low=low).collect()
    assert len(one) == 1 and one[0]["p50"] == pytest.approx(np.percentile([v / 8 for _, v in rows if v is not None], 50))
    assert tuple(ranks.percentiles_cont(df.where("false"), "v", places, top, low=low).first()) == (None,) * 4


def test_no_window_stands_over_values(spark):
    """One value in most rows, and all others distinct: the counts of a level are what a window sorts."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") * 1_000_003).alias("v"))
    found = ranks.percentiles_cont(df, "v", {"p50": 0.5, "p75": 0.75}, 1 << 35)
    values = sorted([7] * 10_000 + [i * 1_000_003 for i in range(1, 20_000, 2)])
    assert tuple(found.first()) == pytest.approx(tuple(np.percentile(values, [50, 75])))
    assert len(ranks._shifts(1 << 35)) == 2
    plan = plan_of(blocks.block_propagation(load(spark, SF)))
    assert "Window" in plan and "windowspecdefinition(us" not in plan and "windowspecdefinition(_v" not in plan


# segments
def timed_rows(spark, seed):
    """Most rows belong to one key; times repeat and leave segments empty."""
    rng = random.Random(seed)
    start = datetime(2025, 1, 1)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", "c", None]), start + timedelta(seconds=rng.choice([rng.randrange(300), 90_000 + rng.randrange(4000) * 60])), rng.choice([None, rng.randrange(9)])) for i in range(600)]
    return spark.createDataFrame(rows, "i int, k string, ts timestamp_ntz, v int").repartition(4)


@pytest.mark.parametrize("seed, seconds", [(1, 60), (2, 3600), (3, 10**7)])
def test_segmented_windows_equal_plain_ones(spark, seed, seconds):
    df = timed_rows(spark, seed)
    plain = Window.partitionBy("k").orderBy("ts", "i")
    want = {r["i"]: (r["n"], r["before"]) for r in df.select("i", F.row_number().over(plain).alias("n"), F.lag("v").over(plain).alias("before")).collect()}
    numbered = {r["i"]: r["n"] for r in segments.numbered(df, "k", "ts", ["i"], "n", seconds).collect()}
    lagged = {r["i"]: r["before"] for r in segments.lagged(df, "k", "ts", ["i"], "v", "before", seconds).collect()}
    assert {i: (numbered[i], lagged[i]) for i in numbered} == want


@pytest.mark.parametrize("seed, forward", [(1, True), (2, False), (3, True), (4, False)])
def test_as_of_joins_equal_brute_force(spark, seed, forward, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT", 60)
    monkeypatch.setattr(segments.latest_seen, "__defaults__", (60,))
    df = timed_rows(spark, seed).where("k IS NOT NULL")
    left, right = df.where("i % 3 = 0").drop("v"), df.where("i % 3 <> 0").select("k", "ts", F.col("i").alias("j"))
    join = joins.asof_forward if forward else joins.asof_backward
    got = {r["i"]: r["j"] for r in join(left, right, "k", "ts", ["j"]).collect()}
    ls, rs = left.collect(), right.collect()
    for l in ls:
        near = [(abs(r["ts"] - l["ts"]), r["j"]) for r in rs if r["k"] == l["k"] and (r["ts"] > l["ts"] if forward else r["ts"] <= l["ts"])]
        assert got[l["i"]] == (min(near)[1] if near else None)
    assert len(got) == len(ls)


def test_a_hot_key_is_many_tasks(spark):
    key = F.when(F.col("id") % 50 > 0, "hot").otherwise("cold")
    df = spark.range(4000).select(key.alias("k"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    found = segments.numbered(df, "k", "ts", ["i"], "n", 3600)
    assert found.where("k = 'cold' AND n <> i div 50 + 1 OR k = 'hot' AND n <> i - i div 50").count() == 0
    assert re.search(r"row_number\(\) windowspecdefinition\(k#\d+, _seg#", plan_of(found))
    own = df.withColumn("_seg", segments._segment("ts", 3600)).where("k = 'hot'").repartition(8, "k", "_seg")
    assert own.select(F.spark_partition_id()).distinct().count() == 8


def test_rows_with_several_keys(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, None, "c"), (4, None, None), (5, "x", "y"), (5, "x", "b")], "i int, p string, q string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), ("c", 30)], "id string, w int")
    got = sorted((r["i"], r["w"]) for r in joins.either_key_join(left, ["p", "q"], right, "id").collect())
    want = sorted((l["i"], r["w"]) for l in left.collect() for r in right.collect() if r["id"] in (l["p"], l["q"]))
    assert got == want
    assert sorted(r["i"] for r in joins.either_key_semi(left, ["p", "q"], right, "id").collect()) == [1, 2, 3, 5]
    assert sorted(r["i"] for r in joins.either_key_semi(left, ["p"], right, "id").collect()) == [1, 2]


# typed columns and lookup
def test_typed_columns_equal_what_the_bodies_say(spark):
    t = load(spark, SF)
    names = ("timestamp", "node_id", "event_type", "share", "core", "gas", "gas_limit")
    bodies = packages_of(t.payloads.where("event_type IN (92, 94, 95, 101, 102, 105, 109)")).select(*names)
    assert sorted(map(repr, bodies.collect())) == sorted(map(repr, t.typed_packages.select(*names).collect()))
    stored = sinks.ingested(t.bodies)
    assert sorted(map(repr, links.linked(stored).select("event_id", *links.COLUMNS).collect())) == sorted(map(repr, links.linked(t.bodies).select("event_id", *links.COLUMNS).collect()))
    assert "try_variant_get" not in plan_of(links.linked(stored, "share", "core"))


def hour_events(spark, hours=30):
    """Packages of which each is received in an hour of its own and goes on in the next one."""
    t, start = load(spark, SF), F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz")

    def shifted(df):
        later = F.when(F.col("event_type") == 94, 0).otherwise(1)
        return df.where(f"package < {hours}").withColumn("timestamp", start + F.make_dt_interval(hours=(F.col("package") + later).cast("int")))

    return payloads(t.events.where("false"), shifted(t.packages), shifted(t.chain), shifted(t.shards))


def metric(df, name: str) -> list[int]:
    """A metric of the scans of a plan that has run."""
    out = []

    def walk(node):
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            found = node.metrics().get(name)
            out.append(found.get().value() if found.isDefined() else 0)
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_lookup_by_hash_prunes_the_stored_table(spark, tmp_path):
    events = hour_events(spark)
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    for n in range(2):
        for _ in range(2):  # a batch that comes again replaces itself
            sinks.append_events(events.where(F.pmod(F.xxhash64("node_id"), F.lit(2)) == n), path, n, spread=1)
            sinks.append_index(spark, path, index, n)
    stored = spark.read.parquet(path)
    assert stored.count() == events.count()
    lookup = links.Lookup(stored, spark.read.parquet(index))
    for number in (1, 7):
        wanted = f"01{0:046x}{number:016x}"
        found = lookup.received([wanted])
        rows = found.select("timestamp", "node_id", "share").collect()
        want = events.where(F.col("event_type") == 94).where(F.col("data").contains(f'"submission_or_share_id":{number},')).count()
        assert len(rows) == want and all(r["share"] == str(number) for r in rows)
        everything = stored.where("hash IS NOT NULL").select("hash")
        everything.collect()
        if want:
            assert "dynamicpruning" in plan_of(found)
            read = lookup.received([wanted])
            read.collect()
            assert min(metric(read, "numFiles")) < max(metric(everything, "numFiles"))
            steps = sorted(map(tuple, lookup.of_packages([wanted]).select("timestamp", "event_type", "node_id").collect()), key=str)
            t = telemetry(stored, None, [wanted])
            whole = packages.package_events(t).where(F.col("package") == wanted).select("timestamp", "event_type", F.when(~F.col("event_type").isin(112, 113), F.col("node_id")).alias("node_id"))
            assert [s[:2] for s in steps] == sorted((tuple(r)[:2] for r in whole.collect()), key=str)
    pushed = stored.where(F.col("hash") == wanted)
    assert "EqualTo(hash" in plan_of(pushed)


def test_bloom_filters_leave_out_row_groups(spark, tmp_path):
    """Hashes of one file that lie around the one asked for, so only the filter can tell that it is not there."""
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), *(F.lit(None).cast("string").alias(n) for n in links.IDS if n != "hash"))
    rows.coalesce(1).write.options(**links.bloom_options()).parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for name, some in (("there", True), ("nowhere", False)):
        wanted = rows.first()["hash"] if some else "7" * 64
        found = table.where(F.col("hash") == wanted)
        assert len(found.collect()) == some
        assert (metric(found, "numOutputRows")[0] > 0) == some, name


def test_compaction_of_batches(spark, tmp_path):
    t, path = load(spark, SF), str(tmp_path / "events")
    for n in range(4):
        sinks.append_events(t.events.where(F.col("event_id") % 4 == n).drop("user_id"), path, n, spread=1)
    before = sorted(map(repr, spark.read.parquet(path).drop("batch").collect()))
    sinks.compact(spark, path, ["0", "1", "2"], "merged")
    assert sorted(p.name for p in (tmp_path / "events").iterdir() if p.name.startswith("batch")) == ["batch=3", "batch=merged"]
    assert sorted(map(repr, spark.read.parquet(path).drop("batch").collect())) == before
    sinks.finish_compaction(spark, path)  # nothing is left to do
    assert spark.read.parquet(path).count() == len(before)


# footers
def test_footers_tell_rows_bytes_and_bounds(spark, tmp_path, monkeypatch):
    t = load(spark, SF)
    path = str(tmp_path / "t")
    t.events.repartition(5).write.parquet(path)
    table = spark.read.parquet(path)
    for near in (32, 1):
        monkeypatch.setattr(footers, "NEAR", near)
        row = footers.table_figures({"t": table}).first()
        assert (row["name"], row["files"], row["rows"]) == ("t", 5, t.events.count())
        assert row["bytes"] == sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
        assert footers.newest(table, "timestamp") == t.events.agg(F.max("timestamp")).first()[0]


def test_the_model_opens_only_what_a_plan_asks_for(spark, tmp_path):
    t = load(spark, str(tmp_path))  # an empty folder
    assert t.minute_table is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        t.events  # noqa: B018
    with pytest.raises(AttributeError):
        t.nothing  # noqa: B018
    plan = plan_of(search.search_events(load(spark, SF)))
    assert plan.count("FileScan") == 1 and "lineitem" not in plan


# pages
def test_pages_by_continuation(spark, tmp_path):
    t, path = load(spark, SF), str(tmp_path / "e")
    own = t.events.where("event_type IN (11, 40, 94)")
    own.where("event_id < 900").write.parquet(path)
    whole = [r["event_id"] for r in search.search(spark.read.parquet(path), event_types=[11, 40], limit=1000).collect()]
    pages = search.pages(spark.read.parquet(path), limit=7, event_types=[11, 40])
    got = [next(pages)]
    own.where("event_id >= 900").write.mode("append").parquet(path)  # newer events arrive
    late = search.pages(spark.read.parquet(path), limit=7, event_types=[11, 40])
    first = next(late)
    got += list(pages)
    assert [r["event_id"] for p in got for r in p] == whole and all(len(p) <= 7 for p in got)
    assert first[0]["event_id"] >= 900
    last = got[0][-1]
    behind = search.search(spark.read.parquet(path), event_types=[11, 40], limit=1000, after=(last["timestamp"], last["event_id"]))
    assert [r["event_id"] for r in behind.collect()] == whole[7:]
    assert "LessThanOrEqual(timestamp" in plan_of(behind)
