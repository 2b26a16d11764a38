"""Plans of packages on rows that the test tables seldom have."""

from datetime import datetime

from skein.plans import packages
from skein.sources.adapter import Telemetry


def _package_rows(spark, *rows):
    return spark.createDataFrame([(p, n, e, datetime(2024, 1, d), 3, 1) for p, n, e, d in rows], "package long, node_id string, event_type int, timestamp timestamp_ntz, core int, gas long")


def test_a_package_received_twice_at_one_moment_is_processed_once(spark):
    rows = _package_rows(spark, (3, "a", 94, 1), (3, "b", 94, 1), (3, "a", 95, 2), (19, "a", 94, 1), (19, "b", 94, 2), (19, "a", 105, 5), (35, "a", 94, 1))
    row = packages.core_processing(Telemetry(packages=rows)).first()
    assert row["completed"] == 3
    assert row["avg_processing_ms"] == (1 + 4 + 3) * 86_400_000 / 3


def test_links_are_parsed_alike_by_whole_paths_and_stored_without_bodies(spark):
    from skein.sources import links, payload

    bodies = [
        (94, '{"WorkPackageReceived":{"submission_or_share_id":7,"core":3,"outline":{"work_package_hash":[1,255,16,300,-1],"work_items":[{"refine_gas_limit":5},{"refine_gas_limit":6}]}}}'),
        (101, '{"Refined":{"submission_or_share_id":"7","costs":[{"total":{"gas_used":4,"elapsed_ns":8}},{"total":{"gas_used":1}}]}}'),
        (102, '{"WorkReportBuilt":{"submission_or_share_id":7,"outline":{"work_report_hash":[2,0],"erasure_root":[3,10]}}}'),
        (92, '{"WorkPackageFailed":{"submission_or_share_id":7,"reason":"refine failed"}}'),
        (113, '{"GuaranteeDiscarded":{"outline":{"work_report_hash":[2,0]},"reason":"Expired"}}'),
        (124, '{"ShardTransferred":{"request_id":9,"erasure_root":[3,10]}}'),
        (124, '{"ShardRequestReceived":{"request_id":9,"erasure_root":[3,10]}}'),
        (105, "no json"),
        (109, None),
        (10, '{"Status":{"reason":"none of a package"}}'),
    ]
    events = spark.createDataFrame([(datetime(2024, 1, 1), "n", kind, data) for kind, data in bodies], "timestamp timestamp_ntz, node_id string, event_type int, data string")
    names = (*payload.PACKAGE_COLUMNS, "request")
    stored = payload.parsed(events)
    assert stored.columns == ["timestamp", "node_id", "event_type", *names]
    whole = links.linked(events.where("event_type <> 10")).select(stored.columns)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, whole.collect()))
    assert stored.where("event_type = 94").first()["hash"] == "01ff1012ff"


def test_pair_totals_over_a_grid_of_cells_equal_the_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skein.operators import joins

    monkeypatch.setattr(joins, "CELL_PAIRS", 50)
    rows = spark.range(300).selectExpr("pmod(xxhash64(id), 3) AS k", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, pmod(xxhash64(id, 1), 900)) AS ts", "IF(id % 10 = 0, NULL, concat('n', id % 13)) AS name", "IF(id % 7 = 0, NULL, id) AS v", "id")
    left, right = rows.where("id % 2 = 0").withColumnRenamed("name", "a"), rows.where("id % 2 = 1 OR id % 10 = 0").withColumnRenamed("name", "b")
    want = joins.range_join(left, right, "k", "ts", 60, {"b": "b", "v": "w"}).groupBy("b", "a").agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0)))
    got = joins.range_pair_totals(left, right, "k", "ts", 60, "a", "b", "v")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert got.columns == ["b", "a", "pairs", "total"]
    none = joins.range_pair_totals(left.where("false"), right, "k", "ts", 60, "a", "b", "v")
    assert none.count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_journeys_shuffle_a_row_a_package_beside_their_steps(spark):
    from skein.sources.adapter import load

    t = load(spark, "/root/testdata/sf0.001")
    assert "Window" not in _plan(packages.batch_journeys(t))  # no number for steps of which only the order counts
    detailed = _plan(packages.workpackage_journey_enhanced(t))
    top = next(line for line in detailed.splitlines() if "Join LeftOuter" in line)
    assert "package" in top and "_node" not in top  # steps meet their core where they lie, by package
