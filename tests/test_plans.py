"""Every registered plan against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from skein.plans.registry import SQL, bound

SF = "/root/testdata/sf0.001"
PLANS = bound()


def rows(pdf):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr([cell(x) for x in r]) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(PLANS) & set(SQL)))
def test_plan_equals_sql(spark, duck, name):
    got, expected = PLANS[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_every_plan_has_rows(spark):
    """A result that is empty by construction would equal any SQL that is."""
    empty = [name for name in PLANS if PLANS[name](spark, "/root/testdata/sf0.01").isEmpty()]
    assert empty == []


@pytest.mark.parametrize("plan", ["workpackage_journey", "journey_outcomes", "workpackage_journey_enhanced", "journey_timing", "batch_journeys", "audit_progress"])
def test_packages_asked_for_by_table_or_list(spark, plan):
    from skein.plans import packages
    from skein.sources.adapter import load

    t = load(spark, SF)
    ask = getattr(packages, plan)
    wanted = [r["package"] for r in t.audits.select("package").distinct().orderBy("package").limit(7).collect()]
    table = spark.createDataFrame([(w, "other") for w in wanted + wanted[:2] + [-1]], "package long, note string")
    whole = sorted(map(repr, (r for r in ask(t).collect() if r["package"] in wanted)))
    assert whole == sorted(map(repr, ask(t, table).collect())) == sorted(map(repr, ask(t, wanted).collect()))
    assert ask(t, table.where("false")).count() == 0
