"""Windows over a key's rows in time order, cut into segments of time.

A key with most of the rows would be one task of a plain window.  Here a task has a key's rows of one segment; what a segment
needs from those before it (how many rows, the last value) comes from a second, small pass over a row for each
key and segment, which is joined back on the partitioning that the segment's window has anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros

#: Seconds of a segment.
SEGMENT = 6 * 3600


def _segment(ts: str, seconds: int) -> Column:
    return F.floor(micros(F.col(ts)) / F.lit(seconds * 1_000_000))


def _with_carry(rows: DataFrame, key: str, carried: list[Column], before: dict[str, Column]) -> DataFrame:
    """``rows`` (with _seg) beside what the key's other segments carry to theirs: ``carried`` are aggregates of a segment, ``before`` windows over a key's segments."""
    small = rows.groupBy(F.col(key).alias("_key"), F.col("_seg").alias("_at")).agg(*carried).select("_key", "_at", *(c.alias(n) for n, c in before.items()))
    return rows.join(small, rows[key].eqNullSafe(small["_key"]) & (rows["_seg"] == small["_at"]), "left").drop("_key", "_at")


def numbered(df: DataFrame, key: str, ts: str, order: list[str], name: str, seconds: int = SEGMENT) -> DataFrame:
    """``df`` with the number of each row among its key's, in the order of ``ts`` and ``order``, from 1."""
    rows = df.withColumn("_seg", _segment(ts, seconds))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_carry(rows, key, [F.count(F.lit(1)).alias("_n")], {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
    own = F.row_number().over(Window.partitionBy(key, "_seg").orderBy(ts, *order))
    return rows.withColumn(name, own.cast("bigint") + F.col("_before")).drop("_seg", "_before")


def lagged(df: DataFrame, key: str, ts: str, order: list, value: str, name: str, seconds: int = SEGMENT) -> DataFrame:
    """``df`` with the ``value`` of the row before in the order of ``ts`` and ``order`` (columns), null for a key's first."""
    rows = df.withColumn("_seg", _segment(ts, seconds))
    last = F.max_by(F.struct(F.col(value).alias("_v")), F.struct(ts, *order)).alias("_last")
    earlier = Window.partitionBy("_key").orderBy("_at")
    rows = _with_carry(rows, key, [last], {"_before": F.lag("_last").over(earlier)})
    own = Window.partitionBy(key, "_seg").orderBy(ts, *order)
    # a struct, so that a null value is told from no row
    inside = F.lag(F.struct(F.col(value).alias("_v"))).over(own)
    return rows.withColumn(name, F.coalesce(inside, F.col("_before"))["_v"]).drop("_seg", "_before")


def latest_seen(df: DataFrame, key: str, ts: str, order: list[Column], value: str, forward: bool, seconds: int = SEGMENT) -> DataFrame:
    """``df`` with ``value``, where it is null, of the nearest row before (``forward``: after) in ``order`` that has one.

    ``order`` sorts by ``ts``, ascending (``forward``: descending), before all else; a key has one value at a time.
    """
    rows = df.withColumn("_seg", _segment(ts, seconds))
    told = F.when(F.col(value).isNotNull(), F.col(ts))
    edge = (F.min_by if forward else F.max_by)(value, told).alias("_edge")
    earlier = Window.partitionBy("_key").orderBy(F.desc("_at") if forward else F.asc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_carry(rows, key, [edge], {"_before": F.last("_edge", ignorenulls=True).over(earlier)})
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(value, F.coalesce(F.col(value), own, F.col("_before"))).drop("_seg", "_before")
