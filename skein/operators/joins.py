"""Joins that Spark has no single operator for, as plans of operators it has."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros
from .segments import latest_seen


def _asof(left: DataFrame, right: DataFrame, key: str, ts: str, take: list[str], forward: bool) -> DataFrame:
    """Both sides go through one segmented window over their union, so the work is one shuffle and one sort, and a key's
    rows spread over tasks by time.  Of right rows at the same time the one with the smallest ``take`` counts."""
    r = right.groupBy(key, ts).agg(F.min(F.struct(*take)).alias("_take"))
    columns = left.columns
    both = left.withColumns({"_take": F.lit(None).cast(r.schema["_take"].dataType), "_side": F.lit(0)}).unionByName(r.select(key, ts, "_take", F.lit(1).alias("_side")), allowMissingColumns=True)
    # forward: newest first, at equal times left before right, so that left rows see later rows only;
    # backward: oldest first, at equal times right before left, so that they see rows up to their own time
    order = [F.desc(ts), F.asc("_side")] if forward else [F.asc(ts), F.desc("_side")]
    found = latest_seen(both, key, ts, order, "_take", forward)
    return found.where("_side = 0").select(*columns, *(F.col(f"_take.{c}").alias(c) for c in take))


def asof_forward(left: DataFrame, right: DataFrame, key: str, ts: str, take: list[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the nearest strictly later row of ``right`` with the same key."""
    return _asof(left, right, key, ts, take, forward=True)


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, take: list[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the latest row of ``right`` with the same key up to its own time."""
    return _asof(left, right, key, ts, take, forward=False)


def range_join(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int, right_columns: dict[str, str]) -> DataFrame:
    """All pairs of equal key with left.ts < right.ts < left.ts + seconds.

    Times are cut into buckets of that width; a left row looks into its own and the next
    one, so the join is an equality on key and bucket and only neighbours are compared.
    """
    width = seconds * 1_000_000
    bucket = lambda c: F.floor(micros(F.col(c)) / F.lit(width))
    l = left.withColumn("_b", F.explode(F.array(bucket(ts), bucket(ts) + 1)))
    r = right.select(F.col(key).alias("_k"), F.col(ts).alias("_rts"), bucket(ts).alias("_rb"), *(F.col(c).alias(a) for c, a in right_columns.items()))
    inside = (micros(F.col("_rts")) > micros(F.col(ts))) & (micros(F.col("_rts")) < micros(F.col(ts)) + width)
    return l.join(r, (l[key] == r["_k"]) & (F.col("_b") == F.col("_rb")) & inside).drop("_b", "_k", "_rb").withColumnRenamed("_rts", "right_ts")


#: Pairs that a cell of ``range_pair_totals`` is laid out for, and that are spread out at a time.
CELL_PAIRS = 1_000_000


def _pairs(early: np.ndarray, late: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (early, late) of all pairs with early < late < early + width of two sorted arrays, about ``CELL_PAIRS`` at a time."""
    low, high = np.searchsorted(early, late - width, "right"), np.searchsorted(early, late, "left")
    n = np.maximum(high - low, 0)
    upto = np.cumsum(n)
    at = 0
    while at < len(late):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELL_PAIRS, "right")))
        own = n[at:end]
        yield np.repeat(low[at:end] - np.cumsum(own) + own, own) + np.arange(own.sum()), np.repeat(np.arange(at, end), own)
        at = end


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, count, sum) of all parts, each key once; exact on integers."""
    keys, counts, sums = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return (keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in (counts, sums)))


def range_pair_totals(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int, left_name: str, right_name: str, value: str) -> DataFrame:
    """Of all pairs of equal key with left.ts < right.ts < left.ts + seconds, by ``right_name`` and ``left_name``: their number
    (pairs) and the sum of ``value`` of the right rows (total; nulls are 0).

    There may be as many such groups as pairs, whose number grows with the square of the rows. They are counted by key and time first;
    the names are then dealt to a grid of cells of about ``CELL_PAIRS`` pairs. A cell is a task's group of rows, no two cells have a group
    in common, and so no group is shuffled and no task holds more than a cell's.
    """
    width = seconds * 1_000_000
    bucket = F.floor(micros(F.col(ts)) / F.lit(width))
    l = left.select(F.col(key).alias("k"), micros(F.col(ts)).alias("t"), F.col(left_name).alias("name"), F.col(ts))
    r = right.select(F.col(key).alias("k"), micros(F.col(ts)).alias("t"), F.col(right_name).alias("name"), F.col(ts), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"))
    sides = l.select("k", F.explode(F.array(bucket, bucket + 1)).alias("b"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(r.select("k", bucket.alias("b"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    most = sides.groupBy("k", "b").agg((F.sum("l") * F.sum("r")).cast("double").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    side = max(1, ceil(sqrt(most / CELL_PAIRS)))
    own = F.pmod(F.xxhash64("name"), F.lit(side))
    others = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    l = l.drop(ts).withColumn("i", own).withColumn("j", others).withColumn("cell", F.col("i") * side + F.col("j")).drop("i", "j")
    r = r.drop(ts).withColumn("j", own).withColumn("i", others).withColumn("cell", F.col("i") * side + F.col("j")).drop("i", "j")

    def run(early: pd.DataFrame, late: pd.DataFrame) -> pd.DataFrame:
        lefts, left_names = pd.factorize(early["name"], use_na_sentinel=False)
        rights, right_names = pd.factorize(late["name"], use_na_sentinel=False)
        early, late = early.assign(name=lefts).sort_values(["k", "t"]), late.assign(name=rights).sort_values(["k", "t"])
        early_of = dict(iter(early.groupby("k")))
        parts, held = [tuple(np.empty(0, np.int64) for _ in range(3))], 0
        for k, b in late.groupby("k"):
            if k not in early_of:
                continue
            a = early_of[k]
            a_name, b_name, b_value = a["name"].to_numpy(np.int64), b["name"].to_numpy(np.int64), b["v"].to_numpy(np.int64)
            for x, y in _pairs(a["t"].to_numpy(np.int64), b["t"].to_numpy(np.int64), width):
                parts.append((b_name[y] * len(left_names) + a_name[x], np.ones(len(x), np.int64), b_value[y]))
                held += len(x)
                if held > 2 * CELL_PAIRS:
                    parts, held = [_added(parts)], 0
        keys, counts, sums = _added(parts)
        return pd.DataFrame({right_name: right_names.take(keys // max(1, len(left_names))), left_name: left_names.take(keys % max(1, len(left_names))), "pairs": counts, "total": sums})

    names = f"`{right_name}` string, `{left_name}` string, pairs long, total long"
    return l.repartition(side * side, "cell").groupBy("cell").cogroup(r.repartition(side * side, "cell").groupBy("cell")).applyInPandas(run, names)


def either_key_join(left: DataFrame, keys: list[str], right: DataFrame, right_key: str) -> DataFrame:
    """left.k1 = right.key OR left.k2 = right.key ...: a row goes to the join under each distinct key that it has.

    A right row has one key, so a pair meets once, also where both keys are equal; the join is a plain hash join.
    """
    spread = left.withColumn("_key", F.explode(F.array_compact(F.array_distinct(F.array(*keys)))))
    return spread.join(right.withColumnRenamed(right_key, "_key"), "_key").drop("_key")


def either_key_semi(left: DataFrame, keys: list[str], right: DataFrame, right_key: str) -> DataFrame:
    """The rows of ``left`` of which any key is one of ``right``'s, each once, whichever and however many of its keys are."""
    if len(keys) == 1:
        return left.join(right.select(F.col(right_key).alias(keys[0])).distinct(), keys[0], "left_semi")
    spread = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.explode(F.array_compact(F.array_distinct(F.array(*keys)))))
    found = spread.join(right.select(F.col(right_key).alias("_key")).distinct(), "_key", "left_semi")
    return found.dropDuplicates(["_row"]).drop("_row", "_key")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Of each key the row that comes first in ``order`` (ascending structs are reversed by max_by, so pass ascending columns)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns))


def time_grid(spark, start, end, minutes: int) -> DataFrame:
    """A row ``bucket`` for every step from start to end, both included; its length is fixed by the two moments."""
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"), step)).alias("bucket"))
