"""Exact percentiles by distributed rank selection.

Values are whole numbers of a known range, from ``low`` to below ``top``.  Their leading bits are counted first: at most 2^``LEVEL`` counts a key, from
which the bits of each wanted rank follow; then the next bits of the values that begin with those, and so on to the last.  Every
count is a partial aggregation, and a window stands over counts of one level only, never over values, so the
work spreads over tasks however many values a key has and however often one occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a level settles.
LEVEL = 19


def _shifts(top: int) -> list[int]:
    """How far values below ``top`` are shifted at each level."""
    bits = max(1, (top - 1).bit_length())
    levels = -(-bits // LEVEL)
    return [bits - bits * (i + 1) // levels for i in range(levels)]


def _at_ranks(df: DataFrame, value: str, top: int, low: int, places: dict[str, Callable[[Column], Column]], keys: list[str]) -> DataFrame:
    """(keys, _name, _all, _v): the value at each named place of the sorted values of each key; a place is made of their number."""
    shifts = _shifts(top - low)
    begun = lambda shift: F.shiftright(F.col("_v"), shift)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, (F.col(value).cast("bigint") - F.lit(low)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    first = counted.groupBy(*keys, begun(shifts[0]).alias("_b")).agg(F.sum("_n").alias("_n"))
    first = first.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_b")), "_all": F.sum("_n").over(whole)})
    wanted = F.array(*(F.struct(F.lit(name).alias("_name"), place(F.col("_all")).cast("bigint").alias("_place")) for name, place in places.items()))
    found = first.withColumn("_w", F.explode(wanted)).select(*keys, "_b", "_n", "_upto", "_all", "_w.*")
    inside = (F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n"))
    left = (F.col("_place") - (F.col("_upto") - F.col("_n"))).alias("_place")
    found = found.where(inside).select(*keys, "_name", "_all", "_b", left)
    for before, shift in zip(shifts, shifts[1:]):
        known = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_name", "_all", F.col("_b").alias("_begin"), "_place")
        same = begun(before) == F.col("_begin")
        for i, k in enumerate(keys):
            same &= counted[k].eqNullSafe(F.col(f"_k{i}"))
        # without keys as many rows as there are names
        rows = counted.join(known if keys else F.broadcast(known), same).drop(*(f"_k{i}" for i in range(len(keys))))
        next_ = rows.groupBy(*keys, "_name", "_all", "_place", begun(shift).alias("_b")).agg(F.sum("_n").alias("_n"))
        next_ = next_.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_name").orderBy("_b")))
        found = next_.where(inside).select(*keys, "_name", "_all", "_b", left)
    return found.withColumn("_v", F.col("_b") + F.lit(low))


def percentiles_cont(df: DataFrame, value: str, names: dict[str, float], top: int, keys: list[str] | None = None, scale: float = 1.0, low: int = 0) -> DataFrame:
    """Interpolated percentiles, by name, of a column of whole numbers from ``low`` to below ``top``, divided by ``scale``; by ``keys`` (none: one row, null without values)."""
    keys = keys or []
    places = {}
    for name, p in names.items():
        places[f"{name}/low"] = lambda n, p=p: F.floor(F.lit(p) * (n - 1))
        places[f"{name}/high"] = lambda n, p=p: F.ceil(F.lit(p) * (n - 1))
    found = _at_ranks(df, value, top, low, places, keys)
    at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v"))) / F.lit(float(scale))
    place = lambda p: F.lit(p) * (F.max("_all") - 1)
    between = lambda name, p: at(f"{name}/low") + (at(f"{name}/high") - at(f"{name}/low")) * (place(p) - F.floor(place(p)))
    return found.groupBy(*keys).agg(*(between(name, p).alias(name) for name, p in names.items()))


def nearest_ranks(df: DataFrame, value: str, names: dict[str, float], top: int, keys: list[str], scale: float = 1.0, low: int = 0) -> DataFrame:
    """Percentiles by nearest rank (place round(p * (n - 1)), halves away from zero) of a column as above, and the number of samples."""
    found = _at_ranks(df, value, top, low, {name: lambda n, p=p: F.floor(F.lit(p) * (n - 1) + 0.5) for name, p in names.items()}, keys)
    at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v")))
    scaled = lambda name: at(name) if scale == 1.0 else at(name) / F.lit(float(scale))
    return found.groupBy(*keys).agg(F.max("_all").alias("samples"), *(scaled(name).alias(name) for name in names))
