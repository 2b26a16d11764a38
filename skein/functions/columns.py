"""Column helpers for what the analytics queries need and Spark has no single function for."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unix microseconds of the private epoch of the wire format, 2025-01-01T12:00:00Z (fixed value).
EPOCH_MICROS = 1_735_732_800_000_000


def at(moment: datetime) -> Column:
    """A zone-free timestamp literal; comparisons with it reach the Parquet scan."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def node_hex(number: Column) -> Column:
    """64 lower-case hex digits of a number."""
    return F.lower(F.lpad(F.hex(number), 64, "0"))


def bytes_to_hex(array: Column) -> Column:
    """An array of byte values as lower-case hex."""
    return F.lower(F.array_join(F.transform(array, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), ""))


def hex_to_bytes(text: Column) -> Column:
    """Lower- or upper-case hex as an array of byte values; empty for an empty string."""
    steps = F.sequence(F.lit(1), F.length(text) - 1, F.lit(2))
    return F.when(F.length(text) < 2, F.array().cast("array<int>")).otherwise(F.transform(steps, lambda i: F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("int")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ms_between(later: Column, earlier: Column) -> Column:
    """Milliseconds as a double."""
    return (micros(later) - micros(earlier)) / F.lit(1000.0)


def wire_time(offset_micros: Column) -> Column:
    """A timestamp from microseconds since the private epoch."""
    return F.timestamp_micros(offset_micros + F.lit(EPOCH_MICROS))


def floor_minutes(ts: Column, n: int) -> Column:
    """The minute of the hour floored to a multiple of ``n``; 1 <= n <= 60."""
    if not 1 <= n <= 60:
        raise ValueError("n must be between 1 and 60")
    start = F.date_trunc("minute", ts)
    return (start - F.make_dt_interval(mins=(F.minute(start) % n).cast("int"))).cast("timestamp_ntz")


def time_bucket(ts: Column, seconds: int, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the fixed-width bucket, counted from ``origin``, that holds the time."""
    base = F.lit(origin).cast("timestamp")
    width = F.lit(seconds * 1_000_000)
    offset = micros(ts) - F.unix_micros(base)
    return F.timestamp_micros(F.unix_micros(base) + offset - F.pmod(offset, width)).cast("timestamp_ntz")


def ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole rounded half away from zero in decimal arithmetic; null where whole is 0."""
    quotient = part.cast("decimal(38,10)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(quotient, places).cast("double")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round(p * (n - 1)) of the sorted array (halves away from zero); null if empty."""
    place = F.floor(F.lit(p) * (F.size(values) - 1) + 0.5).cast("int")
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), place))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def one_of(column: str, ids) -> Column:
    return F.col(column).isin(*ids)
