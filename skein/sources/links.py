"""What the bodies of events say, as typed columns: ids that link events, and the numbers that plans count.

A body is an object with one key, the name of its variant, under which its fields lie.  Columns are made where events are taken in (``sinks.append_events`` stores them beside the
body, with Parquet bloom filters on the ids) or, for events without them, as a plan reads them; one that no plan asks for
is not parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wire_format import BODIES

# fixed values: types of the events whose bodies have a field, where others have one of the same name that means something else
WITH_SLOT, WITH_SHARD, WITH_SIZE, WITH_ROOT, WITH_REQUEST = (11, 12, 40, 43, 62, 68), (120, 121, 123, 124), (68, 121, 123, 124), (102, 120, 124), (124, 125)
#: names that some bodies have besides those of the wire format
TYPES = {i: name for i, (name, _) in BODIES.items()}
OTHER_NAMES = {121: "ShardRequested", 123: "ShardStored", 124: "ShardTransferred"}
#: ids by which events are looked up; each has a bloom filter in the stored table
IDS = ("share", "hash", "report", "root", "request")
#: Rows of a file that a bloom filter is laid out for, and folders of the index.
BLOOM_ROWS, BUCKETS = 1_000_000, 64


def inner(types: tuple[int, ...] = ()) -> Column:
    """The object that the variant column ``body`` has under the name of its event's variant; ``types`` are those that occur (none: all).

    Every path is a literal, which is parsed once and not for each row.
    """
    own = {i: n for i, n in TYPES.items() if not types or i in types}
    get = lambda name: f"try_variant_get(body, '$.{name}', 'variant')"
    found = lambda i: f"coalesce({get(OTHER_NAMES[i])}, {get(own[i])})" if i in OTHER_NAMES else get(own[i])
    return F.expr(f"CASE event_type {' '.join(f'WHEN {i} THEN {found(i)}' for i in own)} END")


#: Two lower-case hex digits of each byte value; other numbers are written out.
_HEX = f"array({', '.join(f"'{i:02x}'" for i in range(256))})"
#: Types of whose bodies every field is a path of its own; of more, the object under the variant's name is taken out first.
MOST_PATHS = 24


def _columns(types: tuple[int, ...] = ()) -> dict[str, str]:
    """SQL of the typed columns by name: of the variant ``inner``, or, for events of few known ``types``, of ``body`` by whole paths."""

    def get(path: str, kind: str = "string", only: tuple[int, ...] = ()) -> str:
        if not types:
            return f"try_variant_get(inner, '$.{path}', '{kind}')"
        at = lambda name: f"try_variant_get(body, '$.{name}.{path}', '{kind}')"
        found = lambda i: f"coalesce({at(OTHER_NAMES[i])}, {at(TYPES[i])})" if i in OTHER_NAMES else at(TYPES[i])
        told = [f"WHEN {i} THEN {found(i)}" for i in types if i in TYPES and (not only or i in only)]
        return f"CASE event_type {' '.join(told)} END" if told else f"CAST(NULL AS {kind})"

    def of(only: tuple[int, ...], *paths: str, kind: str = "string", made=lambda value: value) -> str:
        """The first of ``paths`` that events of some types have."""
        return f"CASE WHEN event_type IN ({', '.join(map(str, only))}) THEN {made(f'coalesce({', '.join(get(p, kind, only) for p in paths)})')} END"

    in_hex = lambda array: f"lower(array_join(transform({array}, x -> coalesce(get({_HEX}, x), lpad(hex(x), 2, '0'))), ''))"
    total = lambda array, value: f"aggregate({array}, 0L, (sum, x) -> sum + coalesce(x.{value}, 0L))"
    costs = get("costs", "array<struct<total:struct<gas_used:bigint,elapsed_ns:bigint>>>", (101,))
    cost = lambda name: f"CASE event_type WHEN 95 THEN {get(f'cost.total.{name}', 'bigint', (95,))} WHEN 101 THEN {total(costs, f'total.{name}')} END"
    items = "array<struct<refine_gas_limit:bigint>>"
    return {
        "share": f"coalesce({get('submission_or_share_id')}, {get('submission_id')})",
        "hash": in_hex(f"CASE event_type WHEN 94 THEN {get('outline.work_package_hash', 'array<int>', (94,))} WHEN 93 THEN {get('hash', 'array<int>', (93,))} END"),
        "report": in_hex(get("outline.work_report_hash", "array<int>")),
        "root": in_hex(of(WITH_ROOT, "outline.erasure_root", "erasure_root", kind="array<int>")),
        "request": of(WITH_REQUEST, "request_id"),
        "core": f"coalesce({get('core', 'int')}, {get('outline.core', 'int')})",
        "slot": of(WITH_SLOT, "slot", kind="bigint"),
        "epoch": of((80,), "epoch", kind="bigint"),
        "shard": of(WITH_SHARD, "shard", "shard_index", kind="int"),
        "bytes": of(WITH_SIZE, "size", kind="bigint"),
        "to_peer": of((124,), "to_peer"),
        "gas": cost("gas_used"),
        "elapsed_ns": cost("elapsed_ns"),
        "gas_limit": of((94,), "outline.work_items", kind=items, made=lambda value: total(value, "refine_gas_limit")),
        "package_size": of((94,), "outline.work_package_size", kind="bigint"),
        "num_guarantees": of((10,), "num_guarantees", kind="array<int>"),
        "reason": f"coalesce({get('reason')}, try_variant_get(body, '$.reason', 'string'), try_variant_get(body, '$.error', 'string'))",
    }


COLUMNS = _columns()


def linked(events: DataFrame, *names: str, types: tuple[int, ...] = ()) -> DataFrame:
    """``events`` with the typed columns ``names`` (none: all) of their bodies; those that are stored beside them are taken as they are.

    Of events other than ``types``, where these are named, no column is told.
    """
    wanted = [n for n in names or COLUMNS if n not in events.columns]
    if not wanted:
        return events
    parsed = events.withColumn("body", F.try_parse_json("data"))
    few = tuple(types) if len(types) <= MOST_PATHS else ()
    columns, parsed = (_columns(few), parsed) if few else (COLUMNS, parsed.withColumn("inner", inner(types)))
    return parsed.selectExpr(*(f"`{c}`" for c in events.columns), *(f"{columns[n]} AS {n}" for n in wanted))


def bucket_of(name: str = "id") -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def index_rows(stored: DataFrame) -> DataFrame:
    """Where an id occurs: id, kind, bucket and the date and hour of the partition, a row for each that is distinct."""
    pairs = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("id")) for n in IDS))
    rows = stored.select("event_date", "event_hour", F.explode(pairs).alias("p")).where("p.id IS NOT NULL")
    return rows.select(F.col("p.id").alias("id"), F.col("p.kind").alias("kind"), "event_date", "event_hour").distinct().withColumn("bucket", bucket_of())


class Lookup:
    """Events by id from a stored table and its index, as plans that Spark prunes.

    The index is partitioned by the id's bucket, the events by date and hour.  An id's bucket prunes the index, and the dates and
    hours that it names prune the events, dynamically, as each step is a broadcast of few rows: one for each id and
    partition, of ids that a caller names (``checks.MOST_HASHES`` at most) or that such ids' events name (one a node).
    """

    def __init__(self, events: DataFrame, index: DataFrame):
        self.events, self.index = events, index

    def having(self, kind: str, ids: DataFrame) -> DataFrame:
        """Events that have one of ``ids`` (id) in the column ``kind``."""
        asked = ids.select("id").distinct().withColumn("bucket", bucket_of())
        places = self.index.where(F.col("kind") == kind).join(F.broadcast(asked), ["bucket", "id"]).select("id", "event_date", "event_hour").withColumnRenamed("id", kind)
        return self.events.where(F.col(kind).isNotNull()).join(F.broadcast(places), ["event_date", "event_hour", kind])

    def received(self, hashes: list[str]) -> DataFrame:
        """Events that name one of the hashes; their literals are pushed to the scan, whose bloom filters leave out row groups."""
        spark = self.events.sparkSession
        ids = spark.createDataFrame([(h,) for h in hashes], "id string")
        return self.having("hash", ids).where(F.col("hash").isin(*hashes))

    def of_packages(self, hashes: list[str]) -> DataFrame:
        """All events of the packages: by hash, then by share, by report and root, and by request."""
        first = self.received(hashes)
        named = first.where("share IS NOT NULL").select("hash", "share").distinct()
        only = lambda df, c: df.where(F.col(c).isNotNull()).select(F.col(c).alias("id"))
        own = self.having("share", only(named, "share")).drop("hash").join(F.broadcast(named), "share")
        built = own.where("event_type = 102")
        by = lambda kind, types: self.having(kind, only(built, kind)).where(F.col("event_type").isin(*types)).drop("hash").join(F.broadcast(built.select(kind, "hash").distinct()), kind)
        told, asked = by("report", (112, 113)), by("root", (120, 124))
        requests = asked.where("request IS NOT NULL").select("request", "hash").distinct()
        sent = self.having("request", only(requests, "request")).where("event_type = 125").drop("hash").join(F.broadcast(requests), "request")
        columns = ["hash", "timestamp", "node_id", "event_type", "core", "reason", "gas"]
        out = own.select(columns)
        for more in (told, asked, sent):
            out = out.unionByName(more.select(columns))
        return out


def bloom_options() -> dict[str, str]:
    """Writer options for bloom filters on the ids."""
    options = {}
    for name in IDS:
        options |= {f"parquet.bloom.filter.enabled#{name}": "true", f"parquet.bloom.filter.expected.ndv#{name}": str(BLOOM_ROWS)}
    return options
