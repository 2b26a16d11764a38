"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups (here: equal texts) are sized in Spark.  The law is that shards get nearly equal
bytes.  Every group is scheduled by size, in two layers, since a heap over all groups of
a corpus would be one task:

1. Groups are dealt by hash to cells.  In each cell they go, sorted by size, one after
   another to the least-loaded of the cell's bins through a heap.  A task holds the heap
   only; Spark sorts.  All cells together have ``BINS`` bins for each shard, or one a cell where there are more cells.
2. The bins, sorted by size, go one after another to the least-loaded shard through a
   heap on the driver: ``n_shards * MAX_CELLS`` numbers at most, whatever the input's size.

A group that is larger than the rest of its cell's share has its bin to itself, so large
groups are scheduled as they are; small inputs have fewer groups than bins, and then the
schedule is that of the groups themselves.  Two shards differ by no more than the bin that
was placed last on the larger one; unless a group is larger, that is one part in ``BINS``
of a fair share, about.

A row's slot is its place in its shard.  Shards are numbered in sub-buckets (hash of
the id) whose counts give the offsets, so one shard's rows are never in one task.

Defined cases: a null text has 16 bytes and belongs with empty texts; an empty table
gives an empty result; repeated rows get slots of their own; a group larger than a
fair share fills its shard alone, since groups stay together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carry, materialise, restored, table, text_or_empty
from .tokens import arrow_rows

#: Bins that the driver schedules for each shard, the groups of a cell, about, and the most cells, each with a bin a shard at least.
BINS, CELL_GROUPS, MAX_CELLS = 256, 50_000, 4096
#: Rows that one sub-bucket should number, and the most sub-buckets of a shard.
SLOT_ROWS, MAX_SUBS = 50_000, 4096


def longest_first(sizes: dict, n_shards: int) -> dict:
    """Item -> shard: by falling size (ties: by item) to the shard with the least load (ties: the lower number)."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def bins_of_groups(groups: DataFrame, cells: int, bins: int) -> DataFrame:
    """``groups`` (_group, bytes) with _cell and _bin: each cell's groups by falling size (ties: by group) to its least-loaded bin (ties: the lower)."""
    schema = pa.schema([("_group", pa.binary()), ("bytes", pa.int64()), ("_cell", pa.int32()), ("_bin", pa.int32())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        cell, heap = None, []
        for batch in batches:
            placed = []
            for of, size in arrow_rows([batch], "_cell", "bytes"):
                if of != cell:
                    cell, heap = of, [(0, b) for b in range(bins)]
                load, b = heap[0]
                heapq.heapreplace(heap, (load + size, b))
                placed.append(b)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("_group", "bytes", "_cell")), pa.array(placed, pa.int32())], schema=schema)

    dealt = groups.select("_group", "bytes", F.pmod(F.xxhash64("_group"), F.lit(cells)).cast("int").alias("_cell"))
    dealt = dealt.repartition("_cell").sortWithinPartitions("_cell", F.desc("bytes"), "_group")
    return dealt.mapInArrow(run, "_group binary, bytes long, _cell int, _bin int")


_MADE = ("_size", "_crc32", "_group", "shard", "slot")


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _size, _crc32 and _group of their texts."""
    text = text_or_empty(text_col)
    return docs.select(*(c for c in docs.columns if c not in _MADE), (F.octet_length(text).cast("long") + 16).alias("_size"), F.crc32(text).alias("_crc32"), F.unhex(F.md5(text)).alias("_group"))


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """``docs`` with _size, _crc32, _group, shard and slot; columns of these names are replaced, all others carried along."""
    text = text_or_empty(text_col)
    made = [(F.octet_length(text).cast("long") + 16).alias("_size"), F.crc32(text).alias("_crc32"), F.unhex(F.md5(text)).alias("_group")]
    placed = place(docs.select(carry(docs, *_MADE), F.col(id_col).alias("i"), *made), n_shards, "i", bins, cell_groups)
    return placed.select(*restored(docs, *_MADE), *_MADE)


def place(rows: DataFrame, n_shards: int = 40, id_col: str = "doc_id", bins: int = BINS, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """Sized ``rows`` with shard and slot."""
    if n_shards < 1 or bins < 1 or cell_groups < 1:
        raise ValueError("n_shards, bins and cell_groups must be at least 1")
    spark = rows.sparkSession
    groups = materialise(rows.groupBy("_group").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    cells = max(1, min(MAX_CELLS, -(-n_groups // cell_groups)))
    binned = materialise(bins_of_groups(groups, cells, max(n_shards, n_shards * bins // cells)), "shard-bins")
    # n_shards * max(BINS, MAX_CELLS) rows at most, here and in what is broadcast
    sizes = {(r["_cell"], r["_bin"]): r["bytes"] for r in binned.groupBy("_cell", "_bin").agg(F.sum("bytes").alias("bytes")).collect()}
    shard_of = spark.createDataFrame([(*b, s) for b, s in longest_first(sizes, n_shards).items()], "_cell int, _bin int, shard int")
    sharded_groups = binned.join(F.broadcast(shard_of), ["_cell", "_bin"]).select("_group", "shard")
    # groups of many rows, at most n_shards * BINS, are broadcast: the others have no hot key
    hot = groups.where(F.col("n") * n_shards * bins > n_rows).select("_group")
    hot_shards = materialise(sharded_groups.join(F.broadcast(hot), "_group", "left_semi"), "shard-hot-groups")
    marked = rows.join(F.broadcast(hot_shards), "_group", "left")
    first = marked.where("shard is not null")
    rest = marked.where("shard is null").drop("shard").join(sharded_groups.join(F.broadcast(hot), "_group", "left_anti"), "_group")
    columns = [*rows.columns, "shard"]
    subs = int(min(MAX_SUBS, max(4, n_rows // (n_shards * SLOT_ROWS) + 1)))
    sharded = first.select(*columns).unionByName(rest.select(*columns)).withColumn("_sub", F.pmod(F.xxhash64(id_col, "_group"), F.lit(subs)).cast("int"))
    # n_shards * MAX_SUBS rows at most
    counts = sharded.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_sub").orderBy(id_col, "_group")
    return (
        sharded.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_sub"])
        .withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the sharded rows as Parquet, one folder a shard."""
    assign_shards(docs, n_shards, id_col, text_col).drop("_group").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the texts are read once; ids, sizes and hashes are placed and numbered
    sharded = place(materialise(sized(docs).drop("text"), "shard-rows"), 40)
    return sharded.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
