"""Best-fit packing of token sequences with certified repacking.

Documents are tokenised where they lie; only piece lengths and checksums go on.  Short
pieces are dealt by a hash of a stored row number to partitions of at most about
``PART_ITEMS`` pieces.  Each partition is packed by best-fit decreasing, and lower
bounds from dual feasible functions (the volume bound, the threshold functions and
the rounding functions) certify its number of sequences.  Partitions whose number
exceeds the bound (all, where only the sum exceeds the bound of the whole table) exchange
their documents among each other under a new hash, and are packed again; the better of old
and new stays.  More documents leave smaller gaps, so a round deals them over half as many
partitions, down to ``MOST_ITEMS`` pieces each, which bounds a task.  Rounds go on until the
count meets the bound or a round gains nothing.  Only sums of bin counts reach the driver.

Defined cases: a null text is empty and has the end id alone; an empty table packs
into nothing; repeated rows are packed each on its own; pieces of full length are a
sequence by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table, trimming
from .tokens import arrow_rows, lots, word_document_encoder

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Pieces that one task packs at first, and that exchanges bring together in one, about.
PART_ITEMS, MOST_ITEMS = 50_000, 400_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("uid", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in it, number of bins): each item, longest first, goes where the least room stays."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    open_rooms, n = 0, 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that the dual feasible functions give on the number of bins."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same from the number of items of each length, 0 to ``capacity``."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    n_from = np.cumsum(counts[::-1])[::-1]  # items of a size or more
    volume = np.cumsum(counts * sizes)
    for e in range(1, capacity // 2 + 1):  # items over capacity - e count whole, those under e not at all
        large = int(n_from[capacity - e + 1]) if e else 0
        middle = int(volume[capacity - e] - volume[e - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 101):  # x where (k + 1) x / capacity is whole, else rounded down to k-ths
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and uid, a row number for the hash."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = word_document_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 36
        step = 4 * capacity
        for lot in lots(arrow_rows(batches, "i", "t"), lambda r: len(r[1] or "")):
            out: list[tuple] = []
            for doc_id, text in lot:
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), uid))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(trimming(run), _PIECES_SQL)


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (uid, length, part) with bin and offset, and their partition's bins and bound."""

    def run(pdf):
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        return pdf[["uid", "length", "part"]].assign(bin=bins, offset=offsets, bins=n, bound=lower_bound(lengths, capacity))

    return items.select("uid", "length", "part").groupBy("part").applyInPandas(run, "uid long, length long, part long, bin long, offset long, bins long, bound long")


def _totals(packed: DataFrame) -> tuple[int, int, int, int]:
    """(partitions, partitions with a gap, bins, sum of bounds)."""
    by_part = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return tuple(by_part.agg(F.count(F.lit(1)), z(F.sum((F.col("bins") > F.col("bound")).cast("long"))), z(F.sum("bins")), z(F.sum("bound"))).first())


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, most_items: int = MOST_ITEMS) -> DataFrame:
    """``pieces`` (stored; unique uid, length <= capacity) with sequence_id and offset."""
    short = pieces.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for length, many in short.groupBy("length").count().collect():  # a row a length: capacity rows at most
        counts[length] = many
    least, n = bound_of_counts(counts, capacity), int(counts.sum())
    deal = lambda r, k: F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(k)) + F.lit(r << 32)
    best = materialise(_packed(short.withColumn("part", deal(0, max(1, -(-n // part_items)))), capacity), "packed")
    r = 0
    while True:
        n_parts, n_gaps, bins, _ = _totals(best)
        if n_parts < 2 or bins <= least:
            break
        # partitions that are certified each may still not be so together: then all exchange
        gap = F.col("bins") > F.col("bound") if n_gaps > 1 else F.lit(True)
        apart, r = best.where(gap), r + 1
        before, items = _totals(apart)[2], apart.count()
        k = max(-(-(n_gaps if n_gaps > 1 else n_parts) // 2), -(-items // most_items))
        again = materialise(_packed(apart.withColumn("part", deal(r, k)), capacity), "packed")
        gained = _totals(again)[2] < before
        if gained:
            old, best = best, materialise(best.where(~gap).unionByName(again), "packed")
            discard(old)
        discard(again)
        if not gained:
            break
    sequence = F.col("part") * F.lit(1 << 20) + F.col("bin")
    placed = best.select("uid", sequence.alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")})
    return short.join(placed, "uid").unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with the sequence and the offset they are packed to."""
    pieces = materialise(cut(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
