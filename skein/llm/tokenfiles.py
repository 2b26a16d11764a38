"""Token ids in binary shards, found by key through a minimal perfect hash.

``shard-00000.ids`` holds nothing but the ids of the shard's documents, one after
another, in ascending order of their keys, as little-endian integers of 16 bits where
the vocabulary allows it, else 32.  ``shard-00000.idx`` holds, as little-endian arrays
behind a fixed head (``HEAD``): the bit levels of the hash, for each of its values a
32-bit fingerprint of the key and the document's number, each document's key and the
token offset at which it starts (one more at the end).  A lookup (``Shard.get``; ``lookup``
for a table of keys over all shards) computes the hash from the bits, a few a key, which
opening a shard reads, and seeks to one fingerprint, one number and two offsets, however
many documents there are; a key that is not there is told by its fingerprint, and by the
stored key itself where two fingerprints agree.

The hash has levels of bits.  On each, the keys that remain hash to twice as many bits;
those alone on their bit are placed, and their value is the number of bits set before it.

Spark range-partitions the documents by key, and each task encodes, hashes and writes
its own shard.  Shards are named by their range, and a task that runs twice writes the
same bytes, so a lost executor costs its shards' rerun only.

Defined cases: a null or empty text has the end id alone; documents without key come
first and are numbered but not hashed; of repeated keys, which are neighbours, the hash
finds the first and the rest follow it; an empty table gives shards without documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, open_store, scratch_path, table, task_write
from .tokens import arrow_rows, byte_document_encoder

TOKENIZER, END_ID, DTYPE = "byte_bpe_50k.json", 2, "<u2"
#: Text bytes of a shard, about; bits a key on each level of the hash, and its most levels.
SHARD_BYTES, BITS_A_KEY, LEVELS = 24 << 20, 2, 48
HEAD = struct.Struct("<8s6Q")  # magic, levels, keys hashed, documents, documents without key, bytes an id, keys beyond the levels
MAGIC = b"SKEINIX1"


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(np.uint64), 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1, one to one."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bytes of bits; sorted keys that no level placed
        self.ranks, placed = [], 0
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(placed + ones - np.bitwise_count(bits))
            placed += int(ones[-1])
        self.placed = placed

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.view(np.uint64), []
        while len(left) and len(levels) < LEVELS:
            size = -(-max(64, BITS_A_KEY * len(left)) // 8) * 8
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; for keys that were not there any value, or -1."""
        keys = keys.view(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(keys[left], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = (bits[byte] >> bit) & 1 == 1
            below = bits[byte] & ((np.uint8(1) << bit) - np.uint8(1))
            out[left[here]] = ranks[byte[here]] + np.bitwise_count(below[here])
            left = left[~here]
        if len(left) and len(self.rest):
            found = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[found] == keys[left]
            out[left[hit]] = self.placed + found[hit]
        return out


def index_bytes(keys: np.ndarray, n_null: int, offsets: np.ndarray, id_bytes: int) -> bytes:
    """The index of a shard: ``keys`` ascending (the first ``n_null`` are void), ``offsets`` in tokens, one more than keys."""
    real = keys[n_null:]
    first = np.flatnonzero(np.r_[True, real[1:] != real[:-1]]) if len(real) else np.empty(0, np.int64)
    distinct = np.ascontiguousarray(real[first])
    hashed = PerfectHash.build(distinct)
    slot = hashed(distinct)
    marks, numbers = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slot], numbers[slot] = fingerprint(distinct), first + n_null
    parts = [HEAD.pack(MAGIC, len(hashed.levels), len(distinct), len(keys), n_null, id_bytes, len(hashed.rest))]
    parts += [np.array([len(b) for b in hashed.levels], "<u8").tobytes(), *(b.tobytes() for b in hashed.levels)]
    parts += [x.tobytes() for x in (hashed.rest.astype("<u8"), marks, numbers, keys.astype("<i8"), offsets.astype("<u8"))]
    return b"".join(parts)


class Shard:
    """A shard's index and, behind it, the ids of its documents by key.

    Opening reads the head and the bits of the hash; a lookup then seeks to one fingerprint, one number
    and two offsets.  ``table`` gives a whole array of the index, for jobs that go through all of them.
    """

    def __init__(self, folder: str, name: str):
        self.store, base = open_store(folder)
        self.path = f"{base}/{name}"
        self.idx, self.payload = (self.store.open_input_file(f"{self.path}.{end}") for end in ("idx", "ids"))
        magic, n_levels, self.n_keys, self.n_docs, self.n_null, self.id_bytes, n_rest = HEAD.unpack(self.idx.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{self.path}.idx is not an index of this format")
        sizes = np.frombuffer(self.idx.read(8 * n_levels), "<u8").tolist()
        levels = [np.frombuffer(self.idx.read(n), "u1") for n in sizes]
        self.hash = PerfectHash(levels, np.frombuffer(self.idx.read(8 * n_rest), "<u8"))
        self.window = (0, b"")  # of the payload: where it starts, and its bytes
        self.at, at = {}, self.idx.tell()
        for column, dtype, n in (("marks", "<u4", self.n_keys), ("numbers", "<u4", self.n_keys), ("keys", "<i8", self.n_docs), ("offsets", "<u8", self.n_docs + 1)):
            self.at[column] = (at, np.dtype(dtype), n)
            at += n * np.dtype(dtype).itemsize

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.idx.close(), self.payload.close()

    def table(self, column: str, start: int = 0, n: int | None = None) -> np.ndarray:
        at, dtype, size = self.at[column]
        self.idx.seek(at + start * dtype.itemsize)
        return np.frombuffer(self.idx.read((size if n is None else n) * dtype.itemsize), dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the first document of each key; -1 where there is none."""
        keys = np.ascontiguousarray(keys, "<i8")
        out = np.full(len(keys), -1, np.int64)
        if not self.n_keys:
            return out
        slot, prints = self.hash(keys), fingerprint(keys)
        few = len(keys) * 64 < self.n_keys  # fewer seeks than the arrays have pages
        marks, numbers = (None, None) if few else (self.table("marks"), self.table("numbers"))
        for i in np.flatnonzero(slot >= 0).tolist():
            at = int(slot[i])
            if (self.table("marks", at, 1)[0] if few else marks[at]) == prints[i]:
                out[i] = self.table("numbers", at, 1)[0] if few else numbers[at]
        return out

    def ids(self, start: int, end: int, ahead: int = 0) -> np.ndarray:
        """The ids between two token offsets; ``ahead`` bytes at least are read at once, for those that go on from there."""
        start, end = int(start) * self.id_bytes, int(end) * self.id_bytes
        at, data = self.window
        if start < at or end > at + len(data):
            self.payload.seek(start)
            at, data = self.window = start, self.payload.read(max(end - start, ahead))
        return np.frombuffer(data[start - at : end - at], f"<u{self.id_bytes}")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document of ``key``, none if it is not there: repeated keys follow the one found."""
        (number,), out = self.find(np.array([key])), []
        while 0 <= number < self.n_docs and self.table("keys", number, 1)[0] == key:
            out.append(self.ids(*self.table("offsets", number, 2).tolist()))
            number += 1
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, dtype: str = DTYPE, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to ``folder``; returns their stored manifest: shard, name, n_docs, n_tokens, first_token, first_key and last_key."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n_shards = max(1, -(-int(total) // shard_bytes))
    schema = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = byte_document_encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes()
        width = len(end)
        name = f"shard-{TaskContext.get().partitionId():06d}"
        keys, sizes = [], []

        def payload():
            lot, size = [], 0
            for key, text in arrow_rows(batches, "i", "t"):
                ids = encoder.encode(text or "") + end
                keys.append(key)
                sizes.append(len(ids) // width)
                lot.append(ids)
                size += len(ids)
                if size >= 1 << 20:
                    yield b"".join(lot)
                    lot, size = [], 0
            yield b"".join(lot)

        task_write(folder, f"{name}.ids", payload())
        n_null = sum(k is None for k in keys)
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        task_write(folder, f"{name}.idx", [index_bytes(np.array([k or 0 for k in keys], np.int64), n_null, offsets, width)])
        ends = (keys[n_null], keys[-1]) if n_null < len(keys) else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((int(name[6:]), name, len(keys), int(offsets[-1]), *ends), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    ordered = rows.repartitionByRange(n_shards, F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
    manifest = materialise(ordered.mapInArrow(run, "shard int, name string, n_docs long, n_tokens long, first_key long, last_key long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return materialise(manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids).

    A key leads to its documents through the hash: value, fingerprint, number, offsets, ids.  Documents
    without key, which nothing leads to, are read by number, and repeated keys after the one found.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for name, first in arrow_rows(batches, "name", "first_token"):
            with Shard(folder, name) as shard:
                keys, offsets = shard.table("keys"), shard.table("offsets").astype(np.int64)
                asked, copies = np.unique(keys[shard.n_null :], return_counts=True)
                found = shard.find(asked)
                if (found < 0).any():
                    raise ValueError(f"{shard.path}: the index does not lead to every document")
                # the numbers that each found one and its copies have
                numbers = np.repeat(found - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
                lot: list[tuple] = []
                for i, key in zip([*range(shard.n_null), *numbers.tolist()], [*[None] * shard.n_null, *np.repeat(asked, copies).tolist()], strict=True):
                    start, end = int(offsets[i]), int(offsets[i + 1])
                    lot.append((key, first + start, end - start, zlib.crc32(shard.ids(start, end, 1 << 20).astype("<u4").tobytes())))
                    if len(lot) == 4096:
                        yield _batch(lot, schema)
                if lot:
                    yield _batch(lot, schema)

    n = max(1, manifest.count())
    return manifest.select("name", "first_token").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(lot: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot, strict=True), schema, strict=True)], schema=schema)
    lot.clear()
    return made


def lookup(manifest: DataFrame, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``keys`` (a column of them) with the ids of their documents: key, shard, ids; no row for a key that is not there.

    Which shard holds a key follows from the shards' first keys, which every task gets (8 bytes and a name
    for each 24 MB of text); a task then seeks in its shards for the keys that it was dealt.
    """
    # shards are ranges of keys; one without keys has no first key
    shards = manifest.where(F.col("first_key").isNotNull()).orderBy("first_key").select("first_key", "name").toArrow()
    firsts, names = shards["first_key"].to_numpy(), shards["name"].to_pylist()

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(firsts, batch.column(0).to_numpy(zero_copy_only=False), side="right") - 1
            here = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(here)), pa.array([names[i] for i in at[here]], pa.string())], names=["key", "shard"])

    schema = pa.schema([("key", pa.int64()), ("shard", pa.string()), ("ids", pa.list_(pa.int64()))])

    def read(batches) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for key, of in arrow_rows(batches, "key", "shard"):
            if of != name:
                if shard:
                    shard.__exit__()
                shard, name = Shard(folder, of), of
            if found := [(key, of, ids.tolist()) for ids in shard.get(key)]:
                yield _batch(found, schema)
        if shard:
            shard.__exit__()

    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    placed = asked.mapInArrow(place, "key long, shard string")
    # a few keys' lookups are dealt by shard and key: no shard's keys are all one task's
    dealt = placed.repartition("shard", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(read, "key long, shard string, ids array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
