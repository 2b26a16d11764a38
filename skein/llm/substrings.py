"""Removal of word windows that an earlier document has too, by difference-cover anchors.

Of all positions only those whose remainder by ``period`` lies in a difference cover are hashed, as
anchors of ``words - period + 1`` words.  For any two positions some shift below the period brings both
into the cover (every remainder is a difference of two of its members), so two equal windows of
``words`` words hold an anchor at the same place of each; with period 7 that is 3 of 7 positions.

1. Documents are packed into chunks.  Every chunk asks of each of its distinct anchors whether another
   document has it: sorted hashes go to buckets, a bit for each comes back.  An anchor that no second
   document has ends here, with all windows that hold no other.
2. Shared anchors are extended to both sides, to every window that holds one.  These are compared
   by a 128-bit hash of their words together with the smallest id that has them in the chunk; the bit
   that comes back says whether a smaller id has the window elsewhere.  Within the chunk ids are compared there.
3. Every chunk joins the windows to be removed to spans and writes what is left of its documents.

A chunk sends a hash once, however often it occurs, so a passage that a third of all rows hold is one
row for each chunk; buckets follow the number of words.  Texts are never shuffled.

Defined cases: a null text has no words; ids are integers, and a null id counts as larger than any other;
rows that share an id remove nothing from each other; a text of fewer words than a window keeps
all; texts are taken whole, whatever their length; other columns, of whatever name, are carried along (those
named like a result are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .chunks import CHUNK_BYTES, Chunks, bits_of, flags_of, pack
from .common import materialise, table
from .shingles import mixed

WORDS = 13
#: Period and a smallest set of remainders whose differences are all remainders (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bytes of hashes of a bucket: the lower figure up to ``MANY`` buckets, then the higher one.
BUCKET_BYTES, MANY = (8 << 20, 256 << 20), 2_000
#: Bytes of a text whose words are held as objects at once.
PIECE = 1 << 20
NO_ID = np.iinfo(np.int64).max
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MADE = [
    StructField("n_words", LongType()),
    StructField("n_removed", LongType()),
    StructField("removed", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    StructField("kept_text", StringType()),
]


def cover_for(words: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves an anchor at least half of a window."""
    period = max(p for p in COVERS if p - 1 <= words // 2)
    return period, COVERS[period]


def cuts(data: bytes, most: int = PIECE) -> Iterator[bytes]:
    """The text in pieces that end at white space, so that no word is cut."""
    at = 0
    while len(data) - at > most:
        found = _SPACE.search(data, at + most)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:] if at else data


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def numbered(rows: pa.Table, text_col: str) -> tuple[pa.Table, int]:
    """The rows' columns by place, with each text as numbers of the chunk's distinct words; counts the words.

    bytes.split() cuts at the ASCII white space that ends a word.
    """
    numbers, texts = _Numbers(), []
    for text in rows.column(text_col).cast(pa.binary()):
        parts = [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) for found in map(bytes.split, cuts(text.as_py() or b""))]
        texts.append(np.concatenate(parts))
    columns = {f"c{i}": column for i, column in enumerate(rows.columns)}
    columns["numbers"] = pa.array(texts, pa.large_list(pa.int32()))
    columns["vocabulary"] = pa.array([list(numbers)] + [None] * (rows.num_rows - 1), pa.list_(pa.binary()))
    return pa.table(columns), sum(map(len, texts))


class RunHashes:
    """Hashes of any run of words of a chunk: differences of the prefix sums of word hash times power, brought to one power."""

    def __init__(self, hashes: np.ndarray, factor: int):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), factor, np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])])
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), pow(factor, -1, 1 << 64), np.uint64)]))

    def __call__(self, at: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[at + width] - self.sums[at]) * self.back[at])


def _marks(length: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which places lie in a span from a begin to before its end."""
    return np.cumsum(np.bincount(begins, minlength=length + 1) - np.bincount(ends, minlength=length + 1))[:length] > 0


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, and which places of it begin a new value; equal first keys with unlike others are sorted by all."""
    order = np.argsort(keys[0], kind="stable")
    changes = [k[order][1:] != k[order][:-1] for k in keys]
    if any((c & ~changes[0]).any() for c in changes[1:]):
        order = np.lexsort(keys[::-1])
        changes = [k[order][1:] != k[order][:-1] for k in keys]
    return order, np.concatenate([np.ones(min(1, len(order)), bool), np.logical_or.reduce(changes)])


class Cover:
    """Where the anchors of windows of ``words`` words lie."""

    def __init__(self, words: int):
        self.words = words
        self.period, remainders = cover_for(words)
        self.width = words - self.period + 1
        self.inside = np.isin(np.arange(self.period), remainders)


def _bounds(high: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin and end; a bucket is a range of the hash's upper half."""
    bucket = ((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


class _Chunk:
    """A chunk's words in a row with their anchors, as every pass derives them anew."""

    def __init__(self, rows: pa.Table, cover: Cover, id_place: int, buckets: int):
        self.cover, self.buckets, self.rows = cover, buckets, rows
        self.ids = pc.fill_null(rows.column(f"c{id_place}").cast(pa.int64()), int(NO_ID)).to_numpy()
        numbers = rows.column("numbers").combine_chunks()
        self.sizes = np.asarray(numbers.value_lengths())
        self.numbers = np.asarray(numbers.flatten())
        self.vocabulary = rows.column("vocabulary")[0].as_py()
        digests = b"".join(map(xxhash.xxh3_128_digest, self.vocabulary))
        first, second = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        self.first, self.second = RunHashes(first[self.numbers], 0x9E3779B97F4A7C15), second
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(self.numbers)) - self.begins[self.doc]
        room = self.sizes[self.doc]
        self.places = np.flatnonzero(cover.inside[place % cover.period] & (place <= room - cover.width) & (room >= cover.words))
        flat = self.first(self.places, cover.width)
        order, new = _distinct(flat)
        heads = np.flatnonzero(new)
        self.anchors, self.which = flat[order[heads]], np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        # equal hashes keep the order of the text: documents of a chunk share an anchor if its first and its last one differ
        owner = self.doc[self.places][order]
        self.several = owner[heads] != owner[np.append(heads[1:], len(order))[: len(heads)] - 1] if len(heads) else np.empty(0, bool)

    def flags(self, answers: dict, asked: int, keys: np.ndarray) -> np.ndarray:
        got, bounds = np.zeros(len(keys), bool), _bounds(keys, self.buckets)
        for (question, bucket), bits in answers.items():
            if question == asked:
                a, b = bounds[bucket], bounds[bucket + 1]
                got[a:b] = flags_of(bits, b - a)
        return got

    def extend(self, answers: dict) -> None:
        """The windows around shared anchors: their starts, distinct hashes, and the smallest id of each."""
        hit = self.places[self.flags(answers, 1, self.anchors)[self.which]]
        words, doc = self.cover.words, self.doc[hit]
        self.starts = np.flatnonzero(_marks(len(self.numbers), np.maximum(hit - self.cover.period + 1, self.begins[doc]), np.minimum(hit, self.ends[doc] - words) + 1))
        first = self.first(self.starts, words)
        second = RunHashes(self.second[self.numbers], 0xD6E8FEB86659FD93)(self.starts, words) if len(self.starts) else first
        self.owners = self.ids[self.doc[self.starts]]
        order, new = _distinct(first, second)
        heads = np.flatnonzero(new)
        self.keys = first[order[heads]], second[order[heads]]
        self.least = np.minimum.reduceat(self.owners[order], heads) if len(heads) else np.empty(0, np.int64)
        self.window = np.empty(len(order), np.int64)
        self.window[order] = np.cumsum(new) - 1

    def gone(self, answers: dict) -> np.ndarray:
        """Which words go: a smaller id has the window, in another chunk or in this one."""
        elsewhere = self.flags(answers, 2, self.keys[0])
        hit = self.starts[elsewhere[self.window] | (self.least[self.window] < self.owners)]
        return _marks(len(self.numbers), hit, hit + self.cover.words)


def _rows(chunk: str, asked: int, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for every bucket that has keys: the slices of the columns, the first of which is sorted."""
    bounds = _bounds(columns[0], buckets)
    full = np.flatnonzero(bounds[1:] > bounds[:-1]).tolist()
    fields = {"chunk": pa.array([chunk] * len(full), pa.string()), "asked": pa.array([asked] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32())}
    for name, column in zip(("first", "second", "extra"), columns):
        fields[name] = pa.array([column[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary())
    return pa.RecordBatch.from_pydict(fields)


_REPLY = "chunk string, asked int, bucket int, bits binary"


def _replies(group: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    told = [i for i, f in enumerate(flags) if f.any()]
    kept = group.select(["chunk", "asked", "bucket"]).take(pa.array(told, pa.int64()))
    return kept.append_column("bits", pa.array([bits_of(flags[i]) for i in told], pa.binary()))


def _shared(group: pa.Table) -> pa.Table:
    """Of each chunk's anchors in a bucket: has another document the anchor?"""
    keys = [np.frombuffer(b, np.uint64) for b in group.column("first").to_pylist()]
    several = [np.frombuffer(b, bool) for b in group.column("second").to_pylist()]
    every = np.sort(np.concatenate(keys), kind="stable")
    twice = np.concatenate([every[1:][every[1:] == every[:-1]], *(k[s] for k, s in zip(keys, several))])
    twice = np.append(np.unique(twice), np.uint64(0))
    found = [np.searchsorted(twice[:-1], k) for k in keys]
    return _replies(group, [(twice[i] == k) & (i < len(twice) - 1) for i, k in zip(found, keys)])


def _smaller(group: pa.Table) -> pa.Table:
    """Of each chunk's windows in a bucket: has a smaller id than the chunk's smallest the window?"""
    read = lambda name, kind: [np.frombuffer(b, kind) for b in group.column(name).to_pylist()]
    firsts = read("first", np.uint64)
    first, second, least = np.concatenate(firsts), np.concatenate(read("second", np.uint64)), np.concatenate(read("extra", np.int64))
    order, new = _distinct(first, second)
    lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    flags = np.empty(len(order), bool)
    flags[order] = lowest < least[order]
    return _replies(group, np.split(flags, np.cumsum([len(f) for f in firsts])[:-1]))


def buckets_for(size: int) -> int:
    return max(1, min(MANY, -(-size // BUCKET_BYTES[0])), -(-size // BUCKET_BYTES[1]))


def mark_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, Chunks]:
    """``docs`` with n_words, n_removed, removed (spans of words, end exclusive) and kept_text, and the chunks that it reads."""
    if words < 1:
        raise ValueError("words must be positive")
    cover, made = Cover(words), [f.name for f in _MADE]
    typed = docs if isinstance(docs.schema[text_col].dataType, StringType) else docs.withColumn(text_col, F.col(text_col).cast("string"))
    carried = [(i, f) for i, f in enumerate(typed.schema.fields) if f.name not in made]
    id_place = typed.columns.index(id_col)
    chunks = pack(typed, text_col, lambda rows: numbered(rows, text_col), "passages", chunk_bytes)
    buckets = buckets_for(8 * chunks.units * int(cover.inside.sum()) // cover.period)

    def ask_anchors(chunk: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _Chunk(rows, cover, id_place, buckets)
        yield _rows(chunk, 1, buckets, x.anchors, x.several)

    asked = chunks.each(ask_anchors, "chunk string, asked int, bucket int, first binary, second binary")
    shared = materialise(asked.groupBy("bucket").applyInArrow(_shared, _REPLY), "passages-shared")

    def ask_windows(chunk: str, rows: pa.Table, answers: dict) -> pa.Table:
        x = _Chunk(rows, cover, id_place, buckets)
        x.extend(answers)
        return pa.Table.from_batches([_rows(chunk, 2, buckets, *x.keys, x.least)])

    asked = chunks.answered(shared, ask_windows, "chunk string, asked int, bucket int, first binary, second binary, extra binary")
    smaller = materialise(asked.groupBy("bucket").applyInArrow(_smaller, _REPLY), "passages-smaller")

    def finish(chunk: str, rows: pa.Table, answers: dict) -> pa.Table:
        x = _Chunk(rows, cover, id_place, buckets)
        x.extend(answers)
        gone = x.gone(answers)
        before = np.concatenate([[0], np.cumsum(gone)])
        # a span ends with its document, though the next one's may follow at once
        edge = np.zeros(len(gone) + 1, bool)
        edge[x.begins[x.sizes > 0]], edge[-1] = True, True
        spans = np.flatnonzero(gone & (edge[:-1] | np.concatenate([[True], ~gone])[:-1]))
        stops = np.flatnonzero(gone & (edge[1:] | np.concatenate([~gone, [True]])[1:])) + 1
        owner = x.doc[spans]
        removed = pa.StructArray.from_arrays([pa.array((v - x.begins[owner]).astype(np.int32)) for v in (spans, stops)], ["start", "end"])
        offsets = pa.array(np.searchsorted(owner, np.arange(len(x.sizes) + 1)).astype(np.int32))
        word = x.vocabulary.__getitem__
        kept = [b" ".join(map(word, part[~cut].tolist())) for part, cut in ((x.numbers[a:b], gone[a:b]) for a, b in zip(x.begins, x.ends))]
        columns = [rows.column(f"c{i}") for i, _ in carried]
        columns += [pa.array(x.sizes.astype(np.int64)), pa.array(before[x.ends] - before[x.begins]), pa.ListArray.from_arrays(offsets, removed), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(columns, names=[f.name for _, f in carried] + made)

    return chunks.answered(shared.unionByName(smaller), finish, StructType([*(f for _, f in carried), *_MADE])), chunks


def query(spark, sf_dir: str) -> DataFrame:
    marked, chunks = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = materialise(marked.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), "passages-kept")
    chunks.delete()
    return found


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS g, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), m AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE first < doc_id
), t AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
