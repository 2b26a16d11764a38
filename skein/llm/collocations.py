"""Collocations of two to five words by PCY/DHP hashing with Apriori pruning.

Texts are packed once into chunks: for each language the chunk's distinct words and its text as
numbers of them, with a break between pieces and documents.  Then one pass a length:

1. counts words exactly, and all pairs of neighbours in hash buckets;
k. counts exactly the phrases of k words whose two parts of k - 1 words may be frequent (Apriori, from a
   bitmap of the frequent ones' hashes) and whose bucket reached the threshold in the pass before
   (PCY); phrases of k + 1 words of which both parts passed are counted in buckets meanwhile (DHP).

Bitmaps are broadcast: one bit a bucket, their number set by the number of words and at most ``MAX_BUCKETS``
(32 MB).  They only spare work: what they let through is counted exactly, by its words.  Within a chunk a
phrase is one number, found from its prefix's number and its last word, so counts before the shuffle are exact
too.  A chunk sends bucket counts up to the threshold only, since sums of such counts reach it just when the
true ones do.  Frequent phrases hold frequent parts only, so all counts that a score needs are known at the end.

Defined cases: a null text is empty and counts nothing; a null language is ``und`` (as is a language of that name);
repeated rows count each; texts are taken whole; a language without candidates, or an empty table, has no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, bits_of, pack
from .common import discard, materialise, small, table
from .shingles import mixed
from .substrings import cuts

#: Words of a phrase, the least count of a candidate, and the phrases told of each language.
LONGEST, LEAST, TOP = 5, 100, 2_000
#: Words a hash bucket, buckets of a slice that is summed on its own, and the most buckets.
WORDS_A_BUCKET, SLICE, MAX_BUCKETS = 16, 1 << 18, 1 << 28
BREAK = b"."
#: Upper-case ASCII to lower case, what ends a piece to BREAK, a tab to a space (fixed by the contract).
_FORM = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_COUNTED = "lang string, words int, phrase string, n long, slice int, counts binary"
_COUNTED_PA = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])


class _Numbers(dict):
    """Words numbered as they come; 0 is the break."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def numbered(text: bytes, numbers: dict) -> list[np.ndarray]:
    """A text as the numbers of its words, breaks between its pieces and at its end."""
    parts = []
    for cut in cuts(text):
        found = cut.translate(_FORM).replace(BREAK, b" . ").split()
        parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
    return [*parts, np.zeros(1, np.int32)]


def packed(rows: pa.Table) -> tuple[pa.Table, int]:
    """A row a language: its distinct words and all its texts as numbers; counts the words."""
    numbers: dict[str, _Numbers] = {}
    parts: dict[str, list] = {}
    for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").cast(pa.binary())):
        data = text.as_py()
        if data:
            parts.setdefault(lang, []).extend(numbered(data, numbers.setdefault(lang, _Numbers())))
    ids = {lang: np.concatenate(x) for lang, x in parts.items()}
    out = pa.table({"lang": pa.array(list(ids), pa.string()), "words": pa.array([list(numbers[x]) for x in ids], pa.list_(pa.binary())), "ids": pa.array([x.tobytes() for x in ids.values()], pa.large_binary())})
    return out, int(sum(np.count_nonzero(x) for x in ids.values()))


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def phrase_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each of the places on; of the whole of ``hashes`` for a single phrase."""
    total = np.full(len(at), k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + hashes[at + j])
    return total


class Bitmap:
    """Bits of a power of two of buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.bits = np.zeros(max(1, buckets // 8), np.uint8)

    def fill(self, rows) -> Bitmap:
        """From (slice, bits) rows."""
        wide = min(SLICE, self.buckets) // 8
        for part, bits in rows:
            self.bits[part * wide : (part + 1) * wide] = np.frombuffer(bits, np.uint8)
        return self

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.buckets - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _slices(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, places in it) of the hashes' buckets."""
    at = np.sort(hashes & np.uint64(buckets - 1))
    wide = min(SLICE, buckets)
    bounds = np.searchsorted(at, np.arange(0, buckets + 1, wide, dtype=np.uint64))
    for part in range(buckets // wide):
        if bounds[part] < bounds[part + 1]:
            yield part, (at[bounds[part] : bounds[part + 1]] - np.uint64(part * wide)).astype(np.int64)


def squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def loosened(data: pa.Scalar, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd", 1).decompress(data.as_py(), n * np.dtype(kind).itemsize, asbytes=True), kind)


def _bucket_rows(hashes: list[np.ndarray], buckets: int, words: int, least: int) -> pa.RecordBatch:
    """Counts of a chunk by bucket, none above ``least``, a row a slice."""
    kind, wide = (np.uint8 if least <= 255 else np.uint32), min(SLICE, buckets)
    found = list(_slices(np.concatenate(hashes), buckets)) if hashes else []
    counts = [squeezed(np.minimum(np.bincount(at, minlength=wide), least).astype(kind).tobytes()) for _, at in found]
    return _batch(words=[words] * len(found), slice=[part for part, _ in found], counts=counts)


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _COUNTED_PA], schema=_COUNTED_PA)


def _whole(ids: np.ndarray, k: int) -> np.ndarray:
    """Places from which k words follow without a break."""
    if len(ids) < k:
        return np.empty(0, np.int64)
    ok = ids[: len(ids) - k + 1] > 0
    for j in range(1, k):
        ok &= ids[j : len(ids) - k + 1 + j] > 0
    return np.flatnonzero(ok)


def exact_counts(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of every distinct phrase of k words among those that start at the places."""
    wide = int(ids.max()) + 1
    number = ids[at].astype(np.int64)
    for j in range(1, k):
        _, first, number, count = np.unique(number * wide + ids[at + j], return_index=True, return_inverse=True, return_counts=True)
    return at[first], count


def _count_words(folder_rows: pa.Table, buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    pairs = []
    for lang, words, data in zip(*(folder_rows.column(c) for c in ("lang", "words", "ids"))):
        lang, words, ids = lang.as_py(), words.as_py(), np.frombuffer(data.as_py(), np.int32)
        counts = np.bincount(ids, minlength=len(words))[1:]
        yield _batch(lang=[lang] * len(counts), words=[1] * len(counts), phrase=pa.array(words[1:], pa.binary()).cast(pa.string()), n=counts)
        at = _whole(ids, 2)
        pairs.append(phrase_hashes(_word_hashes(lang, words)[ids], at, 2))
    yield _bucket_rows(pairs, buckets, 2, least)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = seed_of(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _count_phrases(rows: pa.Table, k: int, longest: int, frequent: Bitmap, promising: Bitmap, least: int) -> Iterator[pa.RecordBatch]:
    following = []
    for lang, words, data in zip(*(rows.column(c) for c in ("lang", "words", "ids"))):
        lang, words, ids = lang.as_py(), words.as_py(), np.frombuffer(data.as_py(), np.int32)
        hashes = _word_hashes(lang, words)[ids]
        parts = _whole(ids, k - 1)
        ok = np.zeros(len(ids) + 1, bool)
        ok[parts[frequent.has(phrase_hashes(hashes, parts, k - 1))]] = True
        at = _whole(ids, k)
        at = at[ok[at] & ok[at + 1]]
        at = at[promising.has(phrase_hashes(hashes, at, k))]
        if not len(at):
            continue
        places, counts = exact_counts(ids, at, k)
        phrases = [b" ".join([words[i] for i in p]) for p in ids[places[:, None] + np.arange(k)].tolist()]
        yield _batch(lang=[lang] * len(counts), words=[k] * len(counts), phrase=pa.array(phrases, pa.binary()).cast(pa.string()), n=counts)
        if k < longest:
            ok = np.zeros(len(ids) + 1, bool)
            ok[at] = True
            at = at[ok[at + 1]]
            following.append(phrase_hashes(hashes, at, k + 1))
    if k < longest:
        yield _bucket_rows(following, promising.buckets, k + 1, least)


def _promising(counted: DataFrame, buckets: int, least: int) -> Bitmap:
    """Buckets whose counts over all chunks reach the threshold."""
    kind, wide = (np.uint8 if least <= 255 else np.uint32), min(SLICE, buckets)

    def run(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide, np.int64)
        for batch in group:
            for data in batch.column(1):
                total += loosened(data, kind, wide)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits_of(total >= least)], pa.binary())})

    sums = counted.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(run, "slice int, bits binary")
    return Bitmap(buckets).fill(sums.collect())  # a bit a bucket


def _frequent(phrases: DataFrame, buckets: int) -> Bitmap:
    """Bits of the hashes of stored phrases (lang, words, phrase)."""
    wide = min(SLICE, buckets)

    def partial(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = _word_hashes(lang, phrase.split(b" "))
                hashes.append(phrase_hashes(words, np.zeros(1, np.int64), len(words)))
            for part, at in _slices(np.concatenate(hashes), buckets) if hashes else ():
                flags = np.zeros(wide, bool)
                flags[at] = True
                yield pa.RecordBatch.from_pydict({"slice": pa.array([part], pa.int32()), "bits": pa.array([squeezed(bits_of(flags))], pa.binary())})

    def run(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(max(1, wide // 8), np.uint8)
        for batch in group:
            for data in batch.column(1):
                total |= loosened(data, np.uint8, len(total))
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    bits = phrases.select("lang", "phrase").mapInArrow(partial, "slice int, bits binary").groupBy("slice").applyInArrow(run, "slice int, bits binary")
    return Bitmap(buckets).fill(bits.collect())  # a bit a bucket


def buckets_for(words: int) -> int:
    """A power of two, about a bucket for ``WORDS_A_BUCKET`` words."""
    return min(MAX_BUCKETS, 1 << max(10, (words // WORDS_A_BUCKET).bit_length()))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words found ``least`` times, and (lang, total) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    chunks = pack(rows, "text", packed, "phrases", chunk_bytes)
    buckets = buckets or buckets_for(chunks.units)
    kept, promising, frequent = [], None, None
    for k in range(1, longest + 1):
        if k == 1:
            run = lambda _, rows: _count_words(rows, buckets, least)
        else:
            sent = spark.sparkContext.broadcast((frequent, promising))
            run = lambda _, rows, k=k, sent=sent: _count_phrases(rows, k, longest, *sent.value, least)
        counted = materialise(chunks.each(run, _COUNTED), "phrases-counted")
        sums = counted.where("phrase is not null").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
        kept.append(materialise(sums.where(F.col("f") >= least), "phrases-frequent"))
        if k == 1:
            totals = materialise(counted.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("total")), "phrases-totals")
        if k < longest:
            promising, frequent = _promising(counted, buckets, least), _frequent(kept[-1], buckets)
        discard(counted)
    chunks.delete()
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found, totals


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a) with l, r, n and score of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = frequent.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    cut = cut.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    of = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(small(totals).withColumnRenamed("total", "n"), "lang")
    # decimals of 38 digits: exact while 1000 * a * n, and l * r, are below 10^38
    cut = cut.withColumn("score", F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    return cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("low")).select("lang", "phrase", "words", "a", "low.l", "low.r", "low.n", "low.score")


def collocations(frequent: DataFrame, totals: DataFrame, percent: int = 100, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``top`` candidates that no longer one explains.

    A longer candidate explains those inside it of which it is ``percent`` of the occurrences.
    """
    words = F.split("phrase", " ")
    longer = frequent.where("words > 2").select("lang", "words", F.col("f"), words.alias("ws"))
    spans = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(ws, i, n), ' '))))")
    inside = longer.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = _scored(frequent, totals).join(inside, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(*frequent_phrases(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k
  ) GROUP BY lang, k, phrase HAVING count(*) >= 100
), cut AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM f WHERE k > 1
), scored AS (
  SELECT cut.lang, cut.k, cut.phrase, cut.f AS a, c, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * cut.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:c], ' ')
    JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[c+1:], ' ') JOIN n ON n.lang = cut.lang
), low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), sub AS (
  SELECT lang, f, array_to_string(ws[i:i+m-1], ' ') AS phrase FROM (
    SELECT lang, f, k, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS m FROM f WHERE k > 2
  ), (SELECT unnest(range(1, 5)) AS i) WHERE i + m - 1 <= k
), top AS (
  SELECT lang, phrase, max(f) AS f FROM sub GROUP BY lang, phrase
), kept AS (
  SELECT low.* FROM low LEFT JOIN top USING (lang, phrase) WHERE top.f IS NULL OR 100 * top.f < 100 * low.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
