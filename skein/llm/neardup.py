"""MinHash near-deduplication with sequential Bayesian verification.

1. One pass over the texts makes each document's shingle set, its 128-bit digest, a
   MinHash signature and an odd sketch.  Documents with equal digests form a class, and
   each one's full set is compared with its representative's (``refuted``); from here on
   only the representative takes part.
2. Signatures are cut into bands; representatives that share a band share a bucket.
   With ``BANDS`` bands of ``BAND_ROWS`` rows a pair of similarity 0.8 is missed with
   probability 1.5e-5, more similar pairs far less.
3. First every member is compared with its bucket's least member only, so a family of
   near copies costs as many pairs as it has members.  The links give components.
4. Then, in buckets that still hold several components, every member outside the
   largest one is compared with all members of other components.  No pair of a bucket
   whose documents are not connected already is left out; a bucket of many members is cut
   into a grid of cells of at most about ``CELL`` by ``CELL`` of them.
5. Candidates must pass what set sizes and odd sketches prove (both bounds are exact:
   no pair over the threshold fails them).  Then their signatures are compared batch by
   batch; a pair goes as soon as the posterior probability that it reaches the threshold
   falls under ``MISS``.  Survivors are verified on the full shingle sets of their texts.

Defined cases: null and empty texts have no shingles, are linked with nothing and are
kept; fewer than ``k`` words form one shingle; ties do not arise, as components are
named by their least id; in ``near_components`` rows with a null id get the component of
their equals that have ids (null if there are none) and rows that share an id count as one
document, while ``drop_near`` decides for each row apart; an empty table gives an empty
result.  Set sizes count 64-bit hashes of shingles: in a set of n two of them collide with
a chance of n * n / 2^65, which is 3e-8 for a million shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, carry, discard, materialise, rest, restored, small, table, trimming
from .components import connected_components
from .shingles import MinHash, exact_shingles, odd_sketch, shingle_set
from .tokens import arrow_rows

BANDS, BAND_ROWS = 28, 5
#: Signature values compared at a time, and the chance to lose a true pair that pruning may take.
BATCH, MISS = 28, 1e-6
#: 64-bit words of an odd sketch.
SKETCH = 16

#: Members of a class that one task compares with the class's representative, and of a bucket that one cell of its grid holds.
CLASS_LOT, CELL = 200, 2000

_ROW = "_near_row"

_BASE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("odd", pa.list_(pa.int64()))])
_BASE_SQL = "doc_id long, th long, n long, digest binary, sig binary, odd array<long>"


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), n (set size), digest, sig and odd of every document; digest, sig and odd are null for empty sets."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS * BAND_ROWS)
        out: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BASE, strict=True)], schema=_BASE)
            out.clear()
            return batch

        for doc_id, th, text in arrow_rows(batches, "i", "th", "t"):
            found = shingle_set(text, k)
            if len(found):
                out.append((doc_id, th, len(found), xxhash.xxh3_128_digest(found.tobytes()), minhash(found).tobytes(), odd_sketch(found, SKETCH)))
            else:
                out.append((doc_id, th, 0, None, None, None))
            if len(out) >= 1000:
                yield flush()
        if out:
            yield flush()

    return _texts(docs, id_col, text_col).mapInArrow(trimming(run), _BASE_SQL)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("th"), text.alias("t"))


def refuted(base: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of documents whose full shingle set is not that of their class's representative.

    A class of equal digests is one of equal sets unless hashes collide, so this is all but always empty.
    Every member's text moves once; it meets the representative's in lots, so no class is one task.
    """
    keyed = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).select("digest", "doc_id", "th")
    classes = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # a member is asked for once, its class's representative once a lot
    several = materialise(classes.select("digest", "rep", F.ceil(F.col("size") / CLASS_LOT).cast("int").alias("lots")), "classes-of-several")
    is_rep = F.struct("doc_id", "th") == F.col("rep")
    lot = F.when(is_rep, F.sequence(F.lit(0), F.col("lots") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "th"), F.col("lots")).cast("int")))
    asked = materialise(keyed.join(small(several, BROADCAST_ROWS // 10), "digest").select(F.col("doc_id").alias("i"), "th", "digest", (~is_rep).alias("member"), lot.alias("lot")).distinct(), "class-members")
    met = _texts(docs, id_col, text_col).join(small(asked, BROADCAST_ROWS // 10), ["i", "th"]).withColumn("lot", F.explode("lot"))
    met = met.repartition("digest", "lot").sortWithinPartitions("digest", "lot", "member", "th")

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, first, first_set, last, same = None, None, None, None, True
        for batch in batches:
            out: list[tuple] = []
            for i, digest, lot, member, text in arrow_rows([batch], "i", "digest", "lot", "member", "t"):
                if not member and at != (digest, lot):
                    at, first, first_set, last, same = (digest, lot), text, None, text, True
                elif text != last:  # copies of one text, which are neighbours, are compared once
                    if text == first:
                        last, same = text, True
                    else:
                        first_set = exact_shingles(first, k) if first_set is None else first_set
                        last, same = text, exact_shingles(text, k) == first_set
                if not same:
                    out.append((i, digest))
            columns = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary()), strict=True)], names=["doc_id", "digest"])

    found = materialise(met.select("i", "digest", "lot", "member", "t").mapInArrow(trimming(run), "doc_id long, digest binary"), "refuted")
    discard(several, asked)
    return found.distinct()


def _tail(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of n agree), from a uniform prior: the tail of Beta(matches + 1, n - matches + 1)."""
    return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(matches + 1))


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest agreements among n values with which a pair stays."""
    return next((m for m in range(n + 1) if _tail(m, n, threshold) >= miss), n)


def bayesian_survivors(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` whose signatures do not rule out the similarity."""
    steps = [(n, least_matches(n, percent / 100, MISS)) for n in range(BATCH, BANDS * BAND_ROWS + 1, BATCH)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = 4 * BANDS * BAND_ROWS
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, width // 4) for c in (2, 3)]
            alive, agreed, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                agreed = agreed + (sig[0][alive, at:n] == sig[1][alive, at:n]).sum(axis=1)
                stay = agreed >= least
                alive, agreed, at = alive[stay], agreed[stay], n
            yield batch.select([0, 1]).take(pa.array(alive))

    of = lambda c: signatures.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(trimming(run), "a long, b long")


def exact_links(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b) of the stored ``pairs`` whose full shingle sets reach the similarity."""
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "verify-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(small(needed), "id", "left_semi")
    texts = materialise(texts, "verify-texts")

    def run(batches) -> Iterator[pa.RecordBatch]:
        last_a, last = None, set()
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(arrow_rows([batch], "a", "ta", "tb")):
                if a != last_a:
                    last_a, last = a, exact_shingles(ta, k)
                other = exact_shingles(tb, k)
                common = len(last & other)
                if 100 * common >= percent * (len(last) + len(other) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    of = lambda c: texts.select(F.col("id").alias(c), F.col("t").alias(f"t{c}"))
    links = materialise(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(trimming(run), "a long, b long"), "links")
    discard(needed, texts)
    return links


def _possible(l: str, r: str, percent: int):
    """What sizes and odd sketches prove: the smaller set has percent of the larger one, and the sets
    differ in at most (100 - percent) / (100 + percent) of their summed sizes."""
    n_l, n_r = F.col(f"{l}.n").cast("long"), F.col(f"{r}.n").cast("long")
    differ = sum((F.bit_count(F.get(f"{l}.odd", F.lit(i)).bitwiseXOR(F.get(f"{r}.odd", F.lit(i)))) for i in range(1, SKETCH)), F.bit_count(F.get(f"{l}.odd", F.lit(0)).bitwiseXOR(F.get(f"{r}.odd", F.lit(0)))))
    return (100 * F.least(n_l, n_r) >= percent * F.greatest(n_l, n_r)) & ((100 + percent) * differ <= (100 - percent) * (n_l + n_r))


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``: documents are linked from a
    similarity of ``percent`` of their ``k``-word shingle sets on, and a component holds all that links reach."""
    base = materialise(sketches(docs, k, id_col, text_col), "sketches")
    wrong = refuted(base, docs, k, id_col, text_col)
    if not wrong.isEmpty():  # a class of its own for each; what links them is verified like any other link
        own = wrong.withColumn("own", F.concat("digest", F.encode(F.col("doc_id").cast("string"), "utf-8")))
        marked = base.join(small(materialise(own, "refuted")), ["doc_id", "digest"], "left")
        base = materialise(marked.select("doc_id", "th", "n", F.coalesce("own", "digest").alias("digest"), "sig", "odd"), "sketches")
    classes = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest")
    reps = materialise(classes.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd")), "classes")

    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 4 * BAND_ROWS * i + 1, 4 * BAND_ROWS))
    banded = reps.select("rep", F.explode(F.array(*(band(i) for i in range(BANDS)))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = materialise(banded.join(shared, "bucket"), "buckets")
    facts = reps.select("rep", "n", "odd")

    def links_of(candidates: DataFrame) -> DataFrame:
        l, r = facts.select(F.col("rep").alias("a"), "n", "odd").alias("l"), facts.select(F.col("rep").alias("b"), "n", "odd").alias("r")
        possible = candidates.join(l, "a").join(r, "b").where(_possible("l", "r", percent)).select("a", "b")
        survivors = materialise(bayesian_survivors(possible, reps, percent), "survivors")
        found = exact_links(survivors, docs, k, percent, id_col, text_col)
        discard(survivors)
        return found

    first = links_of(members.where("head < rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
    component = materialise(connected_components(first), "components")
    rest(docs.sparkSession)

    # what the first links left apart
    placed = members.join(component, members["rep"] == component["node"], "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = materialise(placed, "placed")
    counts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    # a bucket of many members is a grid of cells, each of which pairs some left with some right members
    cells = F.ceil(F.col("members") / CELL).cast("int")
    sizes = counts.groupBy("bucket").agg(F.sum("size").alias("members"))
    apart = materialise(placed.join(largest, "bucket").join(sizes, "bucket").join(facts, "rep").withColumns({"cells": cells, "cell": F.pmod(F.xxhash64("rep"), cells).cast("int")}).drop("members"), "apart")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    l = apart.where("comp <> main").withColumnRenamed("cell", "i").withColumn("j", every).alias("l")
    r = apart.withColumnRenamed("cell", "j").withColumn("i", every).alias("r")
    same_cell = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    across = same_cell & (F.col("l.comp") != F.col("r.comp")) & ((F.col("r.comp") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep")))
    pairs = l.join(r, across & _possible("l", "r", percent)).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))
    pairs = materialise(pairs.distinct(), "across")
    if not pairs.isEmpty():
        survivors = materialise(bayesian_survivors(pairs, reps, percent), "survivors")
        second = exact_links(survivors, docs, k, percent, id_col, text_col)
        component = materialise(connected_components(first.unionByName(second)), "components")
    discard(members, placed, apart, pairs)

    named = reps.join(component, reps["rep"] == component["node"], "left").select("digest", F.coalesce("component", "rep").alias("comp"))
    return base.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of rows, with its own columns: the one with the least id (null ids last).

    Rows are told apart by a number that is given once and stored, so rows without id, or with one that
    others share, are compared and kept like any other.
    """
    numbered = materialise(docs.select(carry(docs), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias(_ROW)), "numbered")
    found = near_components(numbered.select(_ROW, "t"), k, percent, _ROW, "t")
    placed = found.select(F.col("doc_id").alias(_ROW), "component_id").join(numbered.select(_ROW, "i"), _ROW)
    keep = placed.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull(), "i", _ROW))[_ROW].alias(_ROW))
    return numbered.join(keep, _ROW, "left_semi").select(*restored(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
