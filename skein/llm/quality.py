"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, lower-cased and hashed, and its byte trigrams and 5-grams, hashed; their counts
are weighted by log(1 + count) and by the inverse document frequency, and each kind has an equal share of a text's
vector.  A last kind of a small share (``REPEATED``) tells how much of the text is repeated: the share of its word
2-, 3- and 5-grams that occurred in it before, in eighths.  A truncated SVD of a bounded sample of labelled
texts gives the latent space; the sample's vectors are broadcast (``SAMPLE * DIMS`` numbers
at most), and every document's cosine with every one of them is computed in blocks.  The
``NEIGHBOURS`` nearest vote with their labels, weighted by a power of their similarity.

The fit reads labels of training rows only: crc32 of the id as text, mod 4, is not 2.
It takes the ``SAMPLE`` rows with the smallest hash of their id; that bound is a parameter.

Defined cases: a null or empty text, and any text without a positive cosine, gets the
share of good labels in the sample; without any training label the score is 0.5, and ``keep_good`` raises a ValueError rather than
drop every document (no documents stay no documents); ids with several label rows count with their mean label, ids with several texts with the first of
them; null labels are ignored; rows with a null id are scored and are not held out; other columns, of whatever name, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import carry, restored, table, text_or_empty, trim, trimming
from .tokens import arrow_rows

SAMPLE, DIMS, NEIGHBOURS, POWER, THRESHOLD = 4000, 64, 15, 8, 0.7
#: Documents whose cosines are one block, and words whose places a task keeps.
BLOCK, _KEPT_WORDS = 256, 100_000
#: Places for words, byte trigrams, byte 5-grams and repeated n-grams; the lengths of these; the share of their kind beside 1 of each other.
_PLACES = (2048, 2048, 4096, 27)
_GRAMS, REPEATED = (2, 3, 5), 0.5
_ENDS = np.cumsum((0, *_PLACES))
_SHARES = (1.0, 1.0, 1.0, REPEATED)


class _Words(dict):
    """Word -> hash; beyond ``_KEPT_WORDS`` the cache starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n values in a row."""
    total = np.zeros(max(0, len(values) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n if len(total) else 0):
            total = (total + values[j : len(total) + j] + np.uint64(1)) * _MIX
    return total


def repeated_share(hashes: np.ndarray, n: int) -> float:
    """Of the n-grams of words those that the text had before."""
    grams = _hashed(hashes, n)
    return 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0


def term_counts(text: str) -> np.ndarray:
    """Counts of the text's terms, kind after kind; a share of repeated n-grams lies between its two nearest eighths."""
    out = np.zeros(_ENDS[-1], np.float32)
    words, trigrams, fives, repeated = (out[a:b] for a, b in zip(_ENDS, _ENDS[1:], strict=False))
    data = text.encode("utf-8", "surrogatepass")
    found = data.lower().split()
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    words += np.bincount((hashes % np.uint64(len(words))).astype(np.int64), minlength=len(words))
    for i, n in enumerate(_GRAMS if len(found) >= _GRAMS[0] else ()):
        eighths = 8 * repeated_share(hashes, n)
        low = min(int(eighths), 7)
        repeated[9 * i + low] += 1 - (eighths - low)
        repeated[9 * i + low + 1] += eighths - low
    some = np.frombuffer(data, np.uint8)
    for n, kind in ((3, trigrams), (5, fives)):
        shift = np.uint64(64 - (len(kind) - 1).bit_length())
        for at in range(0, max(0, len(some) - n + 1), 1 << 20):
            grams = _hashed(some[at : at + (1 << 20) + n - 1].astype(np.uint64), n)
            kind += np.bincount((grams >> shift).astype(np.int64), minlength=len(kind))
    return out


def training_fold(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(True))


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = DIMS):
        """``texts`` are places and counts of terms; they are made dense a block at a time only."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = np.bincount(np.concatenate([at for at, _ in texts]) if texts else [], minlength=_ENDS[-1])
        self.columns = np.flatnonzero(seen >= 2) if len(labels) else np.empty(0, np.int64)
        self.weight = (np.log((1 + len(labels)) / (1 + seen)) + 1).astype(np.float32)
        dims = min(dims, len(texts), len(self.columns))
        basis = np.random.default_rng(0).standard_normal((len(self.columns), min(len(self.columns), dims + 16))).astype(np.float32)
        if dims:
            rows = []
            for at, n in texts:
                one = np.zeros((1, _ENDS[-1]), np.float32)
                one[0, at] = n
                weighted = self._weighted(one)[0]
                places = np.flatnonzero(weighted).astype(np.int32)
                rows.append((places, weighted[places]))
            for _ in range(4):  # subspace iteration
                basis = np.linalg.qr(sum(block.T @ (block @ basis) for block in self._dense(rows)))[0]
            turn = np.linalg.svd(np.concatenate([block @ basis for block in self._dense(rows)]), full_matrices=False)[2]
            basis = basis @ turn.T[:, :dims]
            self.vectors = self._unit(np.concatenate([block @ basis for block in self._dense(rows)]))
        else:
            basis, self.vectors = basis[:, :0], np.zeros((len(texts), 0), np.float32)
        self.basis, self.labels = np.ascontiguousarray(basis, np.float32), labels.astype(np.float32)

    def _dense(self, rows) -> Iterator[np.ndarray]:
        for at in range(0, len(rows), BLOCK):
            block = np.zeros((min(BLOCK, len(rows) - at), len(self.columns)), np.float32)
            for i, (places, values) in enumerate(rows[at : at + BLOCK]):
                block[i, places] = values
            yield block

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x *= self.weight
        x[:, _ENDS[-2] :] = counts[:, _ENDS[-2] :]  # shares, not counts
        for a, b, share in zip(_ENDS, _ENDS[1:], _SHARES, strict=False):
            x[:, a:b] *= share / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
        return self._unit(x[:, self.columns])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels) or not self.basis.size:
            return np.full(len(counts), self.prior)
        cosine = self._unit(self._weighted(counts) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER
        total = votes.sum(axis=1)
        good = (votes * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 0, good / np.where(total > 0, total, 1), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of at most ``sample`` labelled rows of the training fold."""
    rows = labels.where(training_fold(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` rows: broadcast
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", "_y").agg(F.min("_t").alias("_t"))  # of several texts of an id the first

    def run(batches) -> Iterator[pa.RecordBatch]:
        for doc_id, y, text in arrow_rows(batches, "_id", "_y", "_t"):
            counts = term_counts(text)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"_id": [doc_id], "_y": [y], "at": pa.array([at], pa.list_(pa.int32())), "n": pa.array([counts[at]], pa.list_(pa.float32()))})

    found = texts.select("_id", "_y", "_t").mapInArrow(trimming(run), "_id long, _y double, at array<int>, n array<float>")
    found = found.orderBy("_id").toArrow()
    texts = [(at.values.to_numpy(), n.values.to_numpy()) for at, n in zip(found["at"], found["n"], strict=True)]
    model = Model(texts, found["_y"].to_numpy())
    del texts, found
    trim()  # the sample's terms need not stay with the driver
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score; a column of that name is replaced."""
    return _scored(docs, model, text_col, "score").select(*restored(docs, "score"), "score")


def _scored(docs: DataFrame, model: Model, text_col: str, *replaced: str) -> DataFrame:
    """The columns of ``docs`` but those replaced as ``c``, and score.  A text travels once: within ``c`` where it is one of its strings."""
    carried = [c for c in docs.columns if c not in replaced]
    inside = text_col in carried and isinstance(docs.schema[text_col].dataType, StringType)
    rows = docs.select(carry(docs, *replaced), *([] if inside else [text_or_empty(text_col).alias("t")]))
    field = f"c{carried.index(text_col)}" if inside else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = pc.struct_field(part.column(0), field) if inside else part.column(1)
                counts = np.stack([term_counts(t or "") for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(counts), pa.float64())], names=["c", "score"])

    return rows.mapInArrow(trimming(run), StructType([rows.schema["c"], StructField("score", DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns."""
    model = fit(docs, labels, text_col=text_col)
    if not len(model.labels):
        if docs.isEmpty():
            return docs
        raise ValueError("no document of the training fold has a label: every score would be 0.5, and no document would stay")
    return _scored(docs, model, text_col).where(F.col("score") >= threshold).select(*restored(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = _scored(docs, fit(docs, labels), "text", "text").select(*restored(docs, "text"), "score")
    return scored.select("doc_id", (~training_fold()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
