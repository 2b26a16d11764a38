"""Exact nearest neighbours by a block matrix join over quantised tiles.

Tasks pack the candidates where they lie into blocks of int8 vectors and write them once to
the shared folder, the original vectors in a file beside them; the queries likewise.  The
grid that is joined holds names only: a cell is some files of queries, which its task holds in memory, and some
of the candidate files, which it reads once, block by block.  So what is shuffled grows with
the queries, whatever the number of candidates, and a candidate is read once for every ``QUERY_FILES`` files of queries.

A tile's product of int8 vectors (summed exactly) gives every inner product up to a bound
that follows from the rounding errors: with x = s*X + e and y = t*Y + f, the product differs
from s*t*(X.Y) by no more than |e||y| + |x||f| + |e||f|.  Pairs whose upper bound reaches the
k-th best score seen so far survive, are computed again in double precision on the original
vectors, and merged by heaps, first in the task, then over the grid.  A block's original
vectors are read only if a pair of it survives.  A pair that ties with the k-th stays in, so
ties go to the smaller id.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite number
take no part, nor do rows without id or of another dimension than the table's most frequent
one (ties: the larger); repeated candidate rows are candidates each, save those with the
query's own id; repeated query rows are one query, and rows of one id with different vectors
are queries each, told apart by their vectors only; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, discard, materialise, open_store, scratch_path, table, task_write
from .tokens import arrow_rows

K = 20
#: Vectors of a candidate block, blocks of a candidate file, queries of a query file.
BLOCK, BLOCKS_A_FILE, QUERIES = 1024, 64, 1024
#: Files of queries and of candidates of a cell of the grid; where there are few, as many cells as ``LEAST_CELLS`` either way.
QUERY_FILES, CANDIDATE_FILES, LEAST_CELLS = 16, 16, (4, 8)
#: The most tasks of the grid.
MAX_TASKS = 20_000
#: More than a product loses when it is too small for a double.
VANISHED = 1e-322
_HEAD = struct.Struct("<2Q")  # vectors of a block, offset of its original vectors in the file beside


class _Block:
    """``n`` vectors: ids, int8 forms, scales, error norms and norms; the original vectors apart."""

    def __init__(self, dim: int, ids, quant, scale, slack, norm, data=None, at: int = 0):
        self.dim, self.ids, self.bytes, self.scale, self.slack, self.norm, self.data, self.at = dim, ids, quant, scale, slack, norm, data, at
        # float32 products of int8 vectors are exact up to 1,040 dimensions (127 * 127 * dim < 2^24); beyond, float64
        self.quant = quant.astype(np.float32 if dim <= 1040 else np.float64)

    @classmethod
    def of(cls, ids: list[int], rows: list) -> _Block:
        data = np.array(rows, np.float64)
        top = np.abs(data).max(axis=1)
        scale = top / 127
        # numbers so small that their scale is zero are quantised to nothing, and their norm is the error
        quant = np.rint(data / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
        norm = lambda x: top * np.linalg.norm(x / top[:, None], axis=1)  # noqa: E731  squares neither overflow nor vanish
        return cls(data.shape[1], np.array(ids, np.int64), quant, scale, norm(data - scale[:, None] * quant), norm(data), data)

    def packed(self, at: int) -> bytes:
        return _HEAD.pack(len(self.ids), at) + b"".join(x.tobytes() for x in (self.ids, self.bytes, self.scale, self.slack, self.norm))


def _blocks(data: bytes, dim: int) -> Iterator[_Block]:
    at = 0
    while at < len(data):
        n, beside = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        parts = []
        for dtype, width in ((np.int64, 1), (np.int8, dim), (np.float64, 1), (np.float64, 1), (np.float64, 1)):
            parts.append(np.frombuffer(data, dtype, n * width, at))
            at += parts[-1].nbytes
        parts[1] = parts[1].reshape(n, dim)
        yield _Block(dim, *parts, at=beside)


def write_blocks(vectors: DataFrame, dim: int, folder: str, label: str, block: int = BLOCK, blocks_a_file: int = BLOCKS_A_FILE, dtype: str = "<f8") -> DataFrame:
    """Write ``vectors`` (id, v) to ``folder``, in ``dtype`` beside their int8 blocks; returns the stored names of the files.

    Files are named by task, so a task that runs twice writes the same ones.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n_files = TaskContext.get().partitionId(), 0
        ids, rows, quants, beside, at = [], [], [], [], 0

        def close_block() -> None:
            nonlocal at
            made = _Block.of(ids, rows)
            quants.append(made.packed(at))
            beside.append(made.data.astype(dtype).tobytes())
            at += len(beside[-1])
            ids.clear(), rows.clear()

        def close_file() -> pa.RecordBatch:
            nonlocal n_files, at
            name = f"{label}-{task:06d}-{n_files:06d}"
            task_write(folder, f"{name}.vec", beside)
            task_write(folder, f"{name}.int8", quants)
            quants.clear(), beside.clear()
            n_files, at = n_files + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for i, v in arrow_rows(batches, "id", "v"):
            ids.append(i)
            rows.append(v)
            if len(ids) == block:
                close_block()
                if len(quants) == blocks_a_file:
                    yield close_file()
        if ids:
            close_block()
        if quants:
            yield close_file()

    return materialise(vectors.mapInArrow(run, "name string"), f"{label}-files")


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components whatever the number of rows."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


class _Search:
    """The best ``k`` of each query of a block so far: heaps of (score, -id)."""

    def __init__(self, queries: _Block, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list] = [[] for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf)  # no pair under it is among the best

    def add(self, c: _Block, original) -> None:
        """Take the block ``c`` in; ``original()`` gives its vectors in double precision."""
        q, k = self.q, self.k
        tile = q.quant @ c.quant.T
        scales = np.concatenate([q.scale, c.scale])
        if scales.max() > 1e15 or scales.min() < 1e-15:  # float32 could overflow
            tile = tile.astype(np.float64)
        if np.isneginf(self.floor).any() and len(c.ids) > k:  # a first floor: the k-th best lower bound of the tile
            near, reach = self._bounds(tile, c, slice(None), slice(None))
            low = np.where(q.ids[:, None] == c.ids, -np.inf, near - reach)
            self.floor = np.maximum(self.floor, np.partition(low, -k, axis=1)[:, -k])
        # what no pair of a row can go beyond, so that one product and one comparison a pair do for nearly all of them
        most = q.slack * (c.norm + c.slack).max() + q.norm * c.slack.max() + 1e-6 * q.norm * c.norm.max() + VANISHED * q.dim
        with np.errstate(divide="ignore"):
            least = np.where(q.scale > 0, (self.floor - most) / q.scale, -np.inf)
        row, col = np.nonzero(tile * c.scale.astype(tile.dtype) >= (least - 1e-6 * np.abs(least)).astype(tile.dtype)[:, None])
        data = None
        for at in range(0, len(row), 1 << 16):
            r, j = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            near, reach = self._bounds(tile, c, r, j)
            stay = (near + reach >= self.floor[r]) & (q.ids[r] != c.ids[j])
            if stay.any():
                data = original() if data is None else data
                self._push(r[stay], exact_products(q.data[r[stay]], data[j[stay]]), c.ids[j[stay]])

    def _bounds(self, tile: np.ndarray, c: _Block, r, j) -> tuple[np.ndarray, np.ndarray]:
        """Products of the tile's pairs (r, j) and how far they may be off; the last term covers the double arithmetic itself."""
        q = self.q
        pick = (lambda x: x[:, None]) if isinstance(r, slice) else (lambda x: x[r])
        near = tile[r, j].astype(np.float64) * pick(q.scale) * c.scale[j]
        return near, pick(q.slack) * (c.norm + c.slack)[j] + pick(q.norm) * c.slack[j] + 1e-12 * pick(q.norm) * c.norm[j] + VANISHED * q.dim

    def _push(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = [h[0] if len(h) == self.k else (-np.inf, -np.inf) for h in self.heaps]
        bar, tie = np.array([w[0] for w in worst]), np.array([w[1] for w in worst], np.float64)
        better = (scores > bar[rows]) | (scores == bar[rows]) & (-ids.astype(np.float64) >= tie[rows])
        for i, score, vec in zip(rows[better].tolist(), scores[better].tolist(), ids[better].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))
        for i in np.unique(rows[better]).tolist():
            if len(self.heaps[i]) == self.k:
                self.floor[i] = max(self.floor[i], self.heaps[i][0][0])

    def found(self, name: str) -> pa.RecordBatch:
        best = [sorted(h, reverse=True) for h in self.heaps]
        columns = [[name] * len(best), range(len(best)), self.q.ids, [[s for s, _ in b] for b in best], [[-v for _, v in b] for b in best]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


_FOUND = pa.schema([("name", pa.string()), ("i", pa.int32()), ("query_id", pa.int64()), ("scores", pa.list_(pa.float64())), ("vecs", pa.list_(pa.int64()))])
_RANKED = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def grid_of(query_files: int, candidate_files: int) -> tuple[int, int]:
    """Into how many parts the files of queries and those of candidates are dealt."""
    parts = lambda files, a_cell, least: max(1, min(files, least), -(-files // a_cell))
    return parts(query_files, QUERY_FILES, LEAST_CELLS[0]), parts(candidate_files, CANDIDATE_FILES, LEAST_CELLS[1])


def _dealt(files: DataFrame, parts: int, key: str, names: str) -> DataFrame:
    """A row a part with the sorted names of its files, dealt by the task and number that a name ends with."""
    number = F.aggregate(F.slice(F.split("name", "-"), -2, 2), F.lit(0), lambda n, x: n + x.cast("int"))
    return files.groupBy(F.pmod(number, F.lit(parts)).alias(key)).agg(F.sort_array(F.collect_list("name")).alias(names))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, blocks_a_file: int = BLOCKS_A_FILE, a_query_file: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` largest inner products among ``vectors``, its own id left out."""
    spark = vectors.sparkSession
    single = all(df.schema[vec_col].dataType.elementType.typeName() == "float" for df in (vectors, queries))
    dtype = "<f4" if single else "<f8"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))

    candidates = usable(vectors)
    sizes = candidates.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 1
    of_dim, folder = F.size("v") == dim, scratch_path(spark, "vector-blocks")
    files = write_blocks(candidates.where(of_dim), dim, folder, "candidates", block, blocks_a_file, dtype)
    asked = write_blocks(usable(queries).where(of_dim).dropDuplicates(["id", "v"]), dim, folder, "queries", a_query_file, 1, dtype)

    rows, columns = grid_of(asked.count(), files.count())
    # names only, of some files a cell
    cells = _dealt(asked, rows, "r", "asked").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).join(_dealt(files, columns, "s", "names"), "s")
    cells = cells.select("asked", "names").repartition(max(1, min(rows * columns, MAX_TASKS)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)

        def read(name: str, start: int = 0, size: int | None = None) -> bytes:
            with store.open_input_file(f"{base}/{name}") as f:
                f.seek(start)
                return f.read(size)

        def original(name: str, block: _Block) -> np.ndarray:
            n = len(block.ids) * dim
            return np.frombuffer(read(f"{name}.vec", block.at, n * np.dtype(dtype).itemsize), dtype).reshape(-1, dim).astype(np.float64)

        for asked, names in arrow_rows(batches, "asked", "names"):
            searches = []
            for name in asked:
                (held,) = _blocks(read(f"{name}.int8"), dim)
                held.data = original(name, held)
                searches.append((name, _Search(held, k)))
            for other in names:
                for c in _blocks(read(f"{other}.int8"), dim):
                    vectors = cache(lambda other=other, c=c: original(other, c))  # read once, and only if a pair survives
                    for _, search in searches:
                        search.add(c, vectors)
            for name, search in searches:
                yield search.found(name)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        """The best of every query, whose rows are neighbours."""
        key, lists, out = None, [], []

        def best() -> None:
            rows = heapq.merge(*([(-s, v) for s, v in zip(ss, vv, strict=True)] for _, ss, vv in lists))
            out.extend((lists[0][0], r, v, -s) for r, (s, v) in zip(range(1, k + 1), rows))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RANKED, strict=True)], schema=_RANKED)
            out.clear()
            return made

        for name, i, *row in arrow_rows(batches, "name", "i", "query_id", "scores", "vecs"):
            if (name, i) != key:
                if lists:
                    best()
                if len(out) >= 8192:
                    yield flush()
                key, lists = (name, i), []
            lists.append(row)
        if lists:
            best()
        if out:
            yield flush()

    partial = cells.mapInArrow(run, "name string, i int, query_id long, scores array<double>, vecs array<long>")
    # the lists of all queries are stored, and the blocks deleted
    ranked = materialise(partial.repartition("name", "i").sortWithinPartitions("name", "i").mapInArrow(merge, "query_id long, rank int, vec_id long, score double"), "neighbours")
    delete_path(spark, folder)
    discard(files, asked)
    return ranked


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), q AS (
  SELECT row_number() OVER () AS qn, vec_id, e FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0)
), s AS (
  SELECT q.qn, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) <= 20
"""
