"""Ball k-means on integer vectors, with exact assignments.

Vectors are packed once into chunks; a round stores the chunks' assignments, sums and radii only.
A cluster is a ball around its centroid.  After the centroids moved, a ball's radius is at most its
old radius and the way its centroid went, so its neighbours are the centroids nearer than twice
that.  A vector at distance d from its own centroid can only leave it for a neighbour within 2 d of that centroid:
those nearer to it than half the way to the nearest neighbour are the stable core and meet no other centroid; the
annuli around it, cut at half the way to each neighbour, meet as many neighbours, nearest first.  All this is
compared on squared integers, so ties are seen, and a vector goes to the smallest number of those nearest.

What passes through the driver are centroids, sums and radii: (dims + 1) numbers for each of ``k`` clusters.

Defined cases: vectors that are null, of another dimension, or hold null or non-finite components take no part;
repeated rows count each; rows without id are assigned, but give no first centroid; with fewer rows than ``k`` there
are as many centroids; components beyond what squared distances hold exactly (2^26 at 64 dimensions, after
scaling) raise a ValueError; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .chunks import Chunks, pack
from .common import discard, materialise, table

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Components that a chunk holds.
CHUNK_COMPONENTS = 1 << 20
_STATE = "chunk string, own binary, sums array<long>, radii array<long>"


def limit_of(dims: int) -> int:
    """Components up to this keep four times a squared distance within 63 bits."""
    return isqrt((1 << 63) // (16 * dims)) - 1


def cells(rows: pa.Table, vector_col: str, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and floor(scale * x) of their components."""
    column = rows.column(vector_col).combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    whole = np.isfinite(flat).all(axis=1)
    scaled = np.floor(scale * flat[whole])
    if scaled.size and np.abs(scaled).max() > limit_of(dims):
        raise ValueError(f"a scaled component is beyond {limit_of(dims)}, where squared distances are no longer exact")
    return at[whole], scaled.astype(np.int32)


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> Chunks:
    """Chunks of (id, the bytes of its integer components)."""

    def form(rows: pa.Table) -> tuple[pa.Table, int]:
        at, kept = cells(rows, "v", dims, scale)
        wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(kept), [None, pa.py_buffer(np.ascontiguousarray(kept))])
        return pa.table({"id": rows.column("i").take(pa.array(at)), "cells": wide}), len(at)

    return pack(vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")), "v", form, "vectors", CHUNK_COMPONENTS)


def matrix(rows: pa.Table, dims: int) -> np.ndarray:
    data = b"".join(rows.column("cells").to_pylist())
    return np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, id_col: str, vector_col: str, salt: str = "1:") -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest salted hashes, of those that take part (equal ids: the smaller vector first)."""
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & F.forall(vector_col, fine))
    name = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256).alias("name")
    return [r["x"] for r in usable.select(name, x.alias("x")).orderBy("name", "x").limit(k).collect()]


class Balls:
    """Centroids with the neighbours that their balls' radii allow, nearest first."""

    def __init__(self, centroids: np.ndarray, reach: list[int] | None = None):
        """``reach``: of each ball an upper bound of its radius; none: all others are neighbours."""
        self.centroids = centroids
        self.neighbours, self.apart = [], []
        for i, c in enumerate(centroids):
            far = ((centroids - c) ** 2).sum(axis=1)
            near = [j for j in np.lexsort((np.arange(len(far)), far)).tolist() if j != i and (reach is None or int(far[j]) <= 4 * reach[i] ** 2)]
            self.neighbours.append(near)
            self.apart.append(far[near])

    def assign(self, data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every vector, from the cluster that it was in."""
        cluster, nearest = own.copy(), np.zeros(len(data), np.int64)
        for i in np.unique(own).tolist():
            members = np.flatnonzero(own == i)
            best = ((data[members] - self.centroids[i]) ** 2).sum(axis=1)
            who = np.full(len(members), i, own.dtype)
            annulus = np.searchsorted(self.apart[i], 4 * best, side="right")  # 0: the stable core
            for step, j in enumerate(self.neighbours[i][: annulus.max()]):
                ring = np.flatnonzero(annulus > step)
                d = ((data[members[ring]] - self.centroids[j]) ** 2).sum(axis=1)
                better = (d < best[ring]) | ((d == best[ring]) & (j < who[ring]))
                best[ring[better]], who[ring[better]] = d[better], j
            cluster[members], nearest[members] = who, best
        return cluster, nearest


def _round(chunks: Chunks, state: DataFrame, balls: Balls, dims: int) -> DataFrame:
    """Every vector to its nearest centroid; by chunk the assignments, sums (with counts) and squared radii."""
    k = len(balls.centroids)

    def run(row: dict, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data = matrix(rows, dims)
        cluster, far = balls.assign(data, np.frombuffer(row["own"], np.uint32) if row["own"] else np.zeros(len(data), np.uint32))
        sums, radii = np.zeros((k, dims + 1), np.int64), np.full(k, -1, np.int64)
        for i in np.unique(cluster):
            mine = cluster == i
            sums[i, :dims], sums[i, dims], radii[i] = data[mine].sum(axis=0), mine.sum(), far[mine].max()
        yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "own": [cluster.tobytes()], "sums": [sums.ravel()], "radii": [radii]})

    return materialise(chunks.each(run, _STATE, state), "balls")


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Means of the clusters, rounded down (empty ones stay), and how far their balls reach around them."""
    k, dims = centroids.shape
    sums = {r["pos"]: int(r["n"]) for r in state.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("n")).collect()}
    radii = {r["pos"]: r["r"] for r in state.select(F.posexplode("radii")).groupBy("pos").agg(F.max("col").alias("r")).collect()}
    moved, reach = centroids.copy(), [0] * k
    for i in range(k):
        count = sums.get(i * (dims + 1) + dims, 0)
        if count:
            moved[i] = [sums[i * (dims + 1) + j] // count for j in range(dims)]
            way = sum((int(a) - int(b)) ** 2 for a, b in zip(moved[i], centroids[i]))
            reach[i] = isqrt(radii[i]) + isqrt(way) + 2
    return moved, reach


def cluster_vectors(vectors: DataFrame, start: list[list[int]], rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector after ``rounds`` of moving the centroids ``start``, stored, and the final centroids."""
    id_type = vectors.schema[id_col].dataType
    schema = StructType([StructField(id_col, id_type), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not start:
        return vectors.sparkSession.createDataFrame([], schema), np.empty((0, dims), np.int64)
    chunks = packed_vectors(vectors, id_col, vector_col, dims, scale)
    centroids, reach = np.array(start, np.int64), None
    state = chunks.manifest.select("chunk", F.lit(None).cast("binary").alias("own"))
    for _ in range(rounds):
        following = _round(chunks, state, Balls(centroids, reach), dims)
        if hasattr(state, "skein_path"):
            discard(state)
        state = following
        centroids, reach = _moved(state, centroids)
    last = Balls(centroids, reach)

    def finish(row: dict, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data = matrix(rows, dims)
        cluster, far = last.assign(data, np.frombuffer(row["own"], np.uint32) if row["own"] else np.zeros(len(data), np.uint32))
        yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(cluster.astype(np.int32)), pa.array(far)], names=[id_col, "cluster", "distance"])

    found = materialise(chunks.each(finish, schema, state.select("chunk", "own")), "clusters")
    if hasattr(state, "skein_path"):
        discard(state)
    chunks.delete()
    return found, centroids


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, centroids = cluster_vectors(vectors, first_centroids(vectors, K, DIMS, SCALE, "vec_id", "embedding"))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # a row a cluster on either side: K rows
    facts = spark.createDataFrame(names, "cluster int, centroid_sha256 string").join(inertia, "cluster").crossJoin(F.broadcast(found.agg(F.sum("distance").alias("inertia"))))
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = [
        f"""x0 AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {DIMS}
), x AS MATERIALIZED (
  SELECT row, unnest(range({DIMS})) AS i, unnest(v)::BIGINT AS c FROM x0
), c0 AS MATERIALIZED (
  SELECT k, unnest(range({DIMS})) AS i, unnest(v)::BIGINT AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM x0 WHERE vec_id IS NOT NULL QUALIFY k < {K})
)"""
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT row, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT x.row, y.k, sum((x.c - y.c) * (x.c - y.c))::BIGINT AS d FROM x JOIN c{t} y ON x.i = y.i GROUP BY x.row, y.k) GROUP BY row
)""")
        if t < ROUNDS:
            steps.append(f"""m{t} AS (
  SELECT a.k, x.i, sum(x.c)::BIGINT AS s, count(*) AS n FROM x JOIN a{t} a ON a.row = x.row GROUP BY a.k, x.i
), c{t + 1} AS MATERIALIZED (
  SELECT y.k, y.i, CASE WHEN m.n IS NULL THEN y.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c FROM c{t} y LEFT JOIN m{t} m ON m.k = y.k AND m.i = y.i
)""")
    return f"""WITH {', '.join(steps)}, h AS (
  SELECT k, sha256(string_agg(c, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k
)
SELECT vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM x0 JOIN a{ROUNDS} a USING (row) JOIN h USING (k)
"""


ORACLE = _oracle()
