"""Rows packed by tasks into files of the shared folder, and tasks that read such files by name.

An operator that goes over the same rows several times packs them once, in the form that its
passes need, and then deals names: what is shuffled between passes are small answers to
chunks, never the rows themselves.  A chunk's name is drawn when it is written and is known
through the stored manifest only, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, materialise, open_store, scratch_path, task_write

#: Bytes of one column after which a task closes a chunk, and the most tasks of a pass.
CHUNK_BYTES, MAX_TASKS = 8 << 20, 20_000


def ipc_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def ipc_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def read_chunk(folder: str, name: str) -> pa.Table:
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        return ipc_table(f.read())


def sizes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each string, or elements of each list; null: none."""
    length = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    return pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of at most ``most`` bytes (or elements) of ``column``; a larger row is one alone."""
    waiting, size = [], 0
    for batch in batches:
        sizes, at = sizes_of(batch.column(batch.schema.get_field_index(column))), 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                waiting.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(waiting)
                waiting, size, at = [], 0, i
            size += n + 16  # so that empty rows fill a chunk too
        waiting.append(batch.slice(at))
    if sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


@dataclass
class Chunks:
    """Files of one folder; ``manifest`` (chunk string, units long) is stored."""

    folder: str
    manifest: DataFrame
    count: int
    units: int

    @property
    def tasks(self) -> int:
        return max(1, min(self.count, MAX_TASKS))

    def each(self, run: Callable[[str, pa.Table], Iterable[pa.RecordBatch]], schema, rows: DataFrame | None = None) -> DataFrame:
        """``run`` of every chunk's name and rows; the rows of ``rows`` (chunk, ...; one a chunk) go with it as a dictionary."""
        folder, bare = self.folder, rows is None
        dealt = (self.manifest.select("chunk") if bare else rows).repartition(self.tasks)

        def over(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield from run(row["chunk"], read_chunk(folder, row["chunk"])) if bare else run(row, read_chunk(folder, row["chunk"]))

        return dealt.mapInArrow(over, schema)

    def answered(self, replies: DataFrame, run: Callable[[str, pa.Table, dict], pa.Table], schema) -> DataFrame:
        """``run`` of every chunk's name, rows and answers, from ``replies`` (chunk, asked, bucket, bits): {(asked, bucket): bits}."""
        folder = self.folder
        bare = self.manifest.select("chunk", F.lit(None).cast("int").alias("asked"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits"))
        dealt = bare.unionByName(replies.select("chunk", "asked", "bucket", "bits")).repartition(self.tasks, "chunk")

        def over(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            name = rows[0]["chunk"]
            return run(name, read_chunk(folder, name), {(r["asked"], r["bucket"]): r["bits"] for r in rows if r["bits"] is not None})

        return dealt.groupBy("chunk").applyInArrow(over, schema)

    def delete(self) -> None:
        spark = self.manifest.sparkSession
        delete_path(spark, self.folder)
        delete_path(spark, self.manifest.skein_path)


def pack(rows: DataFrame, column: str, form: Callable[[pa.Table], tuple[pa.Table, int]], label: str, most: int = CHUNK_BYTES) -> Chunks:
    """Chunks of ``rows``, cut by the size of ``column``; ``form`` makes of a chunk's rows what is stored and counts its units."""
    folder = scratch_path(rows.sparkSession, label)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column, most):
            kept, units = form(part)
            name = uuid.uuid4().hex
            task_write(folder, name, [ipc_bytes(kept)])
            yield pa.RecordBatch.from_pydict({"chunk": [name], "units": pa.array([units], pa.int64())})

    manifest = materialise(rows.mapInArrow(run, "chunk string, units long"), f"{label}-manifest")
    count, units = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("units"), F.lit(0))).first()
    return Chunks(folder, manifest, count, units)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
