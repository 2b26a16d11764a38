"""Framed binary telemetry as a Spark source: batch and streaming reads of connection files.

A file is read as a stream of frames, by one task where its events are few, or in ranges that many tasks decode (``read_split``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import wire_time
from . import wire_format as wf
from .footers import opened

EVENTS_SCHEMA = pa.schema([(n, t) for n, t in zip("node_id event_id event_type offset_us data core_count implementation_name implementation_version".split(), [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()], strict=True)])
NODES_SCHEMA = pa.schema([(n, t) for n, t in zip("node_id path peer_address flags implementation_name implementation_version gp_version additional_info genesis params".split(), [pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.string()] * 6], strict=True)])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}

#: The columns of Spark's binary file source, and the events of a batch.
FILES_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
BATCH_EVENTS = 4096


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    rows.clear()
    return made


def _hello(frames: Iterator[bytes]) -> dict | None:
    """The handshake that a connection starts with, if it does."""
    try:
        return wf.decode_handshake(next(frames))
    except (StopIteration, wf.WireError):
        return None


def frames_in(file, at: int = 0, end: int | None = None, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, body) of the whole frames of an open file between two places, read ``step`` bytes at a time.

    A length over the limit ends the connection, a cut-off frame is left out, as ``wire_format.split_frames`` has it.
    """
    file.seek(at)
    held, begin = b"", at  # ``held`` starts at the place ``begin`` of the file

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            part = file.read(max(step, n - len(held)))
            if not part:
                return False
            held += part
        return True

    inside = 0
    while end is None or begin + inside < end:
        if not more(inside + 4):
            return
        n = int.from_bytes(held[inside : inside + 4], "little")
        if n > wf.LONGEST_FRAME or not more(inside + 4 + n):
            return
        yield begin + inside, held[inside + 4 : inside + 4 + n]
        inside += 4 + n
        if inside >= step:
            held, begin, inside = held[inside:], begin + inside, 0


def _decoded(bodies: Iterable[bytes], cores: int) -> Iterator[tuple[int, int, dict]]:
    """(time, type, body) of the frames that decode."""
    for body in bodies:
        try:
            yield wf.decode_event(body, cores)
        except wf.WireError:
            continue


def events_of(bodies: Iterable[bytes], node: str, cores: int, name: str, version: str, number: int = 0) -> Iterator[pa.RecordBatch]:
    """Events of a connection's frames, numbered after ``number``, in batches of bounded size; a frame that does not decode takes no number."""
    rows: list[tuple] = []
    for offset, kind, event in _decoded(bodies, cores):
        number += 1
        rows.append((node, number, kind, offset, wf.event_json(event), cores, name, version))
        if len(rows) == BATCH_EVENTS:
            yield _batch(rows, EVENTS_SCHEMA)
    if rows:
        yield _batch(rows, EVENTS_SCHEMA)


def _told(hello: dict) -> tuple[str, int, str, str]:
    return bytes(hello["details"]["peer_id"]).hex(), hello["params"]["core_count"], hello["implementation_name"], hello["implementation_version"]


def connection_events(frames: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The events of a connection's frames; one that starts without a handshake gives nothing."""
    if (hello := _hello(frames)) is not None:
        yield from events_of(frames, *_told(hello))


def decode_connections(files: DataFrame) -> DataFrame:
    """Events of connection files (path, content): each starts with a handshake, whose core count later frames need.

    Event numbers run through a connection, and a file is one task's work; ``read_split`` is for files that are large.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from connection_events(wf.split_frames(content or b""))

    return timed(files.select("content").mapInArrow(run, _ddl(EVENTS_SCHEMA)))


def timed(decoded: DataFrame) -> DataFrame:
    """Decoded events with their time for the offset from the wire format's epoch."""
    return decoded.select(wire_time(F.col("offset_us")).alias("timestamp"), "node_id", "event_id", "event_type", "data", "core_count", "implementation_name", "implementation_version")


def decode_handshakes(files: DataFrame) -> DataFrame:
    """What connection files say of their nodes: address, flags, implementation, genesis (hex) and parameters (JSON)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (hello := _hello(wf.split_frames(content or b""))) is None:
                    continue
                address = hello["details"]["peer_address"]
                where = f"[{bytes(address['ipv6']).hex(':', 2)}]:{address['port']}"
                told = (hello[n] for n in ("flags", "implementation_name", "implementation_version", "gp_version", "additional_info"))
                rows.append((bytes(hello["details"]["peer_id"]).hex(), path, where, *told, bytes(hello["genesis"]).hex(), wf.event_json(hello["params"])))
            if rows:
                yield _batch(rows, NODES_SCHEMA)

    return files.select("path", "content").mapInArrow(run, _ddl(NODES_SCHEMA))


def node_changes(handshakes: DataFrame, files: DataFrame) -> DataFrame:
    """A connect of each file's node at the time of the file, as ``sinks.upsert_nodes`` takes it."""
    times = files.select("path", F.col("modificationTime").alias("at"))
    return handshakes.join(times, "path").select("node_id", F.lit("connect").alias("kind"), "at", F.col("node_id").alias("peer_id"), F.lit(0).cast("bigint").alias("events"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    return decode_connections(spark.read.format("binaryFile").load(path))


_RANGE = "path string, node_id string, core_count int, implementation_name string, implementation_version string, no int, start long, end long"
_RANGE_PA = pa.schema([("path", pa.string()), ("node_id", pa.string()), ("core_count", pa.int32()), ("implementation_name", pa.string()), ("implementation_version", pa.string()), ("no", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
#: Bytes of a range that a task decodes, and the most tasks.
RANGE_BYTES, MOST_TASKS = 16 << 20, 20_000


def frame_index(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole frames of connection files (path): one pass that hops from length to length and decodes the handshake only."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as file:
                    found = frames_in(file)
                    hello = _hello(body for _, body in found)
                    if hello is None:
                        continue
                    told, rows, start, end = _told(hello), [], None, None
                    for at, body in found:
                        if start is not None and at - start >= range_bytes:
                            rows.append((path, *told, len(rows), start, end))
                            start = None
                        start, end = (at if start is None else start), at + 4 + len(body)
                    if start is not None:
                        rows.append((path, *told, len(rows), start, end))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RANGE_PA)], schema=_RANGE_PA)

    return files.select("path").mapInArrow(run, _RANGE)


def read_split(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The events of connection files as ``read_connections`` gives them, a file being as many tasks as it has ranges.

    A range's decodable frames are counted first; the sums of those before it give the numbers of its events.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # no content
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, -(-total // range_bytes)))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = []
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    numbers.append(sum(1 for _ in _decoded((body for _, body in frames_in(file, row["start"], row["end"])), row["core_count"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "frames"])

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    bodies = (body for _, body in frames_in(file, row["start"], row["end"]))
                    yield from events_of(bodies, row["node_id"], row["core_count"], row["implementation_name"], row["implementation_version"], row["before"])

    counted = frame_index(files, range_bytes).repartition(tasks, "path", "no").mapInArrow(count, f"{_RANGE}, frames long")
    earlier = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    placed = counted.withColumn("before", F.coalesce(F.sum("frames").over(earlier), F.lit(0))).drop("frames")
    return timed(placed.repartition(tasks, "path", "no").mapInArrow(decode, _ddl(EVENTS_SCHEMA)))


def stream_connections(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream; admission is bounded by files per micro-batch, so nothing is dropped under load."""
    return decode_connections(spark.readStream.format("binaryFile").schema(FILES_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path))


def with_payload(events: DataFrame) -> DataFrame:
    """``events`` with the JSON payload as a VARIANT column ``payload``."""
    return events.withColumn("payload", F.parse_json("data"))
