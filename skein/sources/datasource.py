"""Connection files as a Spark data source: ``spark.read.format("skein_frames")`` and ``spark.readStream``.

A file is a partition, read by the task as a stream of frames, in batches of bounded size; only names pass
through the driver.  Large files are better read in ranges (``frames.read_split``).  The stream takes new files in the order of their names, so writers name them by time (it fails on one that comes late), and
moves them into the folder when they are whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .frames import EVENTS_SCHEMA, _ddl, connection_events, frames_in

#: Files that a micro-batch takes at most, unless the option ``files`` says otherwise.
FILES = 100


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(path: str, after: str = "") -> list[str]:
    """The files of a folder whose names follow ``after``, in order."""
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f.base_name > after)


class _File(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


def _read(part: _File) -> Iterator[pa.RecordBatch]:
    store, base = _store(part.path)
    with store.open_input_file(f"{base}/{part.name}") as f:
        yield from connection_events(body for _, body in frames_in(f))


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(self.path, name) for name in _names(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class FrameStreamReader(DataSourceStreamReader):
    """An offset is the name of the last file taken."""

    def __init__(self, options: dict):
        self.path, self.files = options["path"], int(options.get("files", FILES))
        self.last = None
        self.known: set[str] = set()

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        before = {name for name in _names(self.path) if name <= (self.last or "")}
        if self.known and (late := before - self.known):
            raise ValueError(f"files named before {self.last}, the last one taken, came after it and would be lost: {sorted(late)[:5]}")
        names = _names(self.path, self.last or "")[: self.files]
        self.known = before | set(names)
        self.last = names[-1] if names else (self.last or "")
        return {"file": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last = max(self.last or "", end["file"])
        return [_File(self.path, name) for name in _names(self.path, start["file"]) if name <= end["file"]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class FrameSource(DataSource):
    """Options: ``path``, a folder of connection files; ``files``, those of a micro-batch at most."""

    @classmethod
    def name(cls) -> str:
        return "skein_frames"

    def schema(self) -> str:
        return _ddl(EVENTS_SCHEMA)

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
