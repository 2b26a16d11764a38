"""Rows, bytes and bounds of tables from the footers of their Parquet files; no column is read."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Footers that are read where they are asked for; beyond it they are dealt to tasks, of which there are at most so many.
NEAR, MOST_TASKS = 32, 1_000
_SCHEMA = "path string, rows long, bytes long, low timestamp_ntz, high timestamp_ntz, bounded boolean"


def opened(uri: str):
    """A file of a local folder or of a store that pyarrow knows, for reading in a task."""
    from pyarrow import fs

    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:") :]
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def _plain(moment) -> datetime:
    found = moment.to_pydatetime() if hasattr(moment, "to_pydatetime") else moment
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def footer(path: str, column: str | None = None) -> tuple:
    """(path, rows, bytes, low, high, whether the bounds of ``column`` are known) of a file."""
    with opened(path) as file:
        size, told = file.size(), pq.read_metadata(file)
        low = high = None
        known = True
        for i in range(told.num_row_groups if column else 0):
            group = told.row_group(i)
            stats = next((group.column(j).statistics for j in range(group.num_columns) if group.column(j).path_in_schema == column), None)
            if stats is not None and stats.has_min_max:
                a, b = _plain(stats.min), _plain(stats.max)
                low, high = min(a, low or a), max(b, high or b)
            else:
                known &= stats is not None and stats.has_null_count and stats.null_count == group.num_rows
        return path, told.num_rows, size, low, high, known


def footers(spark: SparkSession, files: list[str], column: str | None = None) -> DataFrame:
    """A row for each of ``files``: path, rows, bytes, and the bounds of a timestamp column where every row group tells them."""
    if len(files) <= NEAR:
        return spark.createDataFrame([footer(f, column) for f in files], _SCHEMA)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [footer(f, column) for f in batch.column(0).to_pylist()]
            types = {"path": pa.string(), "rows": pa.int64(), "bytes": pa.int64(), "low": pa.timestamp("us"), "high": pa.timestamp("us"), "bounded": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types.values())], names=list(types))

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), MOST_TASKS)).mapInArrow(run, _SCHEMA)


def table_figures(tables: dict[str, DataFrame]) -> DataFrame:
    """name, files, rows and bytes of each stored table, which is read nowhere but in its footers."""
    out = None
    for name, table in tables.items():
        own = footers(table.sparkSession, table.inputFiles())
        row = own.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("name"), "files", "rows", "bytes")
        out = row if out is None else out.unionByName(row)
    return out


def newest(table: DataFrame, column: str) -> datetime | None:
    """The greatest value of a stored timestamp column: from the footers, or by a narrow scan where they don't tell it or lie in a store that only Spark reads."""
    files = table.inputFiles()
    try:
        rows = [footer(f, column) for f in files] if len(files) <= NEAR else footers(table.sparkSession, files, column).agg(F.lit(""), F.sum("rows"), F.sum("bytes"), F.min("low"), F.max("high"), F.bool_and("bounded")).collect()
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        rows = []
    if not rows or not all(r[5] for r in rows):
        return table.agg(F.max(column)).first()[0]
    return max((r[4] for r in rows if r[4] is not None), default=None)
