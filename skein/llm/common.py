"""What the operators of this subpackage share: tables, scratch space, task-side files."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is a temporary folder made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("skein.local.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("skein.local.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.skein_path = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised DataFrames that no later step reads."""
    for df in frames:
        delete_path(df.sparkSession, df.skein_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def carry(df: DataFrame, *replaced: str):
    """The columns of ``df`` but those replaced, as one struct ``c``, whatever their names; ``restored`` takes them out of it."""
    kept = [c for c in df.columns if c not in replaced]
    return F.struct(F.lit(True).alias("row"), *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept))).alias("c")


def restored(df: DataFrame, *replaced: str) -> list:
    """The columns that ``carry`` put into ``c``, under the names that ``df`` has."""
    return [F.col(f"c.c{i}").alias(c) for i, c in enumerate(c for c in df.columns if c not in replaced)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def open_store(uri: str):
    """(pyarrow filesystem, path) of a folder URI; works inside tasks for file, hdfs, s3 and gs."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def task_write(uri_dir: str, name: str, chunks) -> int:
    """Write one file of a task under a name of the attempt, then move it into place.

    A task that runs twice writes the same bytes, so the move may replace an earlier copy.
    """
    store, base = open_store(uri_dir)
    store.create_dir(base, recursive=True)
    final = str(PurePosixPath(base) / name)
    part = f"{final}.{os.getpid()}-{uuid.uuid4().hex[:8]}.part"
    written = 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            written += len(chunk)
    store.move(part, final)
    return written


def trim() -> None:
    """Give memory that was freed back to the system, where its allocator can: a process that stays would hold on to it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rest(spark: SparkSession) -> None:
    """Give back what the driver no longer needs between stages of many jobs: a collection there also lets Spark's cleaner drop shuffles and broadcasts of plans that are gone."""
    gc.collect()  # Python's handles of plans first
    spark.sparkContext._jvm.System.gc()
    trim()


def trimming(run):
    """``run`` of a task's batches, after which its worker, which Spark keeps for other tasks, is trimmed."""

    def then(batches):
        yield from run(batches)
        trim()

    return then


#: Rows of one or two numbers that a broadcast may have (some 16 MB).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, narrow) marked for broadcast if its counted rows are few; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
