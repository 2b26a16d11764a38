"""Exact deduplication on DataFrame functions only.

Rows are grouped by a 128-bit hash of the normalised text together with the text
itself: the hash decides where a group lies and rejects nearly every comparison
at once, the aggregate then compares the bytes of rows whose hashes agree, so two
texts that share a hash stay apart.  Copies collapse in the partial aggregate
before the shuffle, whatever their number.  A second, narrow join (ids and hashes,
no text) takes the result back to every row; a hot group is one skewed key of that
join, which adaptive execution splits.

Defined cases: null text counts as empty; rows with a null id take part in a group
and its size, but an id can only be kept if it is not null (all ids null: keep_id is
null and ``kept`` is false); repeated rows of the kept id are all marked kept, since
the id is the document's name; other columns, of whatever name, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carry, quoted, restored, text_or_empty

#: Runs of white space other than a single space; those are already normal.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_or_empty(text_col), _RUNS, " ")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: _h (128-bit hash), _s (SHA-256), keep_id, group_size."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_t")).select("_id", "_t", F.unhex(F.md5("_t")).alias("_h"))
    groups = rows.groupBy("_h", "_t").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "keep_id", "group_size")


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; columns of these names are replaced."""
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    rows = docs.select(carry(docs, *made), F.col(id_col).alias("i"), normalised(text_col).alias("_t"))
    rows = rows.select("c", "i", F.unhex(F.md5("_t")).alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_s"))
    joined = rows.join(exact_classes(docs, id_col, text_col), ["_h", "_s"])
    return joined.select(
        *restored(docs, *made),
        "keep_id",
        "group_size",
        F.coalesce(F.col("i") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its own columns: the one with the least id (null ids last).

    Whole rows are aggregated, so rows without id, or with one that others share, are decided each for itself.
    A text that is normal already travels once, as the group's key.
    """
    text, norm = F.col(text_col), normalised(text_col)
    rows = docs.select(norm.alias("_t"), F.struct(F.col(id_col).isNull().alias("_0"), F.col(id_col).alias("_1"), F.xxhash64(text).alias("_2")).alias("_order"),
                       F.struct(F.when(~text.cast("string").eqNullSafe(norm), text).alias("_own"), text.isNull().alias("_null"), *(F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(docs.columns) if c != text_col)).alias("_row"))
    kept = rows.groupBy(F.unhex(F.md5("_t")).alias("_h"), "_t").agg(F.min_by("_row", "_order").alias("_row"))
    own = F.when(~F.col("_row._null"), F.coalesce(F.col("_row._own"), F.col("_t").cast(docs.schema[text_col].dataType)))
    return kept.select(*(own.alias(c) if c == text_col else F.col(f"_row._c{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_exact(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
