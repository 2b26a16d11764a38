"""Byte-level BPE over overlapping chunks, and its inverse.

Pre-tokenising has no memory: from a common boundary on, two runs of the pattern over the
same text agree, up to the end of the shorter one.  So long texts are cut into chunks that
overlap, Spark deals the chunks out, and each is pre-tokenised from its own start.  A chunk's
text holds the start of the next one, so its task can also make the next chunk's run over
their overlap; the first boundary that both runs have is where the two are stitched.  The
chunk encodes its pre-tokens up to there and tells, for every boundary in its own first
overlap, how many ids lie before it; when a document's chunks meet, each leaves out the ids
before the stitch.  So a text moves once and its ids once.

Where an overlap has no common boundary (a pre-token that long), the chunk hands on its
text, and the documents' chunks are joined and pre-tokenised as one until a later chunk's
run is met, so the ids are always those of the whole text.  A chunk cannot see that the
overlap before it failed, but that needs an overlap without a single space between two
other characters (all runs have a boundary there), and such chunks hand on their text too.

A chunk's last pre-tokens may owe their end to the end of the chunk: boundaries count only
up to ``MARGIN`` characters before it.

Defined cases: a null or empty text has no ids; equal ids or repeated rows are rows of
their own (chunks are told apart by a row number, not by the id); decoding gives the raw
bytes, so texts survive whatever they hold.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .tokens import CachedEncoder, arrow_rows, resolve

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, of an overlap, and before a chunk's end in which its boundaries don't count.
CHUNK, OVERLAP, MARGIN = 16_384, 512, 64
#: Pre-tokens in a generation of the cache; merging one anew is cheap, so few are kept.
GENERATION = 80_000
#: All runs of the pattern have a boundary before this space.
_HARD = re.compile(r"\S \S")


@lru_cache(maxsize=2)
def load_ranks(name: str) -> dict[bytes, int]:
    with open(resolve(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=4)
def piece_encoder(name: str, dtype: str = "<u4") -> CachedEncoder:
    """Encodes lists of pre-tokens; each distinct one is merged once by the library."""
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(name), special_tokens={})
    single = encoding._core_bpe.encode_single_piece if hasattr(encoding._core_bpe, "encode_single_piece") else encoding._encode_single_piece
    return CachedEncoder(list, lambda piece: single(piece.encode("utf-8")), dtype, GENERATION)


def pre_tokens(text: str) -> list[str]:
    return _pattern().findall(text)


def boundaries(text: str, start: int) -> np.ndarray:
    """Positions, counted from ``start``, at which the text's pre-tokens begin, and its end."""
    return start + np.cumsum(np.fromiter(map(len, ["", *pre_tokens(text)]), np.int64))


def _chunks(rows: DataFrame, carried: list[str], chunk: int, overlap: int) -> DataFrame:
    """A row a chunk: row (a number of the document), no, at (its start), last, t (its text) and, on the first one, c (the document's columns)."""
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

    c = StructType([f for f in rows.schema.fields if f.name in carried])
    out = StructType([StructField("row", LongType()), StructField("no", LongType()), StructField("at", LongType()), StructField("last", BooleanType()), StructField("t", StringType()), StructField("c", c)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i in range(batch.num_rows):
                text, own = batch.column(1)[i].as_py(), batch.column(0).slice(i, 1)
                starts = range(0, max(1, len(text) - overlap), chunk)  # every chunk is longer than an overlap
                for no, at in enumerate(starts):
                    c = own if no == 0 else pa.nulls(1, own.type)
                    made = [pa.array([row]), pa.array([no]), pa.array([at]), pa.array([no + 1 == len(starts)]), pa.array([text[at : at + chunk + overlap]]), c]
                    yield pa.RecordBatch.from_arrays(made, names=out.names)
                row += 1

    return rows.select(F.struct(*carried).alias("c"), "_t").mapInArrow(run, out)


def _common(left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
    """The first boundary in [low, high) that both runs have."""
    both = np.intersect1d(left[(left >= low) & (left < high)], right)
    return int(both[0]) if len(both) else None


def encode_chunk(text: str, at: int, first: bool, last: bool, encode, width: int, chunk: int, overlap: int):
    """(ids up to the stitch with the next chunk, the stitch, boundaries in the first overlap, ids before each, the text if it may be needed)."""
    pieces = pre_tokens(text)
    begins = at + np.cumsum(np.fromiter(map(len, ["", *pieces]), np.int64))
    end, stop = None, len(pieces)
    if not last:
        end = _common(begins, boundaries(text[chunk:], at + chunk), at + chunk, at + chunk + overlap - MARGIN)
        stop = int(np.searchsorted(begins, at + chunk if end is None else end))
    n_head = 0 if first else min(stop, int(np.searchsorted(begins, at + overlap)))
    heads = [encode([p]) for p in pieces[:n_head]]
    before = np.cumsum([0, *(len(h) // width for h in heads)])[:-1]
    needed = end is None and not last or not first and not _HARD.search(text, 0, overlap - MARGIN)
    return b"".join(heads) + encode(pieces[n_head:stop]), end, begins[:n_head], before, text if needed else None


def join_chunks(parts: list[dict], encode, width: int, chunk: int, overlap: int) -> bytes:
    """The ids of a document from its chunks, in order."""
    out, begin, i = [], 0, 0
    while i < len(parts):
        p = parts[i]
        if p["end"] is not None or i + 1 == len(parts):
            skip = 0 if i == 0 else int(p["before"][p["heads"].index(begin)])
            out.append(p["ids"][skip * width :])
            begin, i = p["end"], i + 1
            continue
        text, origin = p["t"][begin - p["at"] :], begin
        while True:  # one run over this chunk and as many that follow as it takes to meet another run
            i += 1
            q = parts[i]
            text += q["t"][origin + len(text) - q["at"] :]
            if i + 1 == len(parts):
                return b"".join([*out, encode(pre_tokens(text))])
            met = _common(boundaries(text, origin), np.array(parts[i + 1]["heads"], np.int64), q["at"] + chunk, q["at"] + chunk + overlap - MARGIN)
            if met is not None:
                pieces, at = [], origin
                for piece in pre_tokens(text):
                    if at == met:
                        break
                    pieces.append(piece)
                    at += len(piece)
                out.append(encode(pieces))
                begin, i = met, i + 1
                break
    return b"".join(out)


def _encode_long(rows: DataFrame, carried: list[str], ranks: str, chunk: int, overlap: int) -> DataFrame:
    cut = _chunks(rows, carried, chunk, overlap).repartition("row", "no")
    names = ["ids", "end", "heads", "before", "t"]

    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoder, width = piece_encoder(ranks, _narrow(ranks)), _width(ranks)
        for batch in batches:
            made = [encode_chunk(t, at, no == 0, last, encoder.encode, width, chunk, overlap) for no, at, last, t in arrow_rows([batch], "no", "at", "last", "t")]
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], kind) for kind in kinds]
            keep = ["row", "no", "at", "c"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), *columns], names=[*keep, *names])

    parts = cut.mapInArrow(encode, _with(cut.select("row", "no", "at", "c").schema, ids="binary", end="bigint", heads="array<bigint>", before="array<bigint>", t="string"))
    gathered = parts.groupBy("row").agg(F.first("c", ignorenulls=True).alias("c"), F.collect_list(F.struct("no", "at", *names)).alias("parts"))

    def join(batches) -> Iterator[pa.RecordBatch]:
        encoder, width = piece_encoder(ranks, _narrow(ranks)), _width(ranks)
        for batch in batches:
            for i in range(batch.num_rows):
                found = sorted(batch.column(1)[i].as_py(), key=lambda p: p["no"])
                ids = np.frombuffer(join_chunks(found, encoder.encode, width, chunk, overlap), _narrow(ranks)).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([*batch.column(0).slice(i, 1).flatten(), pa.array([ids], pa.binary())], names=[*carried, "ids"])

    return gathered.select("c", "parts").mapInArrow(join, _with(rows.select(*carried).schema, ids="binary"))


@lru_cache(maxsize=2)
def _width(ranks: str) -> int:
    """Bytes of an id while it moves between tasks."""
    return 2 if max(load_ranks(ranks).values()) < 1 << 16 else 4


def _narrow(ranks: str) -> str:
    return f"<u{_width(ranks)}"


def _with(schema, **more: str):
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*schema.fields, *(StructField(n, _parse_datatype_string(t)) for n, t in more.items())])


def encode_documents(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """``docs`` with ids: each text's token ids, as little-endian unsigned 32-bit integers."""
    if chunk <= overlap or overlap <= MARGIN:
        raise ValueError("chunk > overlap > MARGIN is needed")
    carried = [c for c in docs.columns if c not in ("ids", "_t")]
    rows = docs.select(*carried, text_or_empty(text_col).alias("_t"))
    long = F.length("_t") > chunk

    def direct(batches) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(pre_tokens(t)) for t in part.column(len(carried)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*carried, "ids"])

    short = rows.where(~long).mapInArrow(direct, _with(rows.select(*carried).schema, ids="binary"))
    return short.unionByName(_encode_long(rows.where(long), carried, ranks, chunk, overlap))


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` with decoded: the raw bytes of its ids' tokens, one after another; null ids give null."""
    carried = [c for c in encoded.columns if c != "decoded"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        token = {rank: t for t, rank in load_ranks(ranks).items()}.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).select(carried)
                ids = part.column(carried.index("ids")).to_pylist()
                texts = [None if i is None else b"".join(map(token, np.frombuffer(i, "<u4").tolist())) for i in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*carried, "decoded"])

    return encoded.mapInArrow(run, _with(encoded.select(*carried).schema, decoded="binary"))


def query(spark, sf_dir: str) -> DataFrame:
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"))
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
