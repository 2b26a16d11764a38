"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

``write_archives`` writes a record per page into gzip files that are one stream each, as
some crawlers do; such a file can only be read from its start.  ``normalise`` inflates each
file once, a block at a time, rewrites every record as a gzip member of its own and writes
beside the file an index, one JSON line a record, with each member's offset and length.
``read_archives`` goes by that index: a record is one seek and one member.

Every step is a Spark job over the rows of a stored manifest of files.  A task writes under
a name of its attempt and moves the file into place; only files of the manifest are read,
so lost executors and second attempts leave nothing behind that counts.

Which records are revisits is settled on ids and digests alone; a group of equal payloads,
however large, is one key of an aggregate and of a narrow join, and page bodies are
joined by page id only.

Defined cases: null html is an empty payload; repeated rows that are their group's largest
page id are all responses; a row with a null page id is always a response and nothing
refers to it; a null url leaves out the header; control characters in a url are percent-encoded;
an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, open_store, scratch_path, table, task_write, text_or_empty
from .tokens import arrow_rows

#: Payloads from this size on are written once and then referred to.
REVISIT_BYTES = 1000
#: Bytes of records in a file, about; and of a block read from one.
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_GZIP = 31  # zlib's window for gzip framing


def mark_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to (null: a response) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    large = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "key")
    groups = large.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = large.join(groups, "key").where("page_id < refers_to").distinct()
    return rows.join(revisits, ["page_id", "key"], "left").drop("key")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; the digest is of the whole payload, whether it is in the record or not."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


_FILES = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_FILES_SQL = "name string, records long, bytes long"


def _file_row(name: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, records, size), _FILES, strict=True)], schema=_FILES)


def write_archives(marked: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``mark_revisits`` as whole-file gzip streams; returns the stored manifest."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = arrow_rows(batches, "page_id", "url", "payload", "refers_to")
        part, ahead = 0, next(rows, None)
        while ahead is not None:
            name, n = f"pages-{TaskContext.get().partitionId():06d}-{part:04d}.warc.gz", 0

            def stream():
                nonlocal ahead, n
                gz, size = zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0
                while ahead is not None and size < file_bytes:
                    data = record(*ahead)
                    size, n, ahead = size + len(data), n + 1, next(rows, None)
                    yield gz.compress(data)
                yield gz.flush()

            written = task_write(folder, name, stream())
            yield _file_row(name, n, written)
            part += 1

    ordered = marked.sortWithinPartitions("page_id", "url", F.crc32("payload"))
    return materialise(ordered.mapInArrow(run, _FILES_SQL), "archives")


def inflate(f) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, a block at a time."""
    gz = zlib.decompressobj(_GZIP)
    while data := f.read(READ_BYTES):
        while data:
            yield gz.decompress(data, 4 * READ_BYTES)
            while gz.unconsumed_tail:
                yield gz.decompress(gz.unconsumed_tail, 4 * READ_BYTES)
            data = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(_GZIP)
    if not gz.eof and (rest := gz.flush()):
        yield rest


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(head, the record's bytes in parts) of each record; the parts are to be used up before the next record."""
    buffer = bytearray()

    def more() -> bool:
        for block in blocks:
            if block:
                buffer.extend(block)
                return True
        return False

    def body(left: int):
        while left:
            if not buffer and not more():
                raise ValueError("the archive ends within a record")
            part = bytes(buffer[:left])
            del buffer[:left]
            left -= len(part)
            yield part

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        if not buffer and not more():
            return
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("the archive ends within a head")
                return
        if not bytes(buffer[:end]).strip():
            del buffer[: end + 4]
            continue
        head = parse_head(bytes(buffer[:end]))
        yield head, body(end + 4 + int(head["content-length"]) + 4)


def normalise(manifest: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite the manifest's archives to ``folder`` with a gzip member a record and an index beside each; returns the stored manifest."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for name, expected in arrow_rows(batches, "name", "records"):
            store, base = open_store(source)
            lines: list[bytes] = []

            def members():
                offset = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, parts in split_records(inflate(f)):
                        gz, length = zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0
                        for part in parts:
                            if data := gz.compress(part):
                                length += len(data)
                                yield data
                        data = gz.flush()
                        length += len(data)
                        lines.append(json.dumps({"offset": offset, "length": length, "id": head["warc-record-id"], "type": head["warc-type"], "uri": head.get("warc-target-uri")}).encode() + b"\n")
                        offset += length
                        yield data

            size = task_write(folder, name, members())
            if len(lines) != expected:
                raise ValueError(f"{name} has {len(lines)} records; {expected} were written")
            task_write(folder, f"{name}.idx", [b"".join(lines)])
            yield _file_row(name, len(lines), size)

    return materialise(manifest.repartition(max(1, manifest.count())).mapInArrow(run, _FILES_SQL), "archives")


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest (hex), record_type and refers_to of every record, by its index entry."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for (name,) in arrow_rows(batches, "name"):
            store, base = open_store(folder)
            with store.open_input_stream(f"{base}/{name}.idx") as f:
                index = [json.loads(x) for x in f.read().splitlines()]
            lot, size = [], 0
            with store.open_input_file(f"{base}/{name}") as f:
                for n, entry in enumerate(index, 1):
                    f.seek(entry["offset"])
                    data = zlib.decompress(f.read(entry["length"]), _GZIP)
                    head_end = data.index(b"\r\n\r\n")
                    head = parse_head(data[:head_end])
                    block = data[head_end + 4 : head_end + 4 + int(head["content-length"])]
                    http_end = block.index(b"\r\n\r\n")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", block[:http_end])[1])
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                    payload = block[http_end + 4 :] if head["warc-type"] == "response" else None
                    if payload is not None and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"{name} at {entry['offset']}: the payload is not what the record says")
                    lot.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), payload, length, digest.hex(), head["warc-type"], _page(head.get("warc-refers-to"))))
                    size += len(data)
                    if size >= 4 << 20 or n == len(index):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot, strict=True), schema, strict=True)], schema=schema)
                        lot, size = [], 0

    fields = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, fields)


def query(spark, sf_dir: str) -> DataFrame:
    whole, apart = scratch_path(spark, "warc-streams"), scratch_path(spark, "warc")
    written = write_archives(mark_revisits(table(spark, sf_dir, "pages")), whole)
    return read_archives(normalise(written, whole, apart), apart).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), g AS (
  SELECT h, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY h
)
SELECT page_id, payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < latest THEN latest END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.payload_bytes >= 1000
"""
