"""WARC archives with a two-level capture index.

Pages become WARC 1.1 records, one gzip member each, so that any record can be read alone from its offset. Payloads that were
already stored are revisit records that name the first one. The index sorts reversed-host URL keys into compressed blocks;
a sparse directory keeps the first key and place of each block. A lookup binary-searches the directory, reads one block's
range, and then the record's range.

Archives and index are files in the folder that all executors share, reached through its URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import attach, table
from tablegauge.session import scratch_folder, staged

BLOCK_LINES = 2000
#: Pages carry no fetch time; records get this date unless the caller names another.
DATE = "2024-01-01T00:00:00Z"
_PLACES = "page_id {id}, url string, url_key string, payload_digest string, payload_bytes bigint, record_type string, refers_to {id}, archive string, offset bigint, length bigint"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = open_folder(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then port, path and query, in lower case, without scheme, ``www`` and fragment."""
    rest = (url or "").strip().lower().split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host, question, query = host.partition("?")
    name, colon, port = host.rpartition("@")[2].partition(":")
    labels = name.removeprefix("www.").split(".")
    port = f":{port}" if colon and port not in ("80", "443") else ""
    return f"{','.join(reversed(labels))}{port}){slash or '/'}{path}{question}{query}" if rest else ""


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member. A revisit carries headers only."""
    named = lambda key: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{key}").urn
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{named(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {json.dumps(url or '', ensure_ascii=True)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {json.dumps(page_id, default=str)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{named(refers_to)}>", f"X-Refers-To-Page: {json.dumps(refers_to, default=str)}",
        ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, body) of one gzip member."""
    raw = zlib.decompress(member, 47)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                   date: str = DATE) -> DataFrame:
    """Write a record per row into archives under ``folder``, one archive per task; returns the captures: url key, digest,
    record type and the archive, offset and length of the record.

    A null html is an empty payload, a null url the empty key. Of equal payloads (SHA-256) of at least ``min_bytes`` bytes
    the smallest page id is the response, others revisit it; rows that repeat that very id, and rows without an id, are responses. Other columns are
    ignored. The first payload of a group is attached by its digest: hot payloads are broadcast ids, others a join.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    small = F.octet_length("_html") < min_bytes
    rows = rows.withColumn("_same", F.when(~small & F.col("_id").isNotNull(), F.unhex(F.sha2(F.col("_html").cast("binary"), 256))))
    first = rows.filter("_same is not null").groupBy("_same").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    # only payloads that occur twice are joined
    rows = attach(rows, staged(first, "payloads"), "_same", "_n").drop("_n", "_same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"  # a repeated task writes an archive of its own, which alone is indexed
        stream, offset = None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload = r["_html"].encode()
                refers = r["_first"] if r["_first"] is not None and r["_first"] != r["_id"] else None
                digest = _sha1(payload)
                member = record(r["_id"], r["_url"], payload, digest, refers, None, date)
                if stream is None:
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                stream.write(member)
                out.append((r["_id"], r["_url"], url_key(r["_url"]), digest, len(payload), "response" if refers is None else "revisit",
                            refers, f"{folder}/{name}", offset, len(member)))
                offset += len(member)
            yield _batch(out, schema)
        if stream is not None:
            stream.close()

    ddl = _PLACES.format(id=kind)
    schema = _arrow(ddl)
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    return rows.select("_id", "_url", "_html", "_first").mapInArrow(run, ddl)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by url key into compressed blocks under ``folder``; returns the directory: one row per block with its
    first and last key, index file, offset and length.

    A range sort by (key, archive, offset) cuts hot keys over several tasks, blocks and files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        name = f"captures-{uuid.uuid4().hex}.cdx.gz"
        stream, offset, held, out = None, 0, [], []

        def flush() -> None:
            nonlocal stream, offset
            if stream is None:
                stream = system.open_output_stream(f"{base}/{name}", compression=None)
            member = gzip.compress("".join(line for _, line in held).encode(), 6, mtime=0)
            stream.write(member)
            out.append((held[0][0], held[-1][0], f"{folder}/{name}", offset, len(member), len(held)))
            offset += len(member)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                held.append((r["url_key"], json.dumps(r, default=str) + "\n"))
                if len(held) == block_lines:
                    flush()
            if out:
                yield _batch(out, schema)
                out.clear()
        if held:
            flush()
        if stream is not None:
            stream.close()
        if out:
            yield _batch(out, schema)

    ddl = "first_key string, last_key string, index_file string, offset bigint, length bigint, lines bigint"
    schema = _arrow(ddl)
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    ranged = captures.repartitionByRange("url_key", "archive", "offset").sortWithinPartitions("url_key", "archive", "offset")
    return ranged.mapInArrow(run, ddl)


class Lookup:
    """Finds captures by URL. ``directory`` rows are (first_key, last_key, index_file, offset, length), in any order."""

    def __init__(self, directory: list[tuple]):
        self.blocks = sorted(directory)
        self.first = [b[0] for b in self.blocks]

    def captures(self, url: str) -> list[dict]:
        key, out = url_key(url), []
        at = bisect_right(self.first, key) - 1
        while at >= 0 and self.blocks[at][1] >= key:
            lines = zlib.decompress(read_range(*self.blocks[at][2:5]), 47).decode().splitlines()
            out = [c for c in map(json.loads, lines) if c["url_key"] == key] + out
            at -= 1
        return out


def read_payload(capture: dict) -> bytes:
    """The body of a response capture, by one range read."""
    return parse_record(read_range(capture["archive"], capture["offset"], capture["length"]))[2]


def read_back(directory: DataFrame, kind: str) -> DataFrame:
    """Every record of the index, read from its archive: ids, digest (recomputed for responses), type and reference.

    Blocks are dealt over the cluster; each task reads its blocks' captures and then the records' ranges, archive by archive."""
    ddl = f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                lines = zlib.decompress(read_range(b["index_file"], b["offset"], b["length"]), 47).decode().splitlines()
                by_file: dict[str, list[dict]] = {}
                for c in map(json.loads, lines):
                    by_file.setdefault(c["archive"], []).append(c)
                out = []
                for name, captures in by_file.items():
                    system, path = open_folder(name)
                    with system.open_input_file(path) as f:
                        for c in sorted(captures, key=lambda c: c["offset"]):
                            out.append(_checked(*parse_record(f.read_at(c["length"], c["offset"]))))
                yield _batch(out, schema)

    # blocks are few; without a shuffle one task could hold all of a small directory
    return directory.select("index_file", "offset", "length").repartition(
        max(1, directory.sparkSession.sparkContext.defaultParallelism), "index_file", "offset").mapInArrow(run, ddl)


def _checked(head: dict[str, str], http: dict[str, str], body: bytes) -> tuple:
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http["Content-Length"])
    if head["WARC-Type"] == "response" and (len(body) != size or _sha1(body) != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
    return json.loads(head["X-Page-ID"]), size, digest, head["WARC-Type"], json.loads(head.get("X-Refers-To-Page", "null"))


def op5_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch_folder(spark, "archive")
    captures = staged(write_archives(pages, f"{folder}/warc"), "captures")
    directory = staged(build_index(captures, f"{folder}/index"), "directory")
    return read_back(directory, pages.schema["page_id"].dataType.simpleString())


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, h, first, unhex(sha1(h)) AS b FROM p JOIN f USING (h)),
bits AS (
  SELECT page_id, h, first,
         list_transform(range(0, 32), lambda i: CAST(substr(bits, 5 * i + 1, 5) AS VARCHAR)) AS fives
  FROM (SELECT page_id, h, first, CAST(CAST(b AS BIT) AS VARCHAR) AS bits FROM d)
)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
       array_to_string(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(x[1] AS INT) + 8 * CAST(x[2] AS INT) + 4 * CAST(x[3] AS INT) + 2 * CAST(x[4] AS INT) + CAST(x[5] AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""
