"""WARC archives of pages and a two-level capture index.

1. Equal payloads: the largest page_id of each digest is found by an aggregation of digests; only digests that occur more
   than once are joined back: broadcast while they take less than HELD bytes, else by a shuffle in which the digests'
   rows are salted, so that a payload that a third of the pages share is no single task's.
2. Each task writes its pages as WARC records, a gzip member each, to files of its own in the order in which it meets them
   (no payload moves), and returns where each record lies. What a failed task wrote is in no index and so is never read.
3. Index: the records' keys (the host's labels reversed, then path and query) are sorted over all pages, and each task
   writes its range as compressed blocks of LINES lines, with a sparse directory of the blocks' first keys beside them. The
   ranges are at most PARTS; their first keys are all that a lookup sends to every task.
4. Lookup: binary search among ranges, then in the range's directory, then in the block, which is read by its range of
   bytes once for all keys that may be in it. A key of very many records is looked up block by block, in many tasks.
5. Fetch: places of records are brought together by file and stretch and read by ranges of bytes that join neighbours.

Files are written and read with pyarrow's filesystems below spark.checkpoint.dir. Payloads are told apart by SHA-1 and
length, as WARC's own revisits are.

Null html is an empty payload. A null url is an empty key and has no target line. A null page_id comes after all others
(it is never the response that others refer to, unless no row of its payload has an id: then all of them are responses) and
is given back as null. Of rows that repeat a page_id, each has its record; if that id is the largest of its payload, all its
rows are responses. Urls without a host are their own key; control characters in a target line are percent-encoded. Any
length of url or payload is written whole. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

LINES, PREFIX = 1000, 256  # lines of an index block; bytes of a first key that are kept
PARTS, PART_ROWS = 4096, 4096  # ranges of the index: at most, and rows of each while there are fewer
FILE_BYTES, STRETCH, READ = 1 << 30, 16 << 20, 4 << 20
HELD, SALTS = 64 << 20, 16
EMPTY_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: Column) -> Column:
    """The key of a url: reversed host, port unless usual, path and query; the fragment goes."""
    u = F.coalesce(url, F.lit(""))
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    authority = F.regexp_extract(u, scheme + r"([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    rest = F.regexp_extract(u, scheme + r"[^/?#]*([^#]*)", 1)
    shown = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), shown, F.lit(")"), path))


def record(page_id: int | None, url: bytes | None, payload: bytes | None, size: int, sha1: str, refers: int | None, date: str) -> bytes:
    """A response, or a revisit if it refers to another page, as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers is not None else http + (payload or b"")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers is None else b"revisit"), f"WARC-Record-ID: <{name}>".encode(), f"WARC-Date: {date}".encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url))
    lines.append(b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)))
    if refers is not None:
        lines += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <urn:page:%d>" % refers]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def headers(raw: bytes) -> dict[str, bytes]:
    pairs = (line.split(b":", 1) for line in raw.split(b"\r\n")[1:])
    return {k.decode("ascii").lower(): v.strip() for k, v in pairs}


def parsed(member: bytes) -> dict:
    """A gzip member back as a record; one that is not what its own headers say raises."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record here")
    of = headers(head)
    block = rest[: int(of["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, kind = int(headers(http)["content-length"]), of["warc-type"].decode()
    digest = base64.b32decode(of["warc-payload-digest"].removeprefix(b"sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload of another length or digest than its headers say")
    page, refers = (re.fullmatch(rb"<urn:page:(-?\d+)>", of.get(k, b"")) for k in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": int(page[1]) if page else None, "target": of.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload": payload if kind == "response" else None,
    }


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


class Reader:
    """Ranges of bytes of a folder's files; the file read last stays open."""

    def __init__(self, folder: str):
        self.system, self.path = opened(folder)
        self.name = self.file = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.name = self.file = None


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, n: int = 2000, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of n rows, or of fewer once their bytes are `most`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) == n or size > most:
            yield batch(held, schema)
            held, size = [], 0
    yield batch(held, schema)


def repeats(pages: DataFrame, least: int, held: int) -> DataFrame:
    """pages (digest, payload_bytes, ...) with `refers`: the page that has the same payload and the largest id, if another."""
    tops = pages.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    tops = tops.where((F.col("n") > 1) & F.col("top").isNotNull()).select("digest", "payload_bytes", "top")
    folder = B.scratch(pages.sparkSession, "captures-repeats")
    tops.write.parquet(folder)
    tops = pages.sparkSession.read.parquet(folder)
    if tops.count() * 64 <= held:
        joined = pages.join(F.broadcast(tops), ["digest", "payload_bytes"], "left")
    else:
        salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        each = tops.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        joined = salted.join(each, ["digest", "payload_bytes", "salt"], "left").drop("salt")
    return joined.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("top")


@dataclass
class Archive:
    """A folder of WARC files and their index; `ranges` are the first keys and names of the index's parts, in order."""

    spark: SparkSession
    folder: str
    ranges: list[tuple[bytes, str]]


RECORDS = pa.schema([("key", pa.binary()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PART = pa.schema([("first", pa.binary()), ("name", pa.string())])
FOUND = pa.schema([("part", pa.string()), ("key", pa.binary())])
BLOCK = pa.schema([("part", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.binary())])
POINTER = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE = pa.schema([("page_id", pa.int64()), ("target", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'long'}" for f in schema)


def write(pages: DataFrame, folder: str, least: int = 1000, date: str = EMPTY_DATE, held: int = HELD) -> Archive:
    """Writes page_id, url, html as WARC files and their index."""
    spark = pages.sparkSession
    B.small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    rows = repeats(rows, least, held).select(surt(F.col("url")).cast("binary").alias("key"), "page_id", F.col("url").cast("binary").alias("url"), F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "payload_bytes", "digest", "refers")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(f"{path}/warc", recursive=True)
        name, out, at = "", None, 0

        def each() -> Iterator[tuple]:
            nonlocal name, out, at
            for key, page, url, payload, size, sha1, refers in rows_of(batches):
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/warc/{name}", compression=None)
                member = record(page, url, payload, size, sha1, refers, date)
                out.write(member)
                yield key, page, name, at, len(member)
                at += len(member)

        try:
            yield from batched(each(), RECORDS)
        finally:
            if out:
                out.close()

    rows.mapInArrow(written, ddl(RECORDS)).write.parquet(f"{folder}/records")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> Archive:
    """Sorts the records' keys into compressed blocks with a sparse directory."""
    records = spark.read.parquet(f"{folder}/records")
    parts = max(1, min(PARTS, -(-records.count() // PART_ROWS)))
    order = ("key", "page_id", "file", "offset")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(f"{path}/index", recursive=True)
        name, out, at, lines, directory = uuid.uuid4().hex, None, 0, [], []

        def flush() -> None:
            nonlocal at, out
            if not lines:
                return
            out = out or system.open_output_stream(f"{path}/index/{name}.cdx.gz", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress("".join(json.dumps([k.decode("utf-8", "surrogateescape"), *rest]) + "\n" for k, *rest in lines).encode()) + packer.flush()
            out.write(data)
            directory.append((lines[0][0][:PREFIX], at, len(data)))
            at += len(data)
            lines.clear()

        for row in rows_of(batches):
            lines.append((row[0], *row[2:]))
            if len(lines) == LINES:
                flush()
        flush()
        if out:
            out.close()
            held = pa.table([pa.array(c) for c in zip(*directory, strict=True)], names=["first", "offset", "length"])
            with system.open_output_stream(f"{path}/index/{name}.directory", compression=None) as file, pa.ipc.new_stream(file, held.schema) as writer:
                writer.write_table(held)
            yield batch([(directory[0][0], name)], PART)

    ranges = f"{folder}/ranges"
    records.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(indexed, ddl(PART)).write.parquet(ranges)
    return opened_archive(spark, folder)


def opened_archive(spark: SparkSession, folder: str) -> Archive:
    """An archive that is already there."""
    found = spark.read.parquet(f"{folder}/ranges").toArrow()  # a row a range: PARTS at most, but for what a raised partition count adds
    return Archive(spark, folder, sorted(zip(found["first"].to_pylist(), found["name"].to_pylist(), strict=True)))


def span(firsts: list[bytes], key: bytes) -> range:
    """The places that may hold a key, among ranges or blocks whose first keys (PREFIX bytes of them) ascend."""
    cut = key[:PREFIX]
    return range(max(0, bisect.bisect_left(firsts, cut) - 1), bisect.bisect_right(firsts, cut))


def lookup(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """file, offset, length: the records of the given urls, each once however often its url is given."""
    ranges, folder = archive.ranges, archive.folder
    firsts = [first for first, _ in ranges]
    wanted = urls.select(surt(F.col(url).cast("string")).cast("binary").alias("key")).distinct()

    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((ranges[i][1], key) for (key,) in rows_of(batches) for i in span(firsts, key)), FOUND)

    def in_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)

        def each() -> Iterator[tuple]:
            now, first, offset, length = None, [], [], []
            for part, key in rows_of(batches):
                if part != now:
                    with system.open_input_stream(f"{path}/index/{part}.directory", compression=None) as file:
                        held = pa.ipc.open_stream(file.read()).read_all()
                    now, (first, offset, length) = part, (c.to_pylist() for c in held.columns)
                for i in span(first, key):
                    yield part, offset[i], length[i], key

        yield from batched(each(), BLOCK)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(f"{folder}/index")

        def each() -> Iterator[tuple]:
            now, keys, lines = None, [], []
            for part, offset, length, key in rows_of(batches):
                if (part, offset) != now:
                    text = zlib.decompress(reader.read(f"{part}.cdx.gz", offset, length), 31).decode()
                    lines = [json.loads(line) for line in text.splitlines()]
                    now, keys = (part, offset), [line[0].encode("utf-8", "surrogateescape") for line in lines]
                for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                    yield tuple(lines[i][1:])

        try:
            yield from batched(each(), POINTER)
        finally:
            reader.close()

    found = wanted.mapInArrow(in_ranges, ddl(FOUND)).repartition("part").sortWithinPartitions("part", "key")
    found = found.mapInArrow(in_directories, ddl(BLOCK)).repartition("part", "offset").sortWithinPartitions("part", "offset", "key")
    return found.mapInArrow(in_blocks, ddl(POINTER))


def fetch(archive: Archive, pointers: DataFrame, payload: bool = True) -> DataFrame:
    """The records at file, offset, length: page_id, target, payload_bytes, payload_digest, record_type, refers_to, and the
    payload of responses if asked for. Lengths and digests are those of the payload that was read."""
    schema = CAPTURE.append(pa.field("payload", pa.binary())) if payload else CAPTURE
    folder = archive.folder

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(f"{folder}/warc")

        def taken(run: list[tuple]) -> Iterator[tuple]:
            data = io.BytesIO(reader.read(run[0][0], run[0][1], sum(length for *_, length in run)))
            for *_, length in run:
                found = parsed(data.read(length))
                yield tuple(found[f.name] for f in schema)

        def each() -> Iterator[tuple]:
            run: list[tuple] = []
            size = 0
            for row in rows_of(batches):
                if run and (row[0] != run[-1][0] or row[1] != run[-1][1] + run[-1][2] or size + row[2] > READ):
                    yield from taken(run)
                    run, size = [], 0
                run.append(row)
                size += row[2]
            if run:
                yield from taken(run)

        try:
            yield from batched(each(), schema)
        finally:
            reader.close()

    near = pointers.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch")).repartition("file", "stretch").drop("stretch")
    return near.sortWithinPartitions("file", "offset").mapInArrow(fetched, ddl(schema))


def read_back(pages: DataFrame, least: int = 1000, payload: bool = False, held: int = HELD) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back through the index."""
    archive = write(pages, B.scratch(pages.sparkSession, "captures"), least, held=held)
    return fetch(archive, lookup(archive, pages), payload)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM t
"""
