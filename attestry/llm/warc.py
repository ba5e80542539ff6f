"""WARC archives with a two-level capture index.

An archive folder holds

* ``archives``  WARC 1.1 files, one gzip member per record, written by Spark's own committer;
* ``blocks``    the capture index: lines sorted by reversed-host URL key, cut into gzip blocks;
* ``directory`` Parquet: one row per block (first and last key, file, offset, length).

A look-up searches the sparse directory by halving on (key, page), reads the byte range of
each block that can hold the capture, searches its lines by halving, and reads the record's
byte range.  ``resolve`` does so for a table of questions: they are dealt out by block, and a
task reads each block's range once.  The directory has at most ``DIRECTORY_ROWS`` rows,
because blocks grow with the number of captures; that bound is what allows it to be sent to
every executor.  Ranges are read with pyarrow's file systems, so the folder must lie in a
store that these know.

Spark's text writer closes each row with a separator.  Here the separator is the one byte
0x00 that ends every gzip member of under 16 MiB (the top byte of its length field), so rows
are members without their last byte and the files are plain concatenated gzip.

Defined cases: a null payload is empty; a very large page is one record, in a file of its own
where need be (files are cut by bytes); a null URL has the empty key; a null page_id is
written as an empty id and returned as null, and is a response; repeated rows, and rows of one
page id with different payloads, are records of their own, each with the type that its page id
has among the records of its payload; an empty table gives no
archive rows and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from posixpath import join
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, tidy, to_batch

VERSION = "WARC/1.1"
WRITTEN = "2026-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
ARCHIVE_RECORDS = 4096
ARCHIVE_BYTES = 1 << 27
BLOCK_LINES = 256
#: Records within so many bytes of a file are read by one task.
RANGE_BYTES = 1 << 23
DIRECTORY_ROWS = 1 << 16
END = "\0"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without its closing zero byte; an empty member follows where it has none."""
    packed = gzip.compress(data, level, mtime=0)
    return packed[:-1] if packed[-1] == 0 else packed + _EMPTY_MEMBER[:-1]


def reversed_host_key(url: str | None) -> str:
    """The sort key of a URL: host labels in reverse, then port, path and query, lower case.

    Scheme, user, a leading www label, default ports and the fragment do not count.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url.strip().lower()
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    shown = "" if port in (None, 80, 443) else f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(labels))}{shown}){parts.path or '/'}{query}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], content: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(content)}"]
    return "\r\n".join([*lines, "", ""]).encode() + content + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def clean(url: str | None) -> str:
    return "".join((url or "").split())


def choose_types(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """page_id, url, payload and ``target``: the response that a record revisits, else null.

    Equal payloads are those of equal SHA-256 and length.  One row per payload is summed
    before the shuffle; it is stored, so that the join back can be split where one payload
    holds many rows.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sum": F.sha2("payload", 256), "size": F.length("payload")})
    groups = rows.where(F.col("size") >= minimum).groupBy("sum").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").select("sum", "last"), "payload-groups")
    joined = rows.join(groups, "sum", "left")
    revisits = F.col("last").isNotNull() & (F.coalesce(F.col("page_id") != F.col("last"), F.lit(True)))
    return joined.select("page_id", "url", "payload", F.when(revisits & F.col("page_id").isNotNull(), F.col("last")).alias("target"))


def write_archives(pages: DataFrame, folder: str, minimum: int = 0, per_file: int = ARCHIVE_RECORDS) -> None:
    """A WARC file per task: a warcinfo record, then a response or revisit record per page."""
    many, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    files = max(1, -(-many // per_file), -(-size // ARCHIVE_BYTES))
    typed = choose_types(pages, minimum).repartition(files, F.coalesce("page_id", F.xxhash64("url", "payload")))

    def records(batches):
        yield pa.RecordBatch.from_arrays([pa.array([member(record({"WARC-Type": "warcinfo", "WARC-Date": WRITTEN, "WARC-Record-ID": "<urn:info>", "Content-Type": "application/warc-fields"}, b"software: attestry\r\n"))], pa.binary())], ["record"])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for page in batch.slice(at, 64).to_pylist():
                    body = page["payload"]
                    headers = {
                        "WARC-Type": "response" if page["target"] is None else "revisit",
                        "WARC-Target-URI": clean(page["url"]),
                        "WARC-Date": WRITTEN,
                        "WARC-Record-ID": f"<urn:page:{'' if page['page_id'] is None else page['page_id']}>",
                        "WARC-Payload-Digest": f"sha1:{digest(body)}",
                        "Content-Type": "application/http; msgtype=response",
                    }
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    if page["target"] is not None:
                        headers |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": f"<urn:page:{page['target']}>", "WARC-Truncated": "length"}
                        body = b""
                    rows.append(member(record(headers, http + body)))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    typed.mapInArrow(tidy(records), "record binary").select(F.col("record").cast("string")).write.option("lineSep", END).text(join(folder, "archives"))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def members(content: memoryview):
    """(offset, length, data) of each gzip member that is not empty."""
    at = 0
    while at < len(content):
        unzip = zlib.decompressobj(31)
        parts, end = [], at
        while not unzip.eof and end < len(content):
            step = content[end : end + (1 << 16)]
            parts.append(unzip.decompress(step))
            end += len(step)
        end -= len(unzip.unused_data)
        data = b"".join(parts)
        if data:
            yield at, end - at, data
        at = end


CAPTURE = pa.schema([
    ("key", pa.string()), ("page", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("digest", pa.string()),
    ("size", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
CAPTURE_DDL = "key string, page string, type string, refers string, digest string, size long, file string, offset long, length long"


def body_of(content: bytes) -> bytes:
    return content.partition(b"\r\n\r\n")[2]


def page_of(name: str) -> str:
    return name[len("<urn:page:") : -1]


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives, with digest and size taken from the stored bytes."""

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for offset, length, data in members(memoryview(content.as_buffer())):
                    headers, content_bytes = parse(data)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    body = body_of(content_bytes)
                    own = headers["WARC-Type"] == "response"
                    rows.append((
                        reversed_host_key(headers["WARC-Target-URI"]), page_of(headers["WARC-Record-ID"]), headers["WARC-Type"],
                        None if own else page_of(headers["WARC-Refers-To"]),
                        digest(body) if own else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                        len(body) if own else None, path.as_py(), offset, length,
                    ))
                    if len(rows) == 4096:
                        yield to_batch(CAPTURE, zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield to_batch(CAPTURE, zip(*rows, strict=True))

    return raw_files(spark, join(folder, "archives")).mapInArrow(tidy(scan), CAPTURE_DDL)


def write_index(spark: SparkSession, folder: str, lines: int = BLOCK_LINES) -> None:
    """Sort all captures by key into gzip blocks, then list the blocks in the directory."""
    path = join(folder, "captures")
    captures(spark, folder).write.parquet(path)
    found = spark.read.schema(CAPTURE_DDL).parquet(path)
    count = found.count()
    lines = max(lines, -(-count // DIRECTORY_ROWS) * 2)
    parts = max(1, min(-(-count // (lines * 16)), DIRECTORY_ROWS // 2))
    ordered = found.repartitionByRange(parts, "key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset")

    def blocks(batches):
        held: list[str] = []

        def packed(some):
            return pa.RecordBatch.from_arrays([pa.array([member("\n".join(some).encode())], pa.binary())], ["block"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append("\t".join("-" if row[c] is None else str(row[c]) for c in CAPTURE.names))
                if len(held) == lines:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    ordered.mapInArrow(tidy(blocks), "block binary").select(F.col("block").cast("string")).write.option("lineSep", END).text(join(folder, "blocks"))
    ends = ("first_key", "first_page", "last_key", "last_page")
    schema = pa.schema([*((name, pa.string()) for name in ends), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def outline(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for offset, length, data in members(memoryview(content.as_buffer())):
                    block = data.decode().split("\n")
                    rows.append((*block[0].split("\t", 2)[:2], *block[-1].split("\t", 2)[:2], path.as_py(), offset, length))
                if rows:
                    yield to_batch(schema, zip(*rows, strict=True))

    rows = raw_files(spark, join(folder, "blocks")).mapInArrow(tidy(outline), ", ".join(f"{name} string" for name in ends) + ", file string, offset long, length long")
    rows.write.parquet(join(folder, "directory"))  # each task lists the blocks that it read


def entry(line: str) -> dict:
    """One index line as a row; numbers parsed."""
    row = {c: None if v == "-" else v for c, v in zip(CAPTURE.names, line.split("\t"), strict=True)}
    return row | {c: int(row[c]) for c in ("size", "offset", "length") if row[c] is not None}


class Directory:
    """The sparse directory of an index in order of (key, page)."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows)
        self.first, self.last = [r[:2] for r in self.rows], [r[2:4] for r in self.rows]

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Directory:
        table = spark.read.parquet(join(folder, "directory")).select("first_key", "first_page", "last_key", "last_page", "file", "offset", "length").toArrow()
        return cls(list(zip(*(c.to_pylist() for c in table.columns), strict=True)))

    def blocks(self, key: str, page: str | None = None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that can hold a capture, or any of a key, found by halving."""
        low = bisect_left(self.last, (key, page or ""))
        high = bisect_right(self.first, (key, page)) if page is not None else bisect_right(self.first, key, key=lambda end: end[0])
        return [row[4:] for row in self.rows[low:high]]


def matches(block: list[str], key: str, page: str | None = None) -> list[dict]:
    """Lines of a sorted block with a key, and with a page where one is asked for, found by halving."""
    wanted = (key,) if page is None else (key, page)
    lead = lambda line: tuple(line.split("\t", 2)[: len(wanted)])
    return [entry(line) for line in block[bisect_left(block, wanted, key=lead) : bisect_right(block, wanted, key=lead)]]


def range_read(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Spark knows, through Hadoop's seek."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def lookup(spark: SparkSession, folder: str, url: str) -> list[dict]:
    """All captures of a URL with their payloads: directory, block range, record range."""
    key, found = reversed_host_key(clean(url)), []
    for file, offset, length in Directory.load(spark, folder).blocks(key):
        found += matches(gzip.decompress(range_read(spark, file, offset, length)).decode().split("\n"), key)
    for row in found:
        _, content = parse(gzip.decompress(range_read(spark, row["file"], row["offset"], row["length"])))
        row["payload"] = body_of(content)
    return found


class Ranges:
    """Byte ranges of files, read inside a task; the file that was read last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            store, inside = FileSystem.from_uri(path)
            self.path, self.file = path, store.open_input_file(inside)
        return self.file.read_at(length, offset)


def resolve(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Captures for many distinct (key, page) at once.

    Each is sent to its blocks by halving in the directory; a task reads the range of each of
    its blocks once and searches its lines by halving.
    """
    directory = spark.sparkContext.broadcast(Directory.load(spark, folder))
    asked = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string()), ("page", pa.string())])
    shape = "file string, offset long, length long, key string, page string"

    def place(batches):
        for batch in batches:
            rows = [(*block, key, page) for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for block in directory.value.blocks(key, page)]
            if rows:
                yield to_batch(asked, zip(*rows, strict=True))

    def search(batches):
        ranges, at, block = Ranges(), None, []
        for batch in batches:
            rows = []
            for file, offset, length, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, offset) != at:
                    at, block = (file, offset), gzip.decompress(ranges.read(file, offset, length)).decode().split("\n")
                rows += matches(block, key, page)
            for low in range(0, len(rows), 4096):
                yield to_batch(CAPTURE, ([r[c] for r in rows[low : low + 4096]] for c in CAPTURE.names))

    placed = wanted.select("key", "page").mapInArrow(tidy(place), shape)
    dealt = placed.repartition("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(tidy(search), CAPTURE_DDL)


def payloads(found: DataFrame) -> DataFrame:
    """(page, type, refers, size, digest) of captures, from the byte ranges of their records.

    The digest of a revisit is the one its own header names; its size is not known here.
    """
    schema = pa.schema([("page", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("size", pa.int64()), ("digest", pa.string())])

    def read(batches):
        ranges = Ranges()
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers, content = parse(gzip.decompress(ranges.read(file, offset, length)))
                own = headers["WARC-Type"] == "response"
                body = body_of(content) if own else b""
                refers = None if own else page_of(headers["WARC-Refers-To"])
                named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                rows.append((page_of(headers["WARC-Record-ID"]), headers["WARC-Type"], refers, len(body) if own else None, digest(body) if own else named))
            if rows:
                yield to_batch(schema, zip(*rows, strict=True))

    spread = F.floor(F.col("offset") / RANGE_BYTES)
    dealt = found.select("file", "offset", "length").repartition("file", spread).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(tidy(read), "page string, type string, refers string, size long, digest string")


def read_back(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of (key, page) through the index.

    A revisit takes its size from the response of that page and digest: a page id alone does
    not name a payload, as records of one id can differ.
    """
    rows = stored(payloads(resolve(spark, folder, wanted)), "records")
    responses = rows.where("type = 'response' and page <> ''").select(F.col("page").alias("refers"), "digest", F.col("size").alias("full_size"))
    # one row per page and digest that is revisited, however many revisit it
    asked = rows.where("type = 'revisit'").select("refers", "digest").distinct()
    targets = stored(responses.join(asked, ["refers", "digest"], "left_semi").distinct(), "revisit-targets")
    joined = rows.join(targets, ["refers", "digest"], "left")
    return joined.select(
        F.expr("nullif(page, '')").cast("long").alias("page_id"),
        F.coalesce("size", "full_size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast("long").alias("refers_to"),
    )


def wanted_captures(pages: DataFrame) -> DataFrame:
    """The distinct (key, page) of a table of pages."""
    schema = pa.schema([("key", pa.string()), ("page", pa.string())])

    def run(batches):
        for batch in batches:
            keys = [reversed_host_key(clean(url)) for url in batch.column(1).to_pylist()]
            yield to_batch(schema, (keys, ["" if page is None else str(page) for page in batch.column(0).to_pylist()]))

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(tidy(run), "key string, page string").distinct()


def written_and_read(pages: DataFrame, folder: str | None = None, minimum: int = 0) -> DataFrame:
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_archives(pages, folder, minimum)
    write_index(spark, folder)
    return read_back(spark, folder, wanted_captures(pages))


ORACLE_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages
), cut AS (
  SELECT *, list_transform(range(0, 32), lambda i: CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT) & 31) AS fives
  FROM sized
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM cut
"""
