"""WARC archives with a two-level capture index.

Records are gzip members, appended to archives in the shared folder; of records with equal payloads of at least
``least_bytes`` bytes, that with the smallest page_id holds the payload and the others are revisits of it. The index
has two levels: lines (key, page_id, where) in their order, the key being the URL with its host reversed, are packed
into compressed blocks of BLOCK_LINES; a sparse directory holds each block's first and last line and place. The
directory is itself a compressed block of each index file, and only a row for each of those files, the catalogue, is
ever held whole. A lookup binary-searches the catalogue, a directory, and the one block that can hold its line, all
read by range, and then reads its records by range. Lookups go in key order, so that a block serves all that it holds.

A task writes files of its own attempt, and only those that its committed rows name are ever read, so lost
executors leave nothing but stray files. Equal payloads meet by digest in a join of the pages with one row for each
digest, which adaptive execution splits where one payload has a third of all pages.

Defined results: a null html is an empty payload; a null url has key '-'; of rows with equal ids and payloads all
are responses if the id is the smallest; rows with null ids revisit any equal payload with an id, else all are
responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BLOCK_LINES, LEAST_BYTES, LEVEL = 512, 0, 3
CAPTURES = "key string, page_id long, file string, offset long, length long"
CATALOGUE = "first string, first_id long, last string, last_id long, blocks int, lines long, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NO_ID = -(2**63)  # a null page_id's place in the order
Line = tuple[str, int]  # key and page_id


def url_key(url: str | None) -> str:
    """Host reversed, then path and query: https://b.Example.org:443/x?y#z is org,example,b)/x?y."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.strip().replace(" ", "%20")
    if not host:
        return url.strip().replace(" ", "%20")
    shown = "" if port in (None, 80, 443) else f":{port}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{shown}){tail}".replace(" ", "%20").replace("\n", "%0A")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@lru_cache(maxsize=8)
def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class Appender:
    """A file of this task attempt in a folder; put() returns where the bytes are."""

    def __init__(self, folder: str, kind: str) -> None:
        task = TaskContext.get()
        self.name = f"{kind}-{task.partitionId():05d}-{task.taskAttemptId()}" if task else f"{kind}-driver"
        self.folder, self.stream, self.at = folder, None, 0

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None:
            system, path = _system(self.folder)
            system.create_dir(path, recursive=True)
            self.stream = system.open_output_stream(f"{path}/{self.name}")
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


class Ranges:
    """Reads of parts of a folder's files; the files stay open."""

    def __init__(self, folder: str) -> None:
        self.system, self.path = _system(folder)
        self.open: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
        return self.open[name].read_at(length, offset)


def packed(data: bytes) -> bytes:
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def record_id(page_id: int | None, digest: str, own: str = "") -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{own and ':'}{own}>"


def information(date: str) -> bytes:
    """The record that opens an archive."""
    body = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return packed("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, response: bool, date: str, own: str) -> bytes:
    """One gzip member: WARC headers, HTTP headers, and in a response the payload.

    own tells records apart that aren't the one to which revisits refer.
    """
    digest = digest_of(payload)
    one = record_id(page_id, digest, "" if response and page_id is not None else own)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if response else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {one}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '-').encode('ascii', 'backslashreplace').decode().replace(chr(10), ' ').replace(chr(13), ' ')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode()
    return packed(head + b"\r\n\r\n" + body + b"\r\n\r\n")


@dataclass
class Record:
    page_id: int | None
    type: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def parse(member: bytes) -> Record:
    """A record as written; the digest of a payload that is there must be that of its bytes."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: int(x[12:-1].partition(":")[0]) if x and x[12:13] != ":" else None
    response, digest = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"][5:]
    if response and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} isn't as its headers say")
    return Record(number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), digest, size, payload if response else None)


def first_of_each(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, first (the page that holds the payload), response."""
    rows = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "payload", F.sha1("payload").alias("sum"))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("sum").agg(F.min("page_id").alias("first"))
    own = F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull())
    return rows.join(firsts, "sum", "left").select("page_id", "url", "payload", "first", own.alias("response"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives; returns where each capture is."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Appender(f"{folder}/archives", "warc")
        for batch in common.chunks(batches, 256):
            made = []
            if batch.num_rows and not out.at:
                out.put(information(date))
            for r in batch.to_pylist():
                place = out.put(record(r["page_id"], r["url"], r["payload"], r["first"], r["response"], date, f"{out.name}-{out.at}"))
                made.append({"key": url_key(r["url"]), "page_id": r["page_id"], "file": place[0], "offset": place[1], "length": place[2]})
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        out.close()

    return common.written(common.bounded(first_of_each(pages, least_bytes)).mapInArrow(work, CAPTURES), "warc-captures")


def _line(row: dict) -> Line:
    return row["key"], NO_ID if row["page_id"] is None else row["page_id"]


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the blocks and directories in the order of lines; returns the catalogue."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in CATALOGUE.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, entries, lines = Appender(f"{folder}/index", "blocks"), [], [], 0

        def block() -> None:
            text = "".join(f"{json.dumps([*_line(r), r['file'], r['offset'], r['length']])}\n" for r in held)
            entries.append([*_line(held[0]), *_line(held[-1]), *out.put(packed(text.encode()))[1:]])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                lines += 1
                if len(held) == BLOCK_LINES:
                    block()
        if held:
            block()
        if entries:
            place = out.put(packed("".join(f"{json.dumps(e)}\n" for e in entries).encode()))
            row = (*entries[0][:2], *entries[-1][2:4], len(entries), lines, *place)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
        out.close()

    count = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = common.bounded(captures).repartitionByRange(count, "key", "page_id").sortWithinPartitions("key", "page_id")
    return common.written(ordered.mapInArrow(work, CATALOGUE), "warc-catalogue")


def unpacked(raw: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(raw, 31).splitlines()]


class Index:
    """Lookups by line. The catalogue, a row for each index file, is held; all else is read by range."""

    def __init__(self, catalogue: list[tuple], folder: str) -> None:
        self.files = sorted(catalogue)
        self.lasts = [r[2:4] for r in self.files]
        self.blocks, self.archives = Ranges(f"{folder}/index"), Ranges(f"{folder}/archives")
        self.read: list[tuple] = []  # the blocks read, for tests
        self._entries = lru_cache(maxsize=64)(lambda file, offset, length: unpacked(self.blocks.read(file, offset, length)))
        self._lines = lru_cache(maxsize=64)(self._block)

    def _block(self, file: str, offset: int, length: int) -> list[list]:
        self.read.append((file, offset))
        return unpacked(self.blocks.read(file, offset, length))

    def places(self, low: Line, high: Line) -> list[list]:
        """Where the captures from one line to another are."""
        found = []
        for at in range(bisect.bisect_left(self.lasts, low), len(self.files)):
            if self.files[at][:2] > high:
                break
            entries = self._entries(*self.files[at][6:])
            for e in range(bisect.bisect_left(entries, list(low), key=lambda x: x[2:4]), len(entries)):
                if entries[e][:2] > list(high):
                    break
                lines = self._lines(self.files[at][6], *entries[e][4:])
                first = bisect.bisect_left(lines, list(low), key=lambda x: x[:2])
                found += [x[2:] for x in lines[first : bisect.bisect_right(lines, list(high), key=lambda x: x[:2])]]
        return found

    def records(self, places: list[list]) -> list[Record]:
        """Those records, read in the order of the archives."""
        return [parse(self.archives.read(*p)) for p in sorted(places)]

    def find(self, url: str) -> list[Record]:
        key = url_key(url)
        return self.records(self.places((key, NO_ID), (key, 2**63 - 1)))


def opened(catalogue: DataFrame, folder: str) -> Index:
    """An index on the driver."""
    return Index([tuple(r) for r in catalogue.collect()], folder)


def look_up(pages: DataFrame, catalogue: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture of each page_id and url given."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    files = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in catalogue.collect()])  # a row for each index file

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(x) for x in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("page_id")], ["key", "page_id"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Index(files.value, folder)
        for batch in common.chunks(batches, 1000):
            places = [p for r in batch.to_pylist() for p in here.places(_line(r), _line(r))]
            for at in range(0, len(places), 256):
                rows = [(r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in here.records(places[at : at + 256])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = common.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    asked = common.written(rows.mapInArrow(keyed, "key string, page_id long").distinct(), "warc-asked")
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartitionByRange(count, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(work, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """(catalogue, folder) of the pages' archives and index."""
    folder = common.new_path(spark, "warc")
    return index(write(pages, folder, least_bytes), folder), folder


def op3_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return look_up(pages, *archive(spark, pages))


OP3_SQL = """
WITH summed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM summed)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""
