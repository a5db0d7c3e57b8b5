"""WARC archives as a Spark data source, and archiving of pages with one copy of equal payloads.

`spark.read.format("warc").load(folder)` plans byte ranges of the files as partitions: the writer
notes where records start, so a large file is read by several tasks. Predicates on record type and on
header fields are pushed down. A record's header is parsed first; if it does not pass, the reader goes
on to the next record without reading or decoding the payload. With option `payload` set to `false`
no payload is decoded at all. Files are reached through pyarrow's file systems, so a folder may be in
any store that they know.

Archives written elsewhere, which have no such notes, are read by file: all `.warc` and `.warc.gz`
under the folder, or the one file named. A folder without any is an error. The payload is the body of
a response and the whole block of other types; a revisit has none. `payload_length` is null where only
decoding would tell it and the payload is not asked for.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postlens.session import stage

SCHEMA = "record_id string, record_type string, target_uri string, date string, " \
    "refers_to string, payload_digest string, payload_length long, headers map<string,string>, " \
    "payload binary"
#: What a page is written from.
PAGE = ["record_id", "target_uri", "payload", "payload_digest", "refers_to"]
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: Payloads from this size on are stored once, and compressed.
LEAST_SHARED = 100
LEAST_COMPRESSED = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest.json"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Window:
    """A file seen through a buffer that is filled where it is looked at."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        i = at - self.start
        if i < 0 or i + n > len(self.data):
            self.file.seek(at)
            self.start, self.data, i = at, self.file.read(max(n, READ_BYTES)), 0
        return self.data[i:i + n]

    def head(self, at: int) -> tuple[bytes, int]:
        """The lines up to the next empty one, and the place after it."""
        n = 4096
        while True:
            data = self.get(at, n)
            end = data.find(b"\r\n\r\n")
            if end >= 0 or len(data) < n:
                return data[:max(end, 0)], at + end + 4
            n *= 2


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def bare(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha256:") if name == "payload_digest" else value


class Unpacked(Window):
    """A compressed file, seen from front to back."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.start, self.data = pa.CompressedInputStream(file, "gzip"), 0, b""

    def get(self, at: int, n: int) -> bytes:
        while self.start + len(self.data) < at + n:
            if at > self.start:
                gone = min(at - self.start, len(self.data))
                self.start, self.data = self.start + gone, self.data[gone:]
            more = self.file.read(READ_BYTES)
            if not more:
                break
            self.data += more
        return self.data[max(0, at - self.start):at - self.start + n]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, payload: bool):
        self.path, self.schema, self.payload = path, schema, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.wanted.setdefault(f"{name}?", set())
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = located(self.path)
        manifest = f"{path}/{MANIFEST}"
        if store.get_file_info(manifest).type == fs.FileType.File:
            files = json.loads(store.open_input_stream(manifest).read())
        else:
            info = store.get_file_info(path)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(
                fs.FileSelector(path, recursive=True))
            files = [{"name": i.path[len(path):].lstrip("/"), "marks": [0, i.size]}
                     for i in found if i.path.endswith((".warc", ".warc.gz"))]
            if not files:
                raise FileNotFoundError(f"no .warc or .warc.gz file under {self.path}")
        return [Range(f["name"], b, e) for f in files
                for b, e in zip(f["marks"][:-1], f["marks"][1:], strict=True)] or [Range("", 0, 0)]

    def passes(self, row: dict) -> bool:
        return all(row[k[:-1]] is not None if k[-1] == "?" else row[k] in v
                   for k, v in self.wanted.items())

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        store, path = located(self.path)
        schema = to_arrow_schema(self.schema)
        rows, size = [], 0
        name = f"{path}/{part.path}" if part.path else path
        packed = name.endswith(".gz")
        with store.open_input_file(name) as file:
            window, at = Unpacked(file) if packed else Window(file), part.begin
            while window.get(at, 1) if packed else at < part.end:
                head, body = window.head(at)
                if not head.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record at byte {at} of {part.path}")
                headers = fields(head)
                length = int(headers["content-length"])
                at = body + length + 4
                row = {k: bare(k, headers.get(v)) for k, v in FIELDS.items()}
                if not self.passes(row):
                    continue
                row["headers"] = list(headers.items())
                stored = self.payload and headers.get("warc-type") != "revisit"
                row["payload"] = payload(window.get(body, length), headers) if stored else None
                row["payload_length"] = payload_length(headers, window, body, length, row["payload"])
                rows.append(row)
                size += length
                if size >= 4 * READ_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def is_http(headers: dict[str, str]) -> bool:
    """Whether the block of a response is an HTTP message."""
    return headers.get("warc-type") == "response" and \
        headers.get("content-type", "application/http").startswith("application/http")


def payload(block: bytes, headers: dict[str, str]) -> bytes | None:
    """The body of a stored HTTP response, else the whole block. A revisit has none and is not asked for."""
    if not is_http(headers):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return gzip.decompress(body) if fields(head).get("content-encoding") == "gzip" else body


def payload_length(headers: dict[str, str], window: Window, body: int, length: int,
                   data: bytes | None) -> int | None:
    if "x-payload-length" in headers:
        return int(headers["x-payload-length"])
    if data is not None:
        return len(data)
    if headers.get("warc-type") == "revisit":
        return None
    if not is_http(headers):
        return length
    head, begin = window.head(body)
    return None if "content-encoding" in fields(head) else body + length - begin


def record(row: dict) -> bytes:
    """One record; what refers to another one has no body."""
    body, digest, refers = row["payload"] or b"", row["payload_digest"], row["refers_to"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(body)}",
        "Content-Type: application/http; msgtype=response"]
    if row["target_uri"] is not None:
        uri = row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {uri}")
    if refers is not None:
        lines += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
        stored = b""
    elif len(body) >= LEAST_COMPRESSED:
        http += "Content-Encoding: gzip\r\n"
        stored = gzip.compress(body, 3, mtime=0)
    else:
        stored = body
    block = f"{http}\r\n".encode() + stored
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    marks: list[int]


class WarcWriter(DataSourceArrowWriter):
    """A task writes a file under a name of its own; only those of tasks that Spark has committed are
    listed in the manifest, so a task that was lost or run twice leaves nothing that is read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, it: Iterator[pa.RecordBatch]) -> Written:
        name, file, marks, at = None, None, [0], 0
        for batch in it:
            for row in batch.to_pylist():
                if file is None:
                    store, path = located(self.path)
                    store.create_dir(path, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc"
                    file = store.open_output_stream(f"{path}/{name}")
                data = record(row)
                file.write(data)
                at += len(data)
                if at - marks[-1] >= SPLIT_BYTES:
                    marks.append(at)
        if file is not None:
            file.close()
        return Written(name, marks if marks[-1] == at else [*marks, at])

    def commit(self, messages: list[Written | None]) -> None:
        store, path = located(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps([{"name": m.name, "marks": m.marks}
                                  for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = located(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{path}/{m.name}")


class WarcDataSource(DataSource):
    """Format `warc`. Options: `path`, a folder of its own for each written archive; `payload`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema,
                          self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if schema.names != PAGE:
            raise ValueError(f"columns to write: {', '.join(PAGE)}")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url",
            html: str = "html") -> None:
    """Write a record for each row of `pages` to the new folder `path`.

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of at least
    `LEAST_SHARED` bytes the one with the smallest id is a response and the others revisit it;
    smaller payloads are all responses. Rows that share the smallest id are all responses. A null id
    revisits the smallest one, or is a response if there is none. An empty table gives an archive
    without records.
    """
    register(pages.sparkSession)
    data = F.coalesce(pages[html], F.lit("")).cast("binary")
    rows = pages.select(pages[id].cast("long").alias("id"), pages[url].cast("string").alias("url"),
                        data.alias("payload"), F.sha2(data, 256).alias("digest"))
    # Copies meet by digest in narrow rows; the payloads move once, by id, however many copies.
    large = rows.where(F.octet_length("payload") >= LEAST_SHARED).select("id", "digest")
    firsts = stage(large.groupBy("digest").agg(F.min("id").alias("first"),
                                               F.count(F.lit(1)).alias("n"))
                   .where("n > 1 AND first IS NOT NULL").drop("n"), "firsts")
    later = stage(large.join(firsts, "digest").where("NOT id <=> first").distinct(), "later")
    later = later.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "first")
    out = rows.join(later, F.expr("id <=> id2 AND digest = digest2"), "left").select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
        .alias("record_id"), F.col("url").alias("target_uri"), "payload",
        F.col("digest").alias("payload_digest"),
        F.concat(F.lit("urn:page:"), F.col("first").cast("string")).alias("refers_to"))
    out.write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(urn: str) -> Column:
    """The id in a record's name; null if it has none."""
    return F.expr(f"try_cast(substring({urn}, 10) AS bigint)")
