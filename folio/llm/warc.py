"""WARC: a PySpark Python data source that reads archives, and a writer for it.

Reading: one partition for each file, or for each stretch of a file between two
of the split points that the writer has listed. A record's headers are parsed
first; predicates on its type and headers are pushed down and tested on them, and
the payload of a record that fails (or of any, with option payload=false) is
skipped by its length, never read or decoded. ``.gz`` archives (a member for each
record) are read too.

Writing: a response record for each distinct payload of some size, revisit
records for the others. Every task attempt writes a file of a new name; the
listing in ``manifest.json``, written after all tasks, names the files that count.

Files are opened through the file system of the folder's URI.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from folio.llm.common import new_dir, small_batches, written

MANIFEST = "manifest.json"
SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, date string, content_type string, content_length long,"
    " payload_digest string, refers_to string, http_length long, headers map<string,string>, payload binary"
)
#: Columns that are a header's value, and so can be tested before the payload is read.
BY_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("http_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class WarcDataSource(DataSource):
    """Options: path (a folder or file URI), payload (false: leave it null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, EqualNullSafe)) and name in BY_HEADER:
                self.tests.append((name, (f.value,)))
            elif isinstance(f, In) and name in BY_HEADER:
                self.tests.append((name, tuple(f.value)))
            elif isinstance(f, IsNotNull) and name in BY_HEADER:
                self.tests.append((name, ()))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        fs, where = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(where).type == pyarrow.fs.FileType.File:
            return [Stretch(self.path, 0, None)]
        listed = f"{where}/{MANIFEST}"
        if fs.get_file_info(listed).type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(listed) as s:
                files = json.loads(s.read())["files"]
            return [Stretch(f"{self.path}/{f['name']}", a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], None])]
        names = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(where)) if i.base_name.endswith((".warc", ".warc.gz"))]
        return [Stretch(f"{self.path}/{n}", 0, None) for n in sorted(names)]

    def _wanted(self, values: dict) -> bool:
        for name, accepted in self.tests:
            if values[name] is None or accepted and values[name] not in accepted:
                return False
        return True

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        fs, where = pyarrow.fs.FileSystem.from_uri(partition.path)
        name = where.rpartition("/")[2]
        with fs.open_input_file(where) as file:
            file.seek(partition.start)
            rows, held = [], 0
            for offset, headers, take, skip in _records(file, name.endswith(".gz"), partition.end):
                values = {c: headers.get(h) for c, h in BY_HEADER.items()}
                values["content_length"] = int(headers.get("content-length", 0))
                if not self._wanted(values):
                    skip()
                    continue
                values |= {"file": name, "offset": offset, "headers": list(headers.items()), "http_length": None, "payload": None}
                if (values["content_type"] or "").startswith("application/http"):
                    length = values["content_length"]
                    http, body = _http(take, length)
                    values["http_length"] = int(http["content-length"]) if "content-length" in http else None
                    if self.payload and values["record_type"] != "revisit":
                        values["payload"] = take(length - body)
                elif self.payload:
                    values["payload"] = take(values["content_length"])
                skip()
                rows.append(values)
                held += len(values["payload"] or b"") + 500
                if held > 2 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _records(file, packed: bool, end: int | None):
    """(offset, headers, take, skip) of each record; take(n) reads on in its block, or a line of it; skip() passes over the rest of it."""
    stream = io.BufferedReader(_Raw(file), 1 << 16)
    if packed:
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    seekable = not packed
    offset = stream.tell()
    while end is None or packed or offset < end:
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            offset += len(first)
            first = stream.readline()
        if not first or (end is not None and not packed and offset >= end):
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        headers, size = _headers(stream)
        left = [int(headers.get("content-length", 0))]

        def take(n: int, line: bool = False, left=left) -> bytes:
            n = min(n, left[0])
            data = stream.readline(n) if line else stream.read(n)
            if len(data) < (n > 0 if line else n):
                raise ValueError("archive ends inside a record")
            left[0] -= len(data)
            return data

        def skip(left=left) -> None:
            if seekable:
                stream.seek(left[0], io.SEEK_CUR)
            else:
                while left[0]:
                    take(1 << 20)
            left[0] = 0

        total = len(first) + size + left[0]
        yield offset, headers, take, skip
        skip()
        offset += total
        if seekable:
            stream.seek(offset)


def _headers(stream) -> tuple[dict[str, str], int]:
    out, size, last = {}, 0, None
    while True:
        line = stream.readline()
        size += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return out, size
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()


def _http(take, length: int) -> tuple[dict[str, str], int]:
    """The HTTP headers at a block's beginning and their size, read line by line up to the blank one."""
    out, at = {}, 0
    while at < length:
        line = take(length - at, line=True)
        at += len(line)
        text = line.decode("utf-8", "replace").strip()
        if not text:
            break
        name, colon, value = text.partition(":")
        if colon and not text.startswith("HTTP/"):
            out[name.strip().lower()] = value.strip()
    return out, at


class _Raw(io.RawIOBase):
    """A random-access Arrow file as Python's own streams want it."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, how: int = io.SEEK_SET) -> int:
        self.file.seek(at, how)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, b) -> int:
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)


def _clean(value) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value))


def record(name: str, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, split: int, date: str, packed: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc" + ".gz" * packed
        stream, at, splits = None, 0, [0]
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "length", "first")]
            for k in range(0, len(batch), 256):
                for i, url, payload, digest, length, first in zip(*(c.slice(k, 256).to_pylist() for c in columns)):
                    if stream is None:
                        fs.create_dir(where, recursive=True)
                        stream = fs.open_output_stream(f"{where}/{name}", compression=None)
                    if at - splits[-1] >= split and not packed:
                        splits.append(at)
                    data = record(f"urn:page:{i}", url, payload or b"", digest, length, None if first is None else f"urn:page:{first}", date)
                    data = gzip.compress(data, 1) if packed else data
                    stream.write(data)
                    at += len(data)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "splits": splits}], pa.schema([("name", pa.string()), ("splits", pa.list_(pa.int64()))]))

    return of


def write_warc(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, split: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", packed: bool = False) -> str:
    """Writes a record per row and returns the folder. Of equal payloads of ``least`` bytes or more the smallest id is the response.

    Null payloads are empty, null URLs have no header; rows with equal ids get a record
    each (rows with the smallest id and an equal payload are all responses).
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or new_dir(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("length"))
    firsts = written(rows.where(F.col("length") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    # few repeated payloads are broadcast (by Spark's own bound on the table's size); with many each payload is dealt out once
    first = F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first")
    joined = rows.join(firsts, "digest", "left").select("id", "url", "payload", "digest", "length", first)
    files = joined.mapInArrow(_write(folder, split, date, packed), "name string, splits array<long>").collect()  # a row per file
    fs, where = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/{MANIFEST}") as s:
        s.write(json.dumps({"files": sorted(({"name": f.name, "splits": f.splits} for f in files), key=lambda f: f["name"])}).encode())
    return folder


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
