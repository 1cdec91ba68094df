"""WARC archives as a Python data source, "warc".

Writing: every task writes an archive of its own (a gzip member for each record, or plain records), in the job's folder
and under a name that is unique to the attempt, and notes where a record begins about every RANGE bytes. The commit
lists the archives of the attempts that count, with these places, in a manifest, so those of lost or repeated attempts
are never read; a job that fails takes its folder with it.

Reading: the plan is made of the ranges between such places, in plain and in gzip archives, so a range always begins
and ends with a record, whatever stands in payloads. Of archives without a manifest plain ones are split too, at places
that the planner finds from header to header; gzip ones are read whole. Equality filters on `record_type`, `uri`, `payload_digest`, `record_id` and `refers_to` and
comparisons with `payload_bytes` are pushed down; they are answered from the headers, which are parsed first. The block
of a record that they exclude is skipped: by a seek in plain archives, without being kept or decoded in gzip ones. So
it is when the options `headers_only=true` says that no query reads `payload`.

Folders are read and written through pyarrow's file systems, so any store that they know will do.

A record without a payload has an empty one. Revisit records have no block; their digest and length headers are those
of the full payload. Header names are matched in any case; unknown headers are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, staged

SCHEMA = "record_id string, record_type string, uri string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
MANIFEST = "manifest.json"
#: Bytes of an archive that one task reads, about.
RANGE = 128 << 20
MOST_HEADER = 1 << 22
READ = 1 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return " ".join(value.split())


def record_of(row: dict) -> bytes:
    """A response or revisit record of a row of SCHEMA."""
    payload = row["payload"] or b""
    headers = [("WARC-Type", row["record_type"] or "response"), ("WARC-Record-ID", f"<{_clean(row['record_id'] or uuid.uuid4().urn)}>"), ("WARC-Date", row["date"] or DATE)]
    if row["uri"] is not None:
        headers.append(("WARC-Target-URI", _clean(row["uri"])))
    headers.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest'] or digest_of(payload)}"))
    headers.append(("X-Payload-Length", str(len(payload) if row["payload_bytes"] is None else row["payload_bytes"])))
    if row["record_type"] == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_clean(row['refers_to'] or '')}>")]
        payload = b""
    return record([*headers, ("Content-Type", "text/html; charset=utf-8")], payload)


class _Stream:
    """Bytes of an archive between two places of the file, with skipping."""

    def __init__(self, file, begin: int, packed: bool, end: int | None = None):
        self.file, self.packed, self.held, self.at, self.room = file, packed, b"", begin, None if end is None else end - begin
        file.seek(begin)
        self.inflate = zlib.decompressobj(31) if packed else None
        self.left = b""

    def _raw(self) -> bytes:
        raw = self.file.read(READ if self.room is None else min(READ, self.room))
        if self.room is not None:
            self.room -= len(raw)
        return raw

    def _more(self) -> bytes:
        if not self.packed:
            return self._raw()
        while True:
            raw = self.left or self._raw()
            if not raw:
                return b""
            out = self.inflate.decompress(raw, READ)
            self.left = self.inflate.unconsumed_tail or self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if out:
                return out

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to mark, which is passed; None at the end."""
        begin = 0
        while (found := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if begin > MOST_HEADER:
                raise ValueError("not a WARC record: its header doesn't end")
            more = self._more()
            if not more:
                return None
            self.held += more
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        self.at += found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = self._more()
            if not more:
                raise ValueError("the archive ends inside a record")
            parts.append(more)
            have += len(more)
        joined = b"".join(parts)
        self.held, self.at = joined[n:], self.at + n
        return joined[:n]

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.held):
            self.held = self.held[n:]
        elif not self.packed:
            n -= len(self.held)
            if self.room is not None:
                if n > self.room:
                    raise ValueError("the archive ends inside a record")
                self.room -= n
            self.file.seek(n, 1)
            self.held = b""
        else:
            n -= len(self.held)
            self.held = b""
            while n > 0:
                more = self._more()
                if not more:
                    raise ValueError("the archive ends inside a record")
                self.held, n = more[n:] if n < len(more) else b"", n - len(more)


def _fields(head: bytes) -> dict:
    pairs = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            pairs[name.strip().lower()] = value.strip()
    return pairs


def read_records(stream: _Stream, end: int | None, wanted, with_payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA of the records that begin before end (all if None) and whose headers are wanted."""
    while end is None or stream.at < end:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        if not head.strip():  # the end of the record before
            continue
        begin = head.find(b"WARC/")
        if begin < 0:
            raise ValueError("not a WARC record")
        h = _fields(head[begin:])
        size = int(h.get("content-length", 0))
        kind = h.get("warc-type")
        bare = lambda x: None if x is None else x.strip("<>")
        row = (bare(h.get("warc-record-id")), kind, h.get("warc-target-uri"), h.get("warc-date"), int(h.get("x-payload-length", size)), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, bare(h.get("warc-refers-to")))
        if wanted(row):
            payload = None
            if kind != "revisit" and with_payload:
                payload = stream.take(size)
            else:
                stream.skip(size)
            yield (*row, payload)
        else:
            stream.skip(size)


@dataclass
class _Part(InputPartition):
    path: str
    begin: int
    end: int | None


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    records: int
    splits: list[int]


_TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.headers_only = options.get("headers_only", "false").lower() == "true"
        self.filters: list[tuple[str, int, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        kinds = list(_TESTS)
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if name in ("record_type", "uri", "payload_digest", "record_id", "refers_to") and type(f) is EqualTo or name == "payload_bytes":
                self.filters.append((name, kinds.index(type(f)), f.value))
            else:
                yield f

    def partitions(self) -> list[_Part]:
        system, folder = pa.fs.FileSystem.from_uri(self.root)
        info = system.get_file_info(folder)
        selected = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(folder))
        listed = [json.loads(system.open_input_stream(f.path).read()) for f in selected if f.base_name == MANIFEST]
        if not listed:
            found = [(f.path, self._splits(system, f)) for f in sorted(selected, key=lambda f: f.path) if f.is_file and ".warc" in f.base_name]
        else:
            found = [(f"{folder}/{name}", splits) for name, splits in listed[0]]
        return [_Part(path, a, b) for path, splits in found for a, b in zip([0, *splits], [*splits, None], strict=True)]

    @staticmethod
    def _splits(system, info) -> list[int]:
        """Where records begin about every RANGE bytes of a plain archive that no manifest tells of: from header to header, blocks are jumped over."""
        out: list[int] = []
        if not info.path.endswith(".gz") and info.size > RANGE:
            with system.open_input_file(info.path) as file:
                stream = _Stream(file, 0, False)
                while (head := stream.until(b"\r\n\r\n")) is not None:
                    begin = stream.at - len(head) - 4 + head.find(b"WARC/")
                    if head.strip():
                        if begin - (out[-1] if out else 0) >= RANGE:
                            out.append(begin)
                        stream.skip(int(_fields(head).get("content-length", 0)))
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        system, _ = pa.fs.FileSystem.from_uri(self.root)
        kinds = list(_TESTS.values())
        tests = [(NAMES.index(n), kinds[k], v) for n, k, v in self.filters]
        wanted = lambda row: all(row[i] is not None and test(row[i], v) for i, test, v in tests)
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            stream = _Stream(file, partition.begin, partition.path.endswith(".gz"), partition.end)
            for row in read_records(stream, None, wanted, not self.headers_only):
                rows.append(row)
                held += len(row[-1] or b"") + 300
                if held > 4 * READ:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.packed, self.range = options["path"], options.get("compression", "gzip") == "gzip", int(options.get("range", RANGE))
        self.job = f"job-{uuid.uuid4().hex}"
        system, folder = pa.fs.FileSystem.from_uri(self.root)
        system.create_dir(f"{folder}/{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = pa.fs.FileSystem.from_uri(self.root)
        name, n, at, splits = f"{self.job}/{uuid.uuid4().hex}.warc" + ".gz" * self.packed, 0, 0, []
        out = None
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                raw = record_of(row)
                if self.packed:
                    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = press.compress(raw) + press.flush()
                out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
                if at - (splits[-1] if splits else 0) >= self.range:
                    splits.append(at)
                out.write(raw)
                n, at = n + 1, at + len(raw)
        if out:
            out.close()
        return _Written(name if n else None, n, splits)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = pa.fs.FileSystem.from_uri(self.root)
        old = [f for f in system.get_file_info(pa.fs.FileSelector(folder)) if f.base_name == MANIFEST]
        listed = json.loads(system.open_input_stream(old[0].path).read()) if old else []
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(listed + sorted((m.name, m.splits) for m in messages if m and m.name)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = pa.fs.FileSystem.from_uri(self.root)
        system.delete_dir(f"{folder}/{self.job}")


class WarcDataSource(DataSource):
    """Options: path; compression (gzip or none) and range (bytes of an archive between two places that a reader may begin at) for writing; headers_only for reading."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_rows(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of SCHEMA for pages: of equal payloads of at least least_bytes, the row with the largest id is a response and the others revisit it.

    A null html is an empty payload. Rows that repeat the largest id are all responses, and so are rows with a null id
    whose payload no row with an id has.
    """
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), html.alias("body")).withColumn("digest", F.unhex(F.sha1("body")))
    heads = rows.where(F.octet_length("body") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("of", "keeper")
    joined = rows.join(staged(heads, "payloads"), F.col("digest") == F.col("of"), "left")
    again = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return joined.select(
        F.coalesce(urn(F.col("id")), F.lit("urn:page:")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "uri", F.lit(DATE).alias("date"),
        F.octet_length("body").cast("long").alias("payload_bytes"), base32(F.col("digest")).alias("payload_digest"), F.when(again, urn(F.col("keeper"))).alias("refers_to"), F.when(~again, F.col("body")).alias("payload"),
    )


def base32(raw: F.Column) -> F.Column:
    """Bare upper-case base32 of 20 bytes: eight letters for every five bytes."""
    text = F.hex(raw)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for part in range(4):
        number = F.conv(F.substring(text, 10 * part + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(letters), F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*out)


def write_and_read(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page, read the archives back; fails if a payload read isn't that of its header."""
    spark = pages.sparkSession
    register(spark)
    path = new_path(spark, "warc")
    archive_rows(pages, least_bytes, id_col, uri_col, html_col).write.format("warc").mode("append").save(path)
    # Revisits are answered from their headers, so blocks are only read of responses.
    heads = spark.read.format("warc").option("headers_only", "true").load(path).where("record_type = 'revisit'")
    back = spark.read.format("warc").load(path).where("record_type = 'response'").unionAll(heads)
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') as bigint)")
    intact = (F.col("record_type") == "revisit") | ((F.octet_length("payload") == F.col("payload_bytes")) & (base32(F.unhex(F.sha1("payload"))) == F.col("payload_digest")))
    checked = F.when(intact, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its header: "), "record_id")))
    return back.select(number("record_id").alias("page_id"), F.col("payload_bytes"), checked.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "uri")
