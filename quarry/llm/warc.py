"""WARC archives as a PySpark data source (``format("warc")``).

Reading: the driver lists the archives and packs whole files into partitions
of about ``partition_bytes``. Predicates on header fields are pushed down;
each record's headers are parsed first, and only a record that passes has its
payload read. The others are stepped over: by length in plain archives, by the
member length in the gzip header of archives written here (the ``sl`` extra
field), and by inflating without keeping the bytes in foreign ones. With
``.option("payload", "false")`` no payload is decoded at all.

Writing: one gzip member per record, a new file every ``file_bytes``. A
commit adds one list of its files; readers only see listed files, so tasks
that ran twice or failed leave nothing visible. Folders without such a list
are read by file name (``*.warc``, ``*.warc.gz``).

Spark 4.1 keeps the filters it has pushed with the loaded DataFrame, so two
queries with different filters need a ``load`` each; ``read_warc`` does that.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs) or plain
local ones; they must be reachable from every node.

Defined results: a null payload is an empty one; null fields have no header
line. Control characters in header values are percent-encoded. Repeated rows
give one record each. Input columns beyond those of ``FIELDS`` are refused by
name. An empty table writes an archive without records, which reads as empty.
"""
from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

#: column, header name
FIELDS = [("warc_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("date", "WARC-Date"),
          ("target_uri", "WARC-Target-URI"), ("refers_to", "WARC-Refers-To"),
          ("payload_digest", "WARC-Payload-Digest"), ("content_type", "Content-Type")]
COLUMN = {h.lower(): c for c, h in FIELDS}
SCHEMA = ", ".join(f"{c} string" for c, _ in FIELDS) + ", content_length bigint, headers map<string,string>, payload binary"
ARROW = pa.schema([*((c, pa.string()) for c, _ in FIELDS), ("content_length", pa.int64()),
                   ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END = b"\r\n\r\n"


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# records

def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(fields: dict, payload: bytes | None) -> bytes:
    """One record. ``fields``: the columns of FIELDS and a ``headers`` map."""
    payload = payload or b""
    kind = fields.get("content_type") or "application/http; msgtype=response"
    block = payload
    if kind.startswith("application/http"):
        block = (HTTP % len(payload)) + payload if fields.get("warc_type") != "revisit" else HTTP % len(payload)
    lines = ["WARC/1.1"]
    for column, header in FIELDS:
        value = kind if column == "content_type" else fields.get(column)
        if value is not None:
            value = f"<{value}>" if column in ("record_id", "refers_to") else value
            lines.append(f"{header}: {_safe(value)}")
    lines += [f"{_safe(k)}: {_safe(v)}" for k, v in (fields.get("headers") or ()) if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes, level: int) -> bytes:
    """A gzip member that tells its own length, so that it can be skipped."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines by name (names keep their case; continued lines joined)."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def row_of(headers: dict[str, str]) -> dict:
    """The header columns of a record."""
    row: dict = {c: None for c, _ in FIELDS}
    low = {k.lower(): v for k, v in headers.items()}
    for h, c in COLUMN.items():
        if h in low:
            row[c] = low[h][1:-1] if low[h].startswith("<") and low[h].endswith(">") else low[h]
    row["content_length"] = int(low.get("content-length", 0))
    row["headers"] = headers
    return row


def _payload(row: dict, block: bytes) -> bytes:
    """The payload inside a record's block: what follows the HTTP headers. A
    block shorter than its header states is an error, not a short payload."""
    if len(block) != row["content_length"]:
        raise EOFError(f"record {row['record_id']} states {row['content_length']} bytes and holds {len(block)}")
    if (row["content_type"] or "").startswith("application/http"):
        return block.partition(END)[2]
    return block


class Predicate:
    """Pushed filters, evaluated on a record's header columns."""

    _COMPARE = {"GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b,
                "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b,
                "StringStartsWith": lambda a, b: a.startswith(b), "StringEndsWith": lambda a, b: a.endswith(b),
                "StringContains": lambda a, b: b in a, "EqualTo": lambda a, b: a == b, "In": lambda a, b: a in b}

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def add(self, f) -> bool:
        """Takes a filter over if it is about one header column."""
        kind, path = type(f).__name__, getattr(f, "attribute", ())
        if len(path) != 1 or path[0] not in {*(c for c, _ in FIELDS), "content_length"}:
            return False
        if kind not in self._COMPARE and kind not in ("IsNull", "IsNotNull", "EqualNullSafe"):
            return False
        self.tests.append((kind, path[0], getattr(f, "value", None)))
        return True

    def __call__(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            have = row[column]
            if kind == "IsNull":
                ok = have is None
            elif kind == "IsNotNull":
                ok = have is not None
            elif kind == "EqualNullSafe":
                ok = have == value
            else:
                ok = have is not None and value is not None and self._COMPARE[kind](have, value)
            if not ok:
                return False
        return True


# reading one archive

def _skip_length(head: bytes) -> int | None:
    """Length of a gzip member from its extra field, if it has one."""
    if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    extra = head[12:12 + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        name, size = extra[at:at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if name == b"sl" and size >= 4:
            return struct.unpack_from("<I", extra, at + 4)[0]
        at += 4 + size
    return None


def read_plain(f, wanted, payload: bool) -> Iterator[dict]:
    """Records of an uncompressed archive (a seekable file)."""
    at, size = 0, f.size()
    while at < size:
        head, step = b"", 4096
        while END not in head and at + len(head) < size:
            f.seek(at + len(head))
            head += f.read(step)
            step *= 2
        lead = len(head) - len(head.lstrip(b"\r\n"))
        head = head[lead:]
        if not head:
            return
        text, _, _ = head.partition(END)
        row = row_of(parse_headers(text))
        begin = at + lead + len(text) + len(END)
        if wanted(row):
            f.seek(begin)
            row["payload"] = _payload(row, f.read(row["content_length"])) if payload else None
            yield row
        at = begin + row["content_length"] + len(END)


class _Members:
    """The inflated bytes of a gzip archive, piece by piece, members in turn."""

    def __init__(self, f, chunk: int):
        self.f, self.chunk, self.size = f, chunk, f.size()
        self.start = self.next = self.read = self.records = 0
        self.raw, self.rest = b"", b""
        self.inflate = self.whole = None
        self.clean = False

    def more(self, most: int) -> bool:
        """Appends at most so many bytes to ``raw``; false at the archive's end."""
        if self.inflate is None:
            if self.next >= self.size:
                return False
            self.f.seek(self.next)
            self.rest = self.f.read(4096)
            self.start, self.read, self.records = self.next, len(self.rest), 0
            self.clean, self.whole = not self.raw, _skip_length(self.rest)
            self.inflate = zlib.decompressobj(31)
        late = not self.rest
        if late:
            self.rest = self.f.read(self.chunk)
            self.read += len(self.rest)
            late = not self.rest
        piece = self.inflate.decompress(self.rest, most)
        self.rest = self.inflate.unconsumed_tail
        self.raw += piece
        if self.inflate.eof:
            self.next = self.start + self.read - len(self.inflate.unused_data)
            self.inflate = None
        elif late and not piece:
            raise EOFError("archive ends inside a record")
        return True

    def skip(self) -> None:
        """Goes on at the next member, by the length this one states."""
        self.raw, self.inflate, self.next = b"", None, self.start + self.whole


def read_gzip(f, wanted, payload: bool, chunk: int = 1 << 16) -> Iterator[dict]:
    """Records of a gzip archive, whether a member holds one or several; only
    a record that begins its member is skipped by the member's length."""
    m = _Members(f, chunk)
    while True:
        m.raw = m.raw.lstrip(b"\r\n")
        while END not in m.raw and m.more(2048):
            m.raw = m.raw.lstrip(b"\r\n")
        if not m.raw.strip():
            return
        if END not in m.raw:
            raise EOFError("archive ends inside a record")
        text, _, m.raw = m.raw.partition(END)
        row = row_of(parse_headers(text))
        keep = wanted(row)
        first = m.clean and not m.records
        m.records += 1
        parts, left = [], row["content_length"]
        if (not keep or not payload) and first and m.whole:
            m.skip()
            left = 0
        while left:
            if not m.raw:
                ended = m.inflate is None
                if not m.more(min(max(left, 1 << 16), 1 << 20)) or ended and m.raw.startswith(b"WARC/"):
                    break                       # shorter than stated
                continue
            piece, m.raw = m.raw[:left], m.raw[left:]
            left -= len(piece)
            if keep and payload:
                parts.append(piece)
        if keep:
            row["payload"] = _payload(row, b"".join(parts)) if payload else None
            yield row


# the data source

@dataclass
class Archives(ds.InputPartition):
    paths: list


@dataclass
class Written(ds.WriterCommitMessage):
    files: list


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.wanted = Predicate()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self):
        store, base = _open_fs(self.path)
        infos = store.get_file_info(fs.FileSelector(base, recursive=True))
        names = {i.path: i.size for i in infos if i.type == fs.FileType.File}
        lists = [n for n in names if n.rsplit("/", 1)[-1].startswith("_files-")]
        if lists:
            found = []
            for n in lists:
                with store.open_input_stream(n) as f:
                    found += [(f"{base}/{x}", s) for x, s in json.loads(f.read())]
        else:
            found = [(n, s) for n, s in names.items() if n.endswith((".warc", ".warc.gz"))]
        parts, room = [], 0
        for name, size in sorted(found):
            if not parts or size > room:
                parts.append([])
                room = self.bytes
            parts[-1].append(name)
            room -= size
        return [Archives(p) for p in parts] or [Archives([])]

    def read(self, partition):
        store, _ = _open_fs(self.path)
        rows, held = [], 0
        for name in partition.paths:
            with store.open_input_file(name) as f:
                gz = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                for row in (read_gzip if gz else read_plain)(f, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 1000
                    if held > 4 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        cols = [pa.array([list(r["headers"].items()) for r in rows] if f.name == "headers" else [r[f.name] for r in rows], f.type)
                for f in ARROW]
        return pa.RecordBatch.from_arrays(cols, schema=ARROW)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 1))
        self.bytes = int(options.get("file_bytes", 128 << 20))
        unknown = set(names) - {*(c for c, _ in FIELDS), "headers", "payload"}
        if unknown:
            raise ValueError(f"columns that a WARC record doesn't have: {sorted(unknown)}")

    def write(self, iterator):
        store, base = _open_fs(self.path)
        store.create_dir(base, recursive=True)
        part, out, name, size, files = TaskContext.get().partitionId(), None, "", 0, []
        for batch in iterator:
            for row in (r for a in range(0, batch.num_rows, 64) for r in batch.slice(a, 64).to_pylist()):
                if out is None:
                    name, size = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                size += out.write(member(record_bytes(row, row.get("payload")), self.level)) or 0
                if out.tell() >= self.bytes:
                    files.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            files.append((name, out.tell()))
            out.close()
        return Written(files)

    def commit(self, messages):
        store, base = _open_fs(self.path)
        store.create_dir(base, recursive=True)
        old = [i.path for i in store.get_file_info(fs.FileSelector(base)) if "/_files-" in i.path] if self.overwrite else []
        with store.open_output_stream(f"{base}/_files-{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for p in old:
            store.delete_file(p)

    def abort(self, messages):
        store, base = _open_fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{base}/{name}")


class WarcDataSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known and lets Spark hand it filters."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, condition: str = "true", **options) -> DataFrame:
    """The records of an archive that meet a condition, by a load of their own."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path).where(condition)


def record_id(*parts: Column) -> Column:
    """A name-based urn:uuid of the given columns."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 1000, id_col: str = "page_id",
                  url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per page: of pages with equal payloads of ``min_bytes``
    or more, the one with the largest id is a response and the others revisit
    it (pages without an id always revisit, if a page with an id has the same
    payload); all smaller payloads are responses."""
    body = F.coalesce(F.col(f"`{body_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), body.alias("payload"),
                        F.sha1(body).alias("sha1"))
    many = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(
        F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    rows = rows.join(many.hint("shuffle_hash"), "sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), record_id(F.col("id"), F.col("sha1")).alias("record_id"),
        F.lit(date).alias("date"), "target_uri", F.when(again, record_id(F.col("first"), F.col("sha1"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"),
        F.create_map(F.lit("X-Page-Id"), F.col("id").cast("string")).alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"))
    register(pages.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an
    archive of pages. Responses are measured on their stored payload; a revisit
    takes both figures, and ``refers_to``, from the response it names."""
    page = F.col("headers")["X-Page-Id"].cast("bigint")
    responses = read_warc(spark, path, "warc_type = 'response'").select(
        "record_id", page.alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest")).checkpoint()
    revisits = read_warc(spark, path, "warc_type = 'revisit'", payload="false").select(
        page.alias("page_id"), "refers_to")
    named = responses.dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("response"), "payload_bytes", "payload_digest")
    again = revisits.join(named, "refers_to").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("response").alias("refers_to"))
    first = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                             F.lit(None).cast("bigint").alias("refers_to"))
    return first.unionByName(again)
