"""Files as a PySpark data source that reads by bytes (SRC1-SRC5 for any size):
``format("document_files")``, one row per range of a file.

Planning: the driver lists names and sizes only. Files that fail a pushed
predicate on ``filepath``, ``filename``, ``format`` or ``size_bytes`` are never
opened. Text files above ``rangebytes`` (64 MiB) are cut into ranges, other
formats are one range; ranges are packed into partitions of about
``partitionbytes`` (128 MiB; opening a file counts as ``openbytes``, 4 MiB), so
neither one huge file nor a million small ones makes an unbounded task.

Borders: the border near byte b is behind the first line end in the
``rangebytes`` bytes from b - 1 on, or, in a longer line, before the next
character that begins at b or later. Each task finds its two borders alone, no
range reaches twice ``rangebytes``, only the last of a file can be empty, and the
ranges of a file joined in order are its bytes.

Invalid bytes: a range's text is null if it holds some; ``bad_bytes`` counts
them and ``bad_at`` is the file's offset of the first. A file that vanishes or
shrinks between planning and reading gives rows with an ``error``. So no file
fails a job; ``load_ranges`` quarantines whole files.

Columns: ``filepath, filename, format, size_bytes, part, n_parts, start, text,
content, bad_bytes, bad_at, error``; ``content`` holds the bytes of formats
other than text. Names that begin with ``_`` or ``.`` below the folder are left
out, as Spark does. An empty file is one range with an empty text; an empty
folder gives no rows; a missing one raises.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs) or plain
local ones, reachable from every node. Stores that only the JVM can open are read
by ``files.load_documents``. Spark 4.1 keeps pushed filters with the loaded
DataFrame, so ``scan_ranges`` loads anew each time.
"""
from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .files import EXTRACTORS, SUPPORTED_FORMATS

ARROW = pa.schema([
    ("filepath", pa.string()), ("filename", pa.string()), ("format", pa.string()), ("size_bytes", pa.int64()),
    ("part", pa.int32()), ("n_parts", pa.int32()), ("start", pa.int64()), ("text", pa.string()),
    ("content", pa.binary()), ("bad_bytes", pa.int64()), ("bad_at", pa.int64()), ("error", pa.string())])
SCHEMA = ("filepath string, filename string, format string, size_bytes bigint, part int, n_parts int, start bigint, "
          "text string, content binary, bad_bytes bigint, bad_at bigint, error string")
TEXT_FORMATS = (".txt",)
BATCH_BYTES = 4 << 20
LOOK_BYTES = 1 << 16

COMPARE: dict[type, Callable] = {
    ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a}
KNOWN_WHEN_LISTED = ("filepath", "filename", "format", "size_bytes")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain local path."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Range:
    """One range of a listed file; ``span`` is the distance of its borders."""
    path: str
    filepath: str
    format: str
    size: int
    part: int
    n_parts: int
    span: int


@dataclass
class Batch(ds.InputPartition):
    ranges: list[Range]


def border(f, size: int, at: int, span: int) -> int:
    """The true border near byte ``at`` of an open file."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    f.seek(at - 1)
    seen, lead = 0, None
    while seen < span:
        got = f.read(min(LOOK_BYTES, span - seen))
        if not got:
            break
        end = got.find(b"\n")
        if end >= 0:
            return at + seen + end
        if lead is None:
            lead = got[1:5]
        seen += len(got)
    if lead is None or len(lead) < 4:
        f.seek(at)
        lead = f.read(4)
    # 10xxxxxx goes on with a character; valid text has three in a row at most
    inside = next((i for i, b in enumerate(lead) if b & 0xC0 != 0x80), len(lead) if len(lead) < 4 else 0)
    return at + inside


def decode(data: bytes) -> tuple[str | None, int, int | None]:
    """(text, invalid bytes, place of the first); the text is null if any."""
    bad: list[int] = []

    def count(e: UnicodeError):
        bad.append(e.end - e.start)
        if len(bad) == 1:
            bad.append(e.start)
        else:
            bad[0] += bad.pop()
        return "", e.end

    try:
        return data.decode("utf-8"), 0, None
    except UnicodeDecodeError:
        codecs.register_error("quarry-count", count)
        data.decode("utf-8", "quarry-count")
        return None, bad[0], bad[1]


def pack(ranges: Iterator[tuple[Range, int]], most: int) -> list[Batch]:
    """Ranges with their costs, in order, in batches of cost ``most`` or one range."""
    out: list[Batch] = []
    room = 0
    for r, cost in ranges:
        if not out or cost > room:
            out.append(Batch([]))
            room = most
        out[-1].ranges.append(r)
        room -= cost
    return out


class FileReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.span = int(options.get("rangebytes", 64 << 20))
        self.most = int(options.get("partitionbytes", 128 << 20))
        self.open_cost = int(options.get("openbytes", 4 << 20))
        if self.span < 4 or self.most <= 0 or self.open_cost < 0:
            raise ValueError("rangebytes must be 4 or more, partitionbytes positive, openbytes 0 or more")
        formats = options.get("formats", ",".join(SUPPORTED_FORMATS))
        self.formats = tuple(x.strip().lower() for x in formats.split(",") if x.strip())
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            test = COMPARE.get(type(f))
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if test and name in KNOWN_WHEN_LISTED:
                self.tests.append((name, test, f.value))
            else:
                yield f

    def listed(self) -> Iterator[tuple[str, dict]]:
        """(path, columns known) of each file that passes what was pushed."""
        store, base = open_store(self.root)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"source directory not found: {self.root}")
        base = info.path.rstrip("/")
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        for i in sorted(found, key=lambda x: x.path):
            below = i.path[len(base):].strip("/").split("/")
            if i.type != fs.FileType.File or any(x[:1] in ("_", ".") for x in below if x):
                continue
            name = i.path.rsplit("/", 1)[-1]
            dot = name.rfind(".")
            row = {"filepath": self.root.rstrip("/") + i.path[len(base):], "filename": name,
                   "format": name[dot:].lower() if dot >= 0 else "", "size_bytes": i.size}
            if row["format"] in self.formats and all(t(row[c], v) for c, t, v in self.tests):
                yield i.path, row

    def _ranges(self) -> Iterator[tuple[Range, int]]:
        for path, row in self.listed():
            size = row["size_bytes"]
            n = max(1, -(-size // self.span)) if row["format"] in TEXT_FORMATS else 1
            for k in range(n):
                cost = min(self.span, size - k * self.span) if n > 1 else size
                yield Range(path, row["filepath"], row["format"], size, k, n, self.span), cost + self.open_cost

    def partitions(self):
        return pack(self._ranges(), self.most) or [Batch([])]

    def read(self, partition):
        store, _ = open_store(self.root)
        rows, held = [], 0
        for r in partition.ranges:
            row, size = self._row(store, r)
            if rows and held + size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
            rows.append(row)
            held += size
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    @staticmethod
    def _row(store: fs.FileSystem, r: Range) -> tuple[dict, int]:
        row = {"filepath": r.filepath, "filename": r.path.rsplit("/", 1)[-1], "format": r.format, "size_bytes": r.size,
               "part": r.part, "n_parts": r.n_parts, "start": None, "bad_bytes": 0}
        try:
            with store.open_input_file(r.path) as f:
                a, b = 0, r.size
                if r.n_parts > 1:
                    a = border(f, r.size, r.part * r.span, r.span)
                    b = r.size if r.part + 1 == r.n_parts else border(f, r.size, (r.part + 1) * r.span, r.span)
                f.seek(a)
                data = f.read(b - a)
        except OSError as e:
            return {**row, "error": f"{type(e).__name__}: {e}"}, 0
        row["start"] = a
        if len(data) < b - a:
            return {**row, "error": f"file ends {b - a - len(data)} bytes early"}, 0
        if r.format in TEXT_FORMATS:
            text, bad, at = decode(data)
            row |= {"text": text, "bad_bytes": bad, "bad_at": None if at is None else a + at,
                    "error": "invalid UTF-8" if bad else None}
        else:
            row["content"] = data
        return row, len(data)


class DocumentFiles(ds.DataSource):
    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileReader(dict(self.options))


def scan_ranges(spark: SparkSession, source_dir: str, where: Column | str = "true", **options) -> DataFrame:
    """The ranges of a folder's (or one file's) documents that meet ``where``,
    by a load of its own. Options: ``rangebytes, partitionbytes, openbytes, formats``."""
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("document_files").options(**options).load(source_dir).where(where)


def extract_ranges(ranges: DataFrame, extractors: dict | None = None) -> DataFrame:
    """The ranges with the text of other formats than text, by the registry's
    extractors; ``content`` goes."""
    reg = dict(EXTRACTORS if extractors is None else extractors)
    kind = pa.struct([("text", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<text:string,error:string>")
    def extract(formats: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for fmt, data in zip(formats.to_pylist(), contents):
            got = {"text": None, "error": None}
            if data.is_valid and fmt not in reg:
                got["error"] = f"no extractor for {fmt}"
            elif data.is_valid:
                try:
                    got["text"] = reg[fmt](data.as_py())
                except Exception as e:  # noqa: BLE001 - quarantined, never fatal
                    got["error"] = f"{type(e).__name__}: {e}"
            out.append(got)
        return pa.array(out, kind)

    rest = [c for c in ranges.columns if c not in ("text", "content", "error")]
    return ranges.withColumn("__x", extract("format", "content")).select(
        *rest, F.coalesce("text", "__x.text").alias("text"), F.coalesce("error", "__x.error").alias("error"))


def load_ranges(spark: SparkSession, source_dir: str, where: Column | str = "true", extractors: dict | None = None,
                **options) -> tuple[DataFrame, DataFrame]:
    """``(documents, quarantine)``. Documents have a row per range: ``doc_id`` (the
    path), ``part, n_parts, start, text, filename, filepath, format, size_bytes``,
    the text as it stands in the file. Quarantine has a row per file of which some
    range failed, with the first error, the count of invalid bytes and the place of
    the first; no range of such a file is among the documents. Files are read once:
    the ranges are staged as Parquet in the shared folder."""
    from ..session import scratch_path
    path = scratch_path(spark, "file-ranges")
    extract_ranges(scan_ranges(spark, source_dir, where, **options), extractors).write.parquet(path, compression="zstd")
    staged = spark.read.parquet(path)
    key = F.col("filepath").alias("doc_id")
    # only failed ranges are grouped; at most rangebytes apart, they carry no text
    bad = staged.where("error IS NOT NULL").groupBy("filepath", "filename", "format", "size_bytes").agg(
        F.min_by("error", "part").alias("error"), F.sum("bad_bytes").alias("bad_bytes"), F.min("bad_at").alias("bad_at"))
    good = staged.join(bad.select("filepath"), "filepath", "left_anti").select(
        key, "part", "n_parts", "start", "text", "filename", "filepath", "format", "size_bytes")
    return good, bad.select(key, "*")
