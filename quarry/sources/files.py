"""File sources: recursive document scan with format dispatch and
quarantine (SRC1-SRC6).

* SRC1/SRC2: ``binaryFile`` with recursive lookup and a case-insensitive
  suffix glob; file metadata comes from the scan's own columns.
* SRC3: TXT stays in the JVM: ``try_validate_utf8`` (NULL on bad bytes) and
  a Unicode strip.
* SRC4: other formats go through one Arrow job that dispatches on
  ``format`` to an extractor registry (DOCX built in; PDF or anything else by
  registering a function ``bytes -> str``).
* SRC5: a failing file never fails the job: it becomes a row of the
  quarantine table with its error.

A file is one row here, and Spark's scan leaves out files of no bytes.
``ranges.load_ranges`` reads files of any size in ranges, empty ones too.
"""
from __future__ import annotations

import io
import zipfile
from typing import Callable, Iterator, Tuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import path_exists

SUPPORTED_FORMATS = (".pdf", ".txt", ".docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _glob() -> str:
    def ci(s):
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*.{" + ",".join(ci(f[1:]) for f in SUPPORTED_FORMATS) + "}"


def scan_files(spark: SparkSession, source_dir: str) -> DataFrame:
    """SRC1 + SRC2 + SRC6: ``filepath, filename, format, size_bytes, content``.
    A missing directory raises; an empty one gives an empty table."""
    if not path_exists(spark, source_dir):
        raise FileNotFoundError(f"source directory not found: {source_dir}")
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", "true")
          .option("pathGlobFilter", _glob())
          .load(source_dir))
    return df.select(
        F.col("path").alias("filepath"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("format"),
        F.col("length").alias("size_bytes"),
        F.col("content"))


def docx_text(data: bytes) -> str:
    """Non-blank body paragraphs joined by a blank line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    paras = []
    for p in (body if body is not None else []):
        if p.tag != f"{_W}p":
            continue
        parts = []
        for el in p.iter():
            if el.tag == f"{_W}t" and el.text:
                parts.append(el.text)
            elif el.tag == f"{_W}tab":
                parts.append("\t")
            elif el.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        t = "".join(parts)
        if t.strip():
            paras.append(t)
    return "\n\n".join(paras).strip()


def make_docx(paragraphs: list[str]) -> bytes:
    """Minimal DOCX package with one paragraph per entry (fixtures)."""
    from xml.sax.saxutils import escape
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    doc = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
           f'<w:body>{body}</w:body></w:document>')
    ct = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
          '<Default Extension="xml" ContentType="application/xml"/>'
          '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", ct)
        z.writestr("word/document.xml", doc)
    return buf.getvalue()


#: characters of extracted text that a worker holds before it hands them on; a row counts some too
EXTRACT_CHARS, ROW_CHARS = 1 << 20, 200

EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text}


def register_extractor(fmt: str, fn: Callable[[bytes], str]) -> None:
    """Add or replace the extractor for a suffix (e.g. ``.pdf``)."""
    EXTRACTORS[fmt.lower()] = fn


def parse_files(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """SRC3 + SRC4: scanned files -> ``filepath, filename, format, size_bytes,
    text, error`` in one pass over the bytes. Text files are decoded strictly
    in the JVM; only the bytes of other formats travel to Python, where the
    registry's extractors ship with the task."""
    reg = dict(EXTRACTORS if extractors is None else extractors)

    kind = pa.struct([("text", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<text:string,error:string>")
    def extract(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for formats, contents in batches:
            out, held = [], 0
            for fmt, data in zip(formats, contents):
                fn = reg.get(fmt.as_py())
                if not data.is_valid:
                    out.append({"text": None, "error": None})
                elif fn is None:
                    out.append({"text": None, "error": f"no extractor for {fmt.as_py()}"})
                else:
                    try:
                        out.append({"text": fn(data.as_py()), "error": None})
                    except Exception as e:  # noqa: BLE001 - quarantined, never fatal
                        out.append({"text": None, "error": f"{type(e).__name__}: {e}"})
                held += ROW_CHARS + len(out[-1]["text"] or "")
                if held >= EXTRACT_CHARS:
                    yield pa.array(out, kind)
                    out, held = [], 0
            if out:
                yield pa.array(out, kind)
            formats = contents = data = out = None      # the next batch is read without this one

    plain = F.col("format") == ".txt"
    decoded = F.try_validate_utf8(F.when(plain, F.col("content").cast("string")))
    # or else a filter on the error extracts every file a second time
    other = extract.asNondeterministic()("format", F.when(~plain, F.col("content")))
    got = files.select("filepath", "filename", "format", "size_bytes", decoded.alias("__t"), other.alias("__x"))
    return got.select("filepath", "filename", "format", "size_bytes",
                      F.when(plain, strip(F.col("__t"))).otherwise(F.col("__x.text")).alias("text"),
                      F.when(plain & F.col("__t").isNull(), F.lit("invalid UTF-8")).otherwise(F.col("__x.error")).alias("error"))


def load_documents(spark: SparkSession, source_dir: str, extractors: dict | None = None):
    """SRC1-5: ``(documents, quarantine)``. Documents carry ``doc_id`` (the
    path), ``text, filename, filepath, format, size_bytes``; quarantine the
    same keys plus ``error``. Each file is read once: the parsed table is
    staged as Parquet in the shared folder, and both results read that."""
    from ..session import scratch_path
    path = scratch_path(spark, "parsed-files")
    parse_files(scan_files(spark, source_dir), extractors).write.parquet(path)
    return split_parsed(spark.read.parquet(path))


def split_parsed(parsed: DataFrame):
    """Good rows and quarantine of a parsed table."""
    cols = [F.col("filepath").alias("doc_id"), "text", "filename", "filepath", "format", "size_bytes"]
    return (parsed.filter(F.col("error").isNull()).select(*cols),
            parsed.filter(F.col("error").isNotNull()).select(*cols, "error"))


def split_documents(files: DataFrame, extractors: dict | None = None):
    """Decode/extract scanned files and split good rows from quarantine."""
    return split_parsed(parse_files(files, extractors))
