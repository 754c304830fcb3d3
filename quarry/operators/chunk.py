"""Documents -> overlapping token windows (F1, F2, W3, U1, UD4, UD5).

One projection builds all windows of a document as an array of structs and
one ``inline``-style explode flattens them, so the chunker is a single
narrow stage (no shuffle). The ordinal in the array is ``chunk_index``.
"""
from __future__ import annotations

import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

from ..functions.tokens import WORD_PIECE, window_starts, word_pieces, word_run, word_runs
from ..session import scratch_path

CHUNK_COLS = ("chunk_index", "token_count", "chunk_text")


def windows_of_pieces(pieces, size: int, overlap: int):
    """Array of ``struct(chunk_text, token_count)`` windows over a token
    array (pass a column reference: the array must be computed once)."""
    starts = window_starts(F.size(pieces), size, overlap)

    def one(s):
        window = F.slice(pieces, s + 1, size)
        return F.struct(F.array_join(window, "").alias("chunk_text"),
                        F.size(window).alias("token_count"))
    return F.transform(starts, one)


def windows_of_runs(runs, size: int, overlap: int):
    """The windows of ``windows_of_pieces`` over ``word_runs(text, size - overlap)``
    (pass a column reference), for an overlap of at most a run: a window is a run
    and the first ``overlap`` pieces of the next. Only the last run's pieces are
    counted, since the others are full."""
    step = size - overlap
    n = F.size(runs)
    rest = F.size(word_pieces(F.element_at(runs, -1)))

    def one(run, i):
        last = i + 1 == n
        head = F.regexp_extract(F.get(runs, i + 1), word_run(overlap), 0) if overlap else F.lit("")
        more = F.when(i + 2 == n, F.least(F.lit(overlap), rest)).otherwise(F.lit(overlap))
        return F.struct(F.when(last, run).otherwise(F.concat(run, head)).alias("chunk_text"),
                        F.when(last, rest).otherwise(F.lit(step) + more).alias("token_count"))
    return F.transform(runs, one)


def chunk_column(text, size: int, overlap: int):
    """Windows of one text; the token array is bound once through a
    single-element ``transform`` so it is not re-extracted per window."""
    return F.element_at(F.transform(F.array(word_pieces(text)),
                                    lambda p: windows_of_pieces(p, size, overlap)), 1)


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50,
                    text_col: str = "text", drop_text: bool = True, tokenizer=None,
                    rebalance: bool = False) -> DataFrame:
    """Every document column is kept (metadata travels with its chunks) and
    ``chunk_index INT, token_count INT, chunk_text STRING`` are added.

    ``tokenizer`` (UD4) maps a text column to the array of its pieces, in
    order; ``python_pieces`` makes one of a Python function. ``rebalance``
    evens out the partitions by size, so that the chunks of very long documents
    spread before a costly step such as model embedding."""
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("chunk_overlap must be in [0, chunk_size)")
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    # tokenise once per document, then cut every window from that array; the
    # built-in pieces need not be taken apart where a window meets two runs only
    if tokenizer is None and overlap <= size - overlap:
        pieces, windows = word_runs(F.col(text_col), size - overlap), windows_of_runs
    else:
        pieces, windows = (tokenizer or word_pieces)(F.col(text_col)), windows_of_pieces
    out = docs.select(*keep, pieces.alias("__p")).select(
        *keep,
        F.posexplode(windows(F.col("__p"), size, overlap)).alias("chunk_index", "__w"),
    ).select(
        *keep,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("__w.token_count").cast("int").alias("token_count"),
        F.col("__w.chunk_text").alias("chunk_text"),
    )
    return out.hint("rebalance") if rebalance else out


#: characters of text that a Python tokenizer gets at a time
PIECES_CHARS = 1 << 19


def python_pieces(fn):
    """UD4: a tokenizer column from ``fn(list[str]) -> list[list[str]]``; a null
    text has no pieces. ``fn`` gets about ``PIECES_CHARS`` of texts at a time, and
    their pieces leave before the next are made, so that a worker never holds those
    of a whole Arrow batch."""
    kind = pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            block, held = [], 0
            for t in texts:
                block.append(t.as_py() or "")
                held += len(block[-1])
                if held >= PIECES_CHARS:
                    yield pa.array(fn(block), kind)
                    block, held = [], 0
            if block:
                yield pa.array(fn(block), kind)
            texts = t = block = None        # the next batch is read without this one

    return pieces


#: the text is cut behind the word that holds this many characters' last one
SEGMENT_CHARS = 1 << 20


def chunk_long_documents(docs: DataFrame, size: int = 512, overlap: int = 50, text_col: str = "text",
                         drop_text: bool = True, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """F1 for documents of any length: the rows of ``chunk_documents``.

    Texts up to ``segment_chars`` characters are windowed in their row. A longer
    one is cut into segments that end with a word, so pieces never straddle two;
    the segments are dealt out to all tasks, their piece counts summed by prefix
    (a row per segment, without text), and each cuts the windows of its global
    piece numbers. Windows that lie across segments are put together from their
    parts, a handful per border, so no task ever holds a document's windows.

    Defined results: null and blank texts have no windows; repeated rows and null
    ids are documents of their own."""
    step = size - overlap
    long = F.length(text_col) > segment_chars
    short = chunk_documents(docs.where(~F.coalesce(long, F.lit(False))), size, overlap, text_col, drop_text)
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    spark = docs.sparkSession
    parts = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s).{1,%d}\s*\S*" % segment_chars), 0)
    path = scratch_path(spark, "segments")
    cut = docs.where(long).withColumn("__row", F.monotonically_increasing_id()).select(
        *keep, "__row", F.posexplode(parts).alias("__seg", "__text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut.repartition(n, "__row", "__seg").withColumn("__n", F.regexp_count("__text", F.lit(WORD_PIECE)).cast("long")).write.parquet(path)
    segs = spark.read.schema(cut.withColumn("__n", F.lit(0).cast("long")).schema).parquet(path)
    before = Window.partitionBy("__row").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = segs.select("__row", "__seg", "__n").withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    segs = segs.where("__n > 0").join(starts, ["__row", "__seg"])
    # windows j (pieces j * step to j * step + size) that meet the segment's pieces [from, from + n)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("__from") - size) / step) + 1)
    last = F.floor((F.col("__from") + F.col("__n") - 1) / step)
    pieces = segs.withColumn("__p", word_pieces("__text")).drop("__text")

    def part(j):
        a = F.greatest(j * step - F.col("__from"), F.lit(0))
        b = F.least(j * step + size - F.col("__from"), F.col("__n"))
        got = F.slice(F.col("__p"), (a + 1).cast("int"), (b - a).cast("int"))
        inside = (j * step >= F.col("__from")) & (j * step + size <= F.col("__from") + F.col("__n"))
        return F.struct(j.alias("j"), F.array_join(got, "").alias("text"), (b - a).alias("n"), inside.alias("whole"))

    wins = pieces.select(*keep, "__row", "__seg", F.explode(F.transform(F.sequence(first, last), part)).alias("w")).select(
        *keep, "__row", "__seg", "w.*")
    out = [*keep, F.col("j").cast("int").alias("chunk_index"), F.col("n").cast("int").alias("token_count"), F.col("text").alias("chunk_text")]
    whole = wins.where("whole").select(*out)
    # what keep holds is equal in all parts of a row
    joined = wins.where("NOT whole").groupBy("__row", "j").agg(
        F.min_by(F.struct(*keep), "__seg").alias("k"), F.sum("n").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__seg", "text"))), lambda x: x["text"]), "").alias("text"))
    return short.unionByName(whole).unionByName(joined.select("k.*", "j", "n", "text").select(*out))


class ChunkTable:
    """UD5 as a table function: ``SELECT * FROM chunk_table(TABLE(SELECT doc_id,
    text FROM docs) PARTITION BY (doc_id), 512, 50)``. The first column is the
    document's key, the second its text; ``analyze`` checks the arguments and
    gives the key its own type."""

    def __init__(self):
        self.pieces = re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+")

    @staticmethod
    def analyze(docs, size=None, overlap=None):
        if not docs.isTable or len(docs.dataType.fields) < 2:
            raise ValueError("the first argument is a table of key and text")
        n, o = (x.value if x is not None else d for x, d in ((size, 512), (overlap, 50)))
        if n is None or o is None or n <= 0 or not 0 <= o < n:
            raise ValueError("chunk_size must be positive and chunk_overlap in [0, chunk_size)")
        key = docs.dataType.fields[0]
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField("chunk_index", T.IntegerType()),
                                           T.StructField("token_count", T.IntegerType()), T.StructField("chunk_text", T.StringType())]))

    def eval(self, row, size=512, overlap=50):
        found = self.pieces.findall(row[1] or "")
        for i, a in enumerate(range(0, len(found), size - overlap)):
            part = found[a:a + size]
            yield row[0], i, len(part), "".join(part)


def register_chunk_table(spark, name: str = "chunk_table") -> None:
    """Makes ``ChunkTable`` callable from SQL; rows travel in Arrow batches."""
    spark.udtf.register(name, F.udtf(ChunkTable, useArrow=True))


def register_chunker_udtf(spark, size: int = 512, overlap: int = 50, name: str = "chunk_text"):
    """UD5 for SQL callers: a SQL function returning the window array of a
    text. Spark does not allow SQL functions inside generators, so explode
    it from a subquery: ``SELECT pos AS chunk_index, w.* FROM (SELECT
    chunk_text(text) AS ws FROM docs) LATERAL VIEW posexplode(ws) t AS pos, w``."""
    if overlap < 0 or overlap >= size:
        raise ValueError("chunk_overlap must be in [0, chunk_size)")
    step = size - overlap
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING)
        RETURNS ARRAY<STRUCT<chunk_text: STRING, token_count: INT>>
        RETURN element_at(transform(array(regexp_extract_all(t, '\\\\s*\\\\S+', 0)), p ->
            transform(CASE WHEN size(p) > 0 THEN sequence(0, size(p) - 1, {step}) ELSE array() END,
                s -> named_struct('chunk_text', array_join(slice(p, s + 1, {size}), ''),
                                  'token_count', size(slice(p, s + 1, {size}))))), 1)
    """)
