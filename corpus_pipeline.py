"""The corpus pipeline: documents in, encoded training mix out.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``;
the last adds ``run_position``, the order that the mix decided on.

Defined results of every stage: null, empty and word-less texts are documents
without words (the quality rules reject them, so later stages meet them only on
their own); a null id or source is a value like any other; of rows equal in all
columns each counts, but near-dedup keeps one; ties go to the smaller id, then
the smaller hash of the row; very long texts are worked through whole; empty
tables give empty results; further columns pass through, and none of them may be
named ``__file``, ``__row``, ``__start`` or ``run_position``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import encode_table
from quarry.llm.linededup import dedup_lines
from quarry.llm.mixing import mixed
from quarry.llm.neardup import keep_one
from quarry.llm.quality import quality_rules
from quarry.session import scratch_path

#: byte-level vocabulary: a file's place, or the name of a public tokenizer's
VOCABULARY = "byte_bpe_50k.json"
WORD = r"[^\x20\x09-\x0D]"


def _recounted(new: DataFrame, docs: DataFrame) -> DataFrame:
    """``new`` with the columns of ``docs``, ``n_chars`` fitting the text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.length("text").cast(kind))
    return new.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality rules reject go."""
    return quality_rules(docs).where(F.col("kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later copies of runs of 50 words or more are cut from the
    texts. A document that lost lines and has no word left goes: all it said
    stands in earlier documents."""
    got = dedup_lines(docs, min_words=50)
    gone = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    got = got.where(~gone)
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near-duplicates stays."""
    return keep_one(docs, radius=2, shingle=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the training run, a row per copy, in its order."""
    return _recounted(mixed(docs), docs)


def in_run(docs: DataFrame) -> DataFrame:
    """``docs`` with ``run_position``, the row's place 0, 1, .. in the table as
    it was written: the mix is sorted, its files are numbered in that order, and
    Parquet knows each row's number in its file. Rows that come from no file
    have no position (null)."""
    if not docs.inputFiles():
        return docs.withColumn("run_position", F.lit(None).cast("bigint"))
    name = F.col("_metadata.file_name")
    number = [F.coalesce(F.regexp_extract(name, p, 1).try_cast("bigint"), F.lit(0)) for p in (r"part-(\d+)", r"\.c(\d+)")]
    rows = docs.select("*", F.struct(*number, name).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = docs.groupBy(F.struct(*number, name).alias("__file")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)            # one row a file
    starts = sizes.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__file").withColumn("run_position", F.col("__start") + F.col("__row")).drop(
        "__file", "__row", "__start")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents' token ids, and their place in the run."""
    path = spark.conf.get("quarry.bpe.vocabulary", None)
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return encode_table(in_run(docs).select("doc_id", "source", "run_position", "text"), path)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: SimHash over XXH64 has no counterpart in DuckDB SQL; tests/llm hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes to a Parquet table in
    the shared folder, which the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
