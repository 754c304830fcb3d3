"""Table sources: the shared parquet tables mapped onto the engine's data
model (documents, questions, chunk store)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TEXT_TABLES = ("documents", "conversations", "pages")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table. How finely a scan is cut is left to Spark's own
    settings (``spark.sql.files.maxPartitionBytes`` and the row groups), unless
    the session names ``spark.quarry.scan.parallelism``: then text tables, whose rows
    cost CPU, are dealt over that many partitions. Local sessions set it, since
    a table of one row group would run on one core; a cluster leaves it unset."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get("spark.quarry.scan.parallelism", None)
    return df.repartition(int(n)) if n and name in TEXT_TABLES else df


def display_name(doc_id) -> F.Column:
    """File-style name for a table document: ``doc-<id>.txt``."""
    return F.concat(F.lit("doc-"), F.col(doc_id).cast("string"), F.lit(".txt"))


def documents_from_table(df: DataFrame) -> DataFrame:
    """``documents(doc_id, text, lang, source, n_chars)`` -> the document
    model ``doc_id, text, filename, filepath, format, size_bytes``."""
    name = display_name("doc_id")
    return df.select(
        F.col("doc_id"),
        F.col("text"),
        name.alias("filename"),
        F.concat(F.col("source"), F.lit("/"), name).alias("filepath"),
        F.lit(".txt").alias("format"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )


def questions_from_table(df: DataFrame, id_col: str = "item_id", text_col: str = "text",
                         top_k: int | None = None) -> DataFrame:
    """Any ``(id, text)`` table -> questions ``query_id, question, top_k``."""
    return df.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("question"),
                     F.lit(top_k).cast("int").alias("top_k"))


def questions_from_rows(spark: SparkSession, rows, with_keywords: bool = False) -> DataFrame:
    """SRC10: a literal question list (strings, or (question, keywords))."""
    if with_keywords:
        data = [(i, q, list(kw)) for i, (q, kw) in enumerate(rows)]
        return spark.createDataFrame(
            data, "query_id long, question string, expected_keywords array<string>")
    return spark.createDataFrame([(i, q) for i, q in enumerate(rows)],
                                 "query_id long, question string")
