"""Continuous question answering (ST1-ST3, F21).

A stream of JSON question messages (any Structured Streaming source; files
in tests) is parsed PERMISSIVEly, so a malformed or empty message becomes an
error row instead of ending the stream (ST2). Each micro-batch runs the
batch C2 plan inside ``foreachBatch`` (ranking windows are not allowed on
streaming frames), against the index that the pointer file names *at that
moment*, so an index rebuild becomes visible to the next batch (ST3). The
pointer is a table of versions to which a rebuild appends a row; readers take
the highest one, so they always find a complete pointer.

A message is ``{"question", "top_k"}``; a ``query_id`` may be given and is
passed through as it is. Rows are told apart by a key of the engine's own, so
messages without an id, or with equal ids, are answered one by one.

With ``once_within`` a message that carries a ``query_id`` and is sent again,
in the same batch or a later one and across restarts, is answered once: its
text is keyed state of the query, dropped when the watermark (the time the
message's file was written) has passed it by that long.

The sink is keyed by batch id: each batch overwrites its own
``batch_id=<n>`` partition, so a replay after a failure rewrites the same
rows (idempotent, exactly-once together with the checkpoint).
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..session import path_exists

MESSAGE_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("_corrupt", T.StringType()),
])


def parse_messages(lines: DataFrame, value_col: str = "value", default_k: int = 5) -> DataFrame:
    """JSON text -> ``query_id, question, top_k, parse_error``.
    Missing ``question`` reads as "" and missing ``top_k`` as the default,
    like the reference's ``message.get``; malformed text sets
    ``parse_error``."""
    m = F.from_json(F.col(value_col), MESSAGE_SCHEMA,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = F.col(value_col)
    return lines.select(m.alias("m"), raw.alias("__raw")).select(
        F.col("m.query_id").alias("query_id"),
        F.coalesce(F.col("m.question"), F.lit("")).alias("question"),
        F.coalesce(F.col("m.top_k"), F.lit(default_k)).alias("top_k"),
        F.when(F.col("m._corrupt").isNotNull() | F.col("m").isNull(), F.lit("malformed message"))
        .alias("parse_error"),
        F.col("__raw").alias("raw"))


def encode_response(df: DataFrame) -> DataFrame:
    """F21 encode: one JSON text per result row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


POINTER = "index_path string, version int"


def write_pointer(spark: SparkSession, pointer_path: str, index_path: str, version: int) -> None:
    """ST3: point to a new index by appending a row; a reader sees the rows
    before it or the whole new one."""
    spark.createDataFrame([(index_path, version)], POINTER).coalesce(1).write.mode("append").json(pointer_path)


def read_pointer(spark: SparkSession, pointer_path: str):
    """(index_path, version) of the highest version written."""
    if not path_exists(spark, pointer_path):
        raise RuntimeError("index not built")
    r = spark.read.schema(POINTER).json(pointer_path).orderBy(F.desc("version")).first()
    if r is None:
        raise RuntimeError("index not built")
    return r["index_path"], r["version"]


def first_of_each(lines: DataFrame, within: str, value_col: str = "value") -> DataFrame:
    """The first of equal messages of a streaming frame over files. Messages
    without a ``query_id`` are questions of their own and all stay. State is one
    key per message for ``within``; it is partitioned by the key."""
    named = F.get_json_object(value_col, "$.query_id").isNotNull()
    own = F.expr("uuid()")
    keyed = lines.select(value_col, F.col("_metadata.file_modification_time").alias("__received"),
                         F.when(named, F.concat(F.lit("="), F.sha2(value_col, 256))).otherwise(own).alias("__key"))
    return keyed.withWatermark("__received", within).dropDuplicatesWithinWatermark(["__key"]).select(value_col)


def answer_stream(spark: SparkSession, source_dir: str, pointer_path: str, sink_path: str,
                  checkpoint_path: str, cfg: Config = DEFAULT, embedder=None,
                  generator: Callable | None = None, max_files_per_trigger: int | None = None,
                  available_now: bool = True, once_within: str | None = None):
    """ST1: start the continuous query; returns the ``StreamingQuery``. The
    pointer names saved indexes (``operators.index.save_index``). ``once_within``
    (such as ``"1 day"``) is how long repeated messages are known."""
    from ..plans.rag import answer_from_index

    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir)
    if once_within:
        lines = first_of_each(lines, once_within)
    msgs = parse_messages(lines, default_k=cfg.top_k)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        index_path, version = read_pointer(spark, pointer_path)
        batch = batch.persist()
        try:
            good = batch.filter(F.col("parse_error").isNull()).select("query_id", "question", "top_k")
            bad = batch.filter(F.col("parse_error").isNotNull())
            res = answer_from_index(spark, good, index_path, cfg, embedder, generator)
            res = res.select(
                "query_id", "question", "answer", "error", "model",
                F.size("sources").cast("int").alias("n_sources"),
                F.try_element_at("scores", F.lit(1)).alias("top_score"),
                "chunks_retrieved", "chunks_used", "chunks_in_context")
            errs = bad.select(
                F.col("query_id"), F.col("question"), F.lit(None).cast("string").alias("answer"),
                F.col("parse_error").alias("error"), F.lit(None).cast("string").alias("model"),
                F.lit(0).alias("n_sources"), F.lit(None).cast("double").alias("top_score"),
                F.lit(0).alias("chunks_retrieved"), F.lit(0).alias("chunks_used"),
                F.lit(0).alias("chunks_in_context"))
            out = res.unionByName(errs).withColumn("index_version", F.lit(version))
            out.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = msgs.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
