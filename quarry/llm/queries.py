"""One query per operator, each over its whole table at ``sf_dir``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import centroids, chat, divergence, minhash
from quarry.llm.bpe import round_trip
from quarry.llm.fingerprints import against_next, neighbours
from quarry.llm.html_text import main_text
from quarry.llm.linededup import dedup_lines
from quarry.llm.mixing import plan
from quarry.llm.neardup import near_duplicates
from quarry.llm.pii import pseudonymise
from quarry.llm.quality import COUNTS, quality_rules
from quarry.llm.warc import archive_pages, read_pages
from quarry.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_pages(spark, path)


def _vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this node."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, _vocabulary("byte_bpe_50k.json")).drop("text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return got.orderBy(F.asc_nulls_last("position"), "doc_id")     # the run's order; what it leaves out comes last


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *COUNTS[:5], "base_failed", "kept")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 100 also search all fingerprints:
    ``n_near`` is how many other ones are within 3 bits (null elsewhere)."""
    docs = against_next(_table(spark, sf_dir, "documents").select("doc_id", "text")).checkpoint()
    asks = docs.where("doc_id % 100 = 0").select("fp")
    found = neighbours(asks, docs.select("fp"), radius=3).where("distance > 0").groupBy("query").agg(F.count("*").alias("n"))
    near = asks.distinct().join(found.withColumnRenamed("query", "fp"), "fp", "left").select(
        "fp", F.coalesce("n", F.lit(0)).alias("n_near"))
    # only the asking rows meet the counts; the others need no join
    asking = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    got = docs.where(asking).join(near, "fp").unionByName(docs.where(~asking).withColumn("n_near", F.lit(None).cast("bigint")))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return got.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"),
                      text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.windows(turns, budget=1024, history=256))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), radius=2, shingle=3)
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_words=50).select("doc_id", "n_lines", "n_removed", "text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key=spark.conf.get("quarry.pii.key", "not-a-secret"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got, _ = centroids.cluster(vectors, centroids.Clustering(k=40, dim=64, rounds=5, scale=256, seed="2"))
    return centroids.with_inertia(got).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.col("centroid").alias("centroid_sha256"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    near = minhash.near_duplicates(docs, minhash.MinHash(shingle=3, percent=85))
    return near.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                       F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence.audit(docs, divergence.Audit(least_docs=30, add=5, unit=1_000_000_000, top=50))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_html_text": op3_html_text,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_rules": op5_quality_rules,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat": op7_chat,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
    "op11_centroids": op11_centroids,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_divergence": op13_divergence,
}
