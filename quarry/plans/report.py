"""Benchmark and demo reports (C8, C9) as operators over tables that exist
already: nothing here scans the corpus."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..operators.evaluate import keyword_accuracy


def compare_answers(answers: DataFrame, baseline: DataFrame, keywords: Column, cut: int = 200) -> DataFrame:
    """C8 per question: both variants under a tag (U2), their keyword accuracy
    and the answer cut for display (PF11). ``answers`` and ``baseline`` have
    ``query_id, question, answer``; ``answers`` also ``chunks_used``."""
    both = answers.select("query_id", "question", F.lit("rag").alias("variant"), "answer", "chunks_used").unionByName(
        baseline.select("query_id", "question", F.lit("baseline").alias("variant"), "answer",
                        F.lit(None).cast("int").alias("chunks_used")))
    scored = both.withColumn("keyword_accuracy", keyword_accuracy("answer", keywords))
    return scored.select("query_id", "question", "variant", truncate("answer", cut).alias("answer"),
                         "keyword_accuracy", "chunks_used")


def comparison(per_question: DataFrame, quality: DataFrame) -> DataFrame:
    """Averages (A11), improvement (A12) and mean quality, one row.
    ``per_question`` has ``variant, keyword_accuracy``."""
    mean = lambda v: F.avg(F.when(F.col("variant") == v, F.col("keyword_accuracy")))
    acc = per_question.agg(mean("baseline").alias("b"), mean("rag").alias("r"), F.lit(1).alias("one"))
    q = quality.agg(F.avg("quality_score").alias("q"), F.lit(1).alias("one"))
    gain = F.col("r") - F.col("b")
    # both sides are single-row aggregates
    return acc.join(q, "one").select(
        F.round("b", 4).alias("baseline_avg_accuracy"), F.round("r", 4).alias("rag_avg_accuracy"),
        F.round(gain, 4).alias("improvement_absolute"),
        F.round(F.when(F.col("b") > 0, gain / F.col("b") * 100).otherwise(F.lit(0.0)), 1).alias("improvement_relative_pct"),
        F.round("q", 4).alias("rag_avg_quality_score"))


def demo_summary(quality: DataFrame, total_chunks: DataFrame) -> DataFrame:
    """Mean quality, pass rate and index size, one row.
    ``total_chunks`` has the one row that ``index_stats`` gives."""
    q = quality.agg(
        F.round(F.avg("quality_score"), 4).alias("average_quality"),
        F.round(F.avg(F.col("pass").cast("double")), 4).alias("pass_rate"),
        F.count(F.lit(1)).alias("n_questions"), F.lit(1).alias("one"))
    return q.join(total_chunks.select("total_chunks", F.lit(1).alias("one")), "one").drop("one")


def question_report(quality: DataFrame, questions: DataFrame, cut: int = 200) -> DataFrame:
    """PF12: the evaluation of every question beside its text, cut for
    display. ``quality`` is ``evaluate``'s result."""
    return questions.select("query_id", truncate("question", cut).alias("question")).join(quality, "query_id").select(
        "query_id", "question", "quality_score", "relevance", "groundedness", "safety", "pass")
