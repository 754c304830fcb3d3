"""Batch cleaning (PF5) and request validation (PF9)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """PF5: replace the text column with its cleaned form (one projection)."""
    return docs.withColumn(text_col, clean_text(F.col(text_col)))


def validate_questions(questions: DataFrame, default_k: int = 5, max_k: int = 20,
                       max_chars: int = 2000) -> DataFrame:
    """PF9: one validator for batch and stream.

    Adds ``k`` (``top_k`` or the default; 0 is invalid, not "default") and
    ``error`` (NULL when valid). Callers split with ``error IS NULL``."""
    q = F.col("question")
    has_k = "top_k" in questions.columns
    k = F.coalesce(F.col("top_k").cast("int"), F.lit(default_k)) if has_k else F.lit(default_k)
    err = (F.when(q.isNull() | (F.length(q) < 1), F.lit("question must not be empty"))
           .when(F.length(q) > max_chars, F.lit(f"question longer than {max_chars} characters"))
           .when((k < 1) | (k > max_k), F.lit(f"top_k must be between 1 and {max_k}")))
    return questions.withColumn("k", k).withColumn("error", err)
