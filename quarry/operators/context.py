"""The token budget of a context (W2) and conversation rendering.

All per-question groups here are bounded by the question's k (at most
``max_top_k`` rows), so ordered collection per question is safe.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompt as P


def budget_context(hits: DataFrame, max_tokens: int, key: str = "query_id") -> DataFrame:
    """Running token total in rank order; a hit is in the context while
    the running total stays within the budget. Because counts are >= 0 the
    running sum is monotone, so this equals the reference's prefix loop
    (the first overflowing chunk ends the context even if a later one fits).
    Adds ``running_tokens`` and ``in_context``."""
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    tc = F.coalesce(F.col("token_count"), F.lit(0))
    return hits.withColumn("running_tokens", F.sum(tc).over(w)) \
        .withColumn("in_context", F.col("running_tokens") <= F.lit(max_tokens))


def conversation_segments(conv: DataFrame) -> DataFrame:
    """F17 in long form: ``conv_id, turn, seg``, a rendered message per turn
    (roles outside the template left out). For conversations too long for one
    value; ``render_conversations`` joins the same segments."""
    return conv.select("conv_id", "turn", P.chat_segment(F.col("role"), F.col("text")).alias("seg")).filter(
        F.col("seg").isNotNull())


def render_conversations(conv: DataFrame, block_turns: int = 256) -> DataFrame:
    """F17 over a long table ``conv_id, turn, role, text``: one transcript
    per conversation, as one prompt, so a conversation must fit a value (use
    ``conversation_segments`` for any longer). Segments are rendered row by row; turns are then
    concatenated in two levels (blocks of ``block_turns`` turns, then the
    blocks), so ordering work for a very long conversation is split across
    tasks and no level sorts more than one block of rows."""
    seg = P.chat_segment(F.col("role"), F.col("text"))  # NULL for other roles
    lvl1 = conv.select("conv_id", "turn", seg.alias("seg")) \
        .groupBy("conv_id", F.floor(F.col("turn") / block_turns).alias("blk")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "seg"))),
                                     lambda x: x["seg"]), "\n").alias("part"))  # skips NULLs
    lvl2 = lvl1.groupBy("conv_id").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("blk", "part"))),
                                          lambda x: x["part"]), lambda p: p != ""), "\n").alias("body"))
    return lvl2.select(
        "conv_id",
        F.concat(F.when(F.length("body") > 0, F.concat(F.col("body"), F.lit("\n"))).otherwise(F.lit("")),
                 F.lit(P.ASSISTANT_TAG)).alias("prompt"))
