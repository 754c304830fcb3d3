"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so a component never
meets in one task and nothing is collected. Each step's edges go to the shared
checkpoint folder (lost executors cost a re-read, not the whole history).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to the least node it
    sees. Small star: each node links its smaller neighbours, and itself, to
    the least of them. ``edges`` holds (u, v) with u > v."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("m", "u").alias("m"))
        out = both.join(low, both.u == low.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        out = edges.join(low, edges.u == low.n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (u, v), the root
    being the least node of its component. Loops (u = v), repeated and
    mirrored edges are fine; an empty table gives an empty result."""
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    e = e.distinct().checkpoint()
    seen = None
    while True:
        e = _star(_star(e, True), False).checkpoint()
        # the edge set is settled when neither its size nor its sums change
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
