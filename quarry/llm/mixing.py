"""Mixing sources to target weights along a curriculum (DataFrame functions only).

Each source has a weight, which sets how many words the mix takes from it, and
a schedule, which sets when: its rate goes linearly from ``start`` to ``end``
over the training run t = 0..1. The integral of the rate is the share of the
source's words that the run has asked for by t; a document that begins at word
c of its source's stream is read when that demand reaches c, so its position
is the inverse of the integral at c. Sorting by position gives the run.

Targets: the mix takes ``share`` of all words, dealt to the sources by weight,
but at most ``cap`` times a source's own words; what that leaves over goes to
the others by weight until none is above its cap.

A source's stream is its documents in the order of a hash of their content,
read as often as the target asks. The last pass ends with the whole document
that brings the words taken nearest to the target, so they differ from it by
half a document at most and no text is cut. Only a source that has a single
document with words ends at the exact word, inside that document's last copy.

Scale: the running count inside a source is a sum over hash buckets first and
a window inside (source, bucket) second, so a source with a third of all rows
is 4096 windows, not one. Only per-iteration sums reach the driver.

Defined results: a null text has size 0; a null source is a source of its own,
ranked last. Documents without words are never taken. Of rows equal in id, text
and source some may be taken once more than others. Empty tables give an
empty mix. ``plan`` replaces columns named like one it adds.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

WORDS = r"[^\x20\x09-\x0D]+"
MADE = ["size", "source_size", "target", "taken", "copies", "position"]


@dataclass(frozen=True)
class Mix:
    """Weights and (start, end) rates by the source's rank, both repeating.
    ``share_pct``: words to take, in percent of all; ``cap``: passes at most."""
    weights: tuple = (3, 1, 2)
    schedules: tuple = ((3.0, 1.0), (1.0, 3.0), (1.0, 1.0))
    share_pct: int = 150
    cap: int = 2
    seed: str = "mix"


def _by_rank(values: tuple, rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(rank, F.lit(len(values))).cast("int"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ..) in the order (snull, skey), by range partitions
    and the counts before each, so that many sources need no single task."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(n, "snull", "skey").withColumn("p", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)     # one row a partition
    starts = dealt.groupBy("p").agg(F.count("*").alias("c")).select(
        "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("p").orderBy("snull", "skey")
    return dealt.withColumn("i", F.row_number().over(inside)).join(starts, "p").withColumn(
        "rank", F.col("start") + F.col("i") - 1).drop("p", "i", "start")


def targets(totals: DataFrame, mix: Mix) -> DataFrame:
    """(snull, skey, source_size) -> with weight, rates and ``target``."""
    s = _ranked(totals).withColumn("weight", _by_rank(mix.weights, F.col("rank")))
    s = s.withColumn("start", _by_rank(tuple(a for a, _ in mix.schedules), F.col("rank")))
    s = s.withColumn("end", _by_rank(tuple(b for _, b in mix.schedules), F.col("rank"))).drop("rank").checkpoint()
    # whole numbers, in hundredths of a word
    cap = (F.col("source_size") * (100 * mix.cap)).cast("decimal(38,0)")
    total, den = s.agg(F.sum("source_size") * mix.share_pct, F.sum("weight")).first()
    total, den = int(total or 0), int(den or 0)
    left = total
    full = F.lit(False)
    while den:
        full = cap * F.lit(den) <= F.lit(left).cast("decimal(38,0)") * F.col("weight")
        taken, rest = s.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = total - int(taken or 0), int(rest or 0)
        if now == (left, den):
            break
        left, den = now
    share = F.lit(float(left)) * F.col("weight") / F.lit(100.0 * den) if den else F.lit(0.0)
    whole = (F.col("source_size") * mix.cap).cast("double")
    return s.withColumn("target", F.when(full, whole).otherwise(share) if den else whole)


def _position(f: Column) -> Column:
    """t at which a source has been asked for the share f of its words: the
    inverse of the integral of start + (end - start) t, in its stable form."""
    a, b = F.col("start"), F.col("end")
    half = f * (a + b)                              # 2 f W(1)
    return F.when(f <= 0, 0.0).otherwise(half / (a + F.sqrt(a * a + (b - a) * half)))


def plan(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """``df`` with each document's place in the mix: ``size``, ``source_size``,
    ``target`` (its source's), ``taken`` (words), ``copies`` (passes that read
    it), ``position`` (of its first copy, else null)."""
    return _plan(df, mix or Mix(), id_col, text_col, source_col).select(
        *[F.col(_own(i)).alias(c) for i, c in enumerate(df.columns) if c not in MADE], *MADE)


def _own(i: int) -> str:
    """Name of the input's i-th column on the way: apart from all others, and
    a column of its own, so that what nobody reads is not shuffled."""
    return f"own_{i}"


def _plan(df: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    i, t, src = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    docs = df.select(
        *[F.col(f"`{c}`").alias(_own(k)) for k, c in enumerate(df.columns)], src.isNull().alias("snull"),
        F.coalesce(src, F.lit("")).alias("skey"), F.coalesce(F.regexp_count(t, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(mix.seed + "|"), F.coalesce(i, F.lit("")), F.lit("|"), F.coalesce(t, F.lit("")))).alias("h"))
    docs = docs.withColumn("b", F.substring("h", 1, 3))
    keys = ["snull", "skey"]
    buckets = docs.groupBy(*keys, "b").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("full")).checkpoint()
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(buckets.groupBy(*keys).agg(F.sum("words").alias("source_size"), F.sum("full").alias("n_full")), mix)
    starts = (buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .join(goals, keys).drop("words", "full", "weight"))
    inside = Window.partitionBy(*keys, "b").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    got = (docs.withColumn("in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
           .join(starts, [*keys, "b"]))
    words = F.round("target").cast("long")
    got = got.withColumn("before", F.col("base") + F.col("in")).withColumn("words", words)
    got = got.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
    rest = F.col("words") - F.col("passes") * F.col("source_size") - F.col("before")
    nearer = 2 * rest >= F.col("size")
    got = got.withColumn("cut", F.when(F.col("n_full") == 1, F.least(F.greatest(rest, F.lit(0)), "size"))
                         .otherwise(F.when((rest > 0) & nearer, F.col("size")).otherwise(0)).cast("long"))
    return got.withColumn("taken", F.col("passes") * F.col("size") + F.col("cut")).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("passes") + (F.col("cut") > 0).cast("long")).otherwise(F.lit(0)).cast("long")).withColumn(
        "position", F.when(F.col("copies") > 0, _position(F.col("before") / F.col("words"))))


def mixed(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The training run: a row per copy, with the columns of ``df``, sorted by
    position. The last copy of a source's only document may have its text cut
    after the last word taken."""
    got = _plan(df, mix or Mix(), id_col, text_col, source_col).where("copies > 0")
    got = got.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    got = got.withColumn("at", _position((F.col("copy") * F.col("source_size") + F.col("before")) / F.col("words")))
    own = {c: F.col(_own(k)) for k, c in enumerate(df.columns)}
    text = own[text_col]
    words, gaps = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.split(text, WORDS, -1)
    cut = F.col("cut").cast("int")
    head = F.array_join(F.transform(F.arrays_zip(F.slice(gaps, 1, cut).alias("g"), F.slice(words, 1, cut).alias("w")),
                                    lambda x: F.concat(x["g"], x["w"])), "")
    partly = (F.col("copy") == F.col("passes")) & (F.col("cut") < F.col("size"))
    got = got.orderBy("at", "h", "copy")
    return got.select(*[F.when(partly, head).otherwise(text).alias(c) if c == text_col else own[c].alias(c)
                        for c in df.columns])
