"""Line deduplication with a distributed suffix array (DataFrame functions only).

The corpus is one sequence of line ids in the order (id, line number), cut at
document ends. A run is a stretch of whole lines of one document; a run of at
least ``min_words`` words that also occurs at an earlier position is a later
copy, and every line inside a later copy is deleted. So each line's first
occurrence always stays, and equal documents lose all but the first.

Suffix array by prefix doubling: a position's rank after round k orders the
suffixes by their first 2^k lines; round k+1 ranks the pairs (rank here, rank
2^k lines on). Positions whose prefix occurs once leave at once, as no run
through them can repeat. A rank is a position in the suffix array, so ranks
split evenly into buckets: the running counts behind a new rank are summed per
bucket first, so no window outgrows the square root of the number of lines.

Runs: it is enough to look at minimal runs, those that begin (or end) at a
line and just reach ``min_words``; they cover exactly the lines of all maximal
repeated runs. The minimal runs of L lines that are equal are one interval of
suffixes whose longest common prefix is L or more; the interval is named by
the ranks of the run's first and last 2^k lines (2^k <= L < 2^(k+1)). Of each
interval the earliest position stays and the others are later copies.
``maximal_runs`` lists the maximal runs themselves with their earlier place,
grown from the minimal ones by the longest common prefixes of the suffixes.

Defined results: a null text has no lines and stays null; an empty text is one
empty line. Rows with one id are ordered by a hash of their text; rows equal
in id and text count as one document and are treated alike. A null id comes
first. A text that loses all lines becomes empty. Other columns pass through.
An empty table gives an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._keys import doc_key
from quarry.session import checkpoint_dir

WORDS = r"[^\x20\x09-\x0D]+"


def _lines(text: str) -> Column:
    return F.split(F.col(f"`{text}`"), "\n", -1)


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A slim row per line: document key (k1, k2), line number, 128-bit line
    id (h1, h2), words. No text."""
    k1, k2 = doc_key(df, id_col, text_col)
    lines = df.select(k1.alias("k1"), k2.alias("k2"), F.posexplode(_lines(text_col)).alias("ln", "line"))
    return lines.select("k1", "k2", F.col("ln").cast("long").alias("ln"), F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORDS)).alias("w"))


def _ranks(counts: DataFrame, bucket: int) -> DataFrame:
    """(r1, r2, c) -> (r1, r2, r): the suffix array position at which the
    suffixes with first half r1 and second half r2 begin. Windows hold at most
    ``bucket`` rows, or one row per bucket."""
    cut = counts.withColumn("b", F.floor(F.col("r2") / bucket))
    before = Window.partitionBy("r1").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("r1", "b").agg(F.sum("c").alias("c")).select(
        "r1", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("r1", "b").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(starts, ["r1", "b"]).select(
        "r1", "r2", (F.col("r1") + F.col("start") + F.col("in")).alias("r"))


def _first_ranks(repeated: DataFrame) -> DataFrame:
    """(h1, h2, c) -> (h1, h2, r): line ids in the order of their hashes. The
    hashes are uniform, so their top bits make even buckets."""
    cut = repeated.withColumn("b", F.shiftright("h1", 52))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)     # 4096 rows at most
    starts = cut.groupBy("b").agg(F.sum("c").alias("c")).select(
        "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("b").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(starts, "b").select(
        "h1", "h2", (F.col("start") + F.col("in")).alias("r"))


def _minimal_runs(positions: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, ln, isl, w) -> (k1, k2, ln, len): the runs that begin or end at
    a line of their stretch and just reach ``min_words``.

    With running word counts, a run's other end is the first line whose count
    reaches the target: lines and targets are sorted together and the nearest
    line passes down as a running minimum."""
    isl = ["k1", "k2", "isl"]
    upto = Window.partitionBy(*isl).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    cum = positions.withColumn("cum", F.sum("w").over(upto)).withColumn("c0", F.col("cum") - F.col("w"))
    # each row says twice where it stands and asks twice where its run ends
    events = cum.select(*isl, "ln", F.explode(F.array(
        F.struct(F.lit(1).alias("way"), (-F.col("cum")).alias("at"), F.lit(0).alias("asks")),
        F.struct(F.lit(1).alias("way"), (-(F.col("c0") + min_words)).alias("at"), F.lit(1).alias("asks")),
        F.struct(F.lit(2).alias("way"), F.col("c0").alias("at"), F.lit(0).alias("asks")),
        F.struct(F.lit(2).alias("way"), (F.col("cum") - min_words).alias("at"), F.lit(1).alias("asks")),
    )).alias("e")).select(*isl, "ln", "e.*")
    down = Window.partitionBy(*isl, "way").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    line = F.when(F.col("asks") == 0, F.col("ln"))
    ends = events.withColumn("end", F.when(F.col("way") == 1, F.min(line).over(down)).otherwise(F.max(line).over(down)))
    ends = ends.where("asks = 1 and end is not null")
    return ends.select("k1", "k2", F.least("ln", "end").alias("ln"), (F.abs(F.col("end") - F.col("ln")) + 1).alias("len")).distinct()


def _suffix_levels(base: DataFrame, bucket: int, top: int | None = None) -> list[DataFrame]:
    """Prefix doubling over ``base`` (k1, k2, ln, r): per round k the rows (k1,
    k2, ln, r) of the suffixes whose first 2^k lines are repeated, up to round
    ``top``, or (None) until no prefix is."""
    level = base.select("k1", "k2", "ln", "r")
    levels = [level]
    while top is None or len(levels) <= top:
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("k1", "k2").orderBy("ln").rangeBetween(step, step)
        pairs = level.select("k1", "k2", "ln", F.col("r").alias("r1"), F.first("r").over(ahead).alias("r2"))
        pairs = pairs.where("r2 is not null")
        counts = pairs.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1")
        level = pairs.join(_ranks(counts, bucket), ["r1", "r2"]).select("k1", "k2", "ln", "r").checkpoint()
        if top is None and level.isEmpty():
            break
        levels.append(level)
    return levels


def _copies(lines: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(k1, k2, ln, len, first) of every minimal run that occurs earlier as
    well, ``first`` (k1, k2, ln) being its earliest occurrence; the ranked lines
    of all stretches that may repeat; and the size of the rank buckets."""
    checkpoint_dir(lines.sparkSession)
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1")
    ranked = lines.join(_first_ranks(repeated), ["h1", "h2"]).select("k1", "k2", "ln", "w", "r")
    doc = Window.partitionBy("k1", "k2").orderBy("ln")
    island = Window.partitionBy("k1", "k2", "isl")
    base = (ranked.repartition(F.col("k1"), F.col("k2")).dropDuplicates(["k1", "k2", "ln"])
            .withColumn("isl", F.col("ln") - F.row_number().over(doc))
            .withColumn("words", F.sum("w").over(island)).where(F.col("words") >= min_words)
            .select("k1", "k2", "isl", "ln", "w", "r").checkpoint())
    runs = _minimal_runs(base, min_words).withColumn(
        "k", F.floor(F.log2(F.col("len").cast("double")) + 1e-9).cast("int")).checkpoint()
    top = runs.agg(F.max("k")).first()[0]
    if top is None:
        none = F.struct("k1", "k2", "ln").alias("first")
        return runs.select("k1", "k2", "ln", "len", none).limit(0), None, 1
    # as many positions a bucket as buckets: no window outgrows the root of all positions
    bucket = 1 << math.ceil(math.log2(lines.count() + 1) / 2)
    levels = [x.withColumn("k", F.lit(k)) for k, x in enumerate(_suffix_levels(base, bucket, top))]
    every = levels[0]
    for x in levels[1:]:
        every = every.unionAll(x)
    head = runs.join(every.withColumnRenamed("r", "r1"), ["k1", "k2", "ln", "k"])
    head = head.withColumn("tail", F.col("ln") + F.col("len") - F.expr("shiftleft(1L, k)"))
    tail = every.select("k1", "k2", "k", F.col("ln").alias("tail"), F.col("r").alias("r2"))
    interval = head.join(tail, ["k1", "k2", "k", "tail"]).select("k1", "k2", "ln", "len", "r1", "r2").checkpoint()
    at = F.struct("k1", "k2", "ln")
    first = interval.groupBy("len", "r1", "r2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.checkpoint()      # so that the join below can split a crowded interval
    copies = interval.join(first, ["len", "r1", "r2"]).where(at != F.col("first"))
    return copies.select("k1", "k2", "ln", "len", "first"), base, bucket


def later_copies(lines: DataFrame, min_words: int = 50) -> DataFrame:
    """(k1, k2, ln, len) of every minimal run that occurs earlier as well."""
    return _copies(lines, min_words)[0].select("k1", "k2", "ln", "len")


def _common(runs: DataFrame, levels: list[DataFrame], back: bool) -> DataFrame:
    """``runs`` (k1, k2, ln, f1, f2, fn) with ``lcp``: how many lines from (k1,
    k2, ln) on equal those from (f1, f2, fn) on, or (``back``) how many before.
    The longest common prefix of two suffixes comes from the level ranks: blocks
    of 2^k lines are equal where their ranks are, taken from the largest k down,
    each at most once, as no prefix of twice the last level's length repeats."""
    got = runs.withColumn("lcp", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        move = -F.col("lcp") - step if back else F.col("lcp")
        here = levels[k].select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("ln").alias("an"), F.col("r").alias("ra"))
        there = levels[k].select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("ln").alias("bn"), F.col("r").alias("rb"))
        got = (got.withColumn("x", F.col("ln") + move).withColumn("y", F.col("fn") + move)
               .join(here, F.expr("k1 = a1 AND k2 = a2 AND x = an"), "left").drop("a1", "a2", "an")
               .join(there, F.expr("f1 = b1 AND f2 = b2 AND y = bn"), "left").drop("b1", "b2", "bn")
               .withColumn("lcp", F.col("lcp") + F.when(F.col("ra") == F.col("rb"), step).otherwise(0))
               .select(*runs.columns, "lcp"))
    return got


def maximal_runs(df: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The repeated runs in long form: (id, start, n_lines, first_id,
    first_start), lines counted from 0. A row says that these lines of the
    document equal those at ``first_start`` of an earlier place, that they hold
    ``min_words`` words or more, that neither the line before nor the line
    behind is equal too, and that some minimal run inside has its earliest
    occurrence there. Every line that ``dedup_lines`` deletes lies in a run.

    Copies on one diagonal (same two documents, same distance) are merged first;
    only then the common prefixes of the suffixes behind and before them are
    taken from the level ranks. Windows hold one diagonal of two documents.
    Nulls, ties and repeated rows are treated as in ``dedup_lines``; the names of
    ``id_col`` and ``text_col`` may be any, other columns play no part."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = line_table(docs, "id", "text").checkpoint()
    copies, base, bucket = _copies(lines, min_words)
    k1, k2 = doc_key(docs, "id", "text")
    names = docs.select(k1.alias("k1"), k2.alias("k2"), "id").dropDuplicates(["k1", "k2"])
    levels = [] if base is None else _suffix_levels(base, bucket)
    pair = ["k1", "k2", "f1", "f2"]
    at = copies.select("k1", "k2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"), F.col("ln"),
                       (F.col("ln") - F.col("first.ln")).alias("d"), (F.col("ln") + F.col("len")).alias("end"))
    before = Window.partitionBy(*pair, "d").orderBy("ln", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*pair, "d").orderBy("ln", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = (at.withColumn("new", F.when(F.col("ln") <= F.max("end").over(before), 0).otherwise(1))
              .withColumn("g", F.sum("new").over(upto))
              .groupBy(*pair, "d", "g").agg(F.min("ln").alias("a"), F.max("end").alias("b")).drop("g").checkpoint())
    left = _common(merged.select(*pair, "d", "b", F.col("a").alias("ln"), (F.col("a") - F.col("d")).alias("fn")), levels, True)
    left = left.select(*pair, "d", "b", (F.col("ln") - F.col("lcp")).alias("a")).checkpoint()
    right = _common(left.select(*pair, "d", "a", F.col("b").alias("ln"), (F.col("b") - F.col("d")).alias("fn")), levels, False)
    runs = right.select(*pair, "d", "a", (F.col("ln") + F.col("lcp")).alias("b")).distinct()
    first = names.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("id").alias("first_id"))
    return runs.join(names, ["k1", "k2"]).join(first, ["f1", "f2"]).select(
        F.col("id").alias(id_col), F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("n_lines"),
        "first_id", (F.col("a") - F.col("d")).alias("first_start"))


def dedup_lines(df: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the later copies cut from the text, plus ``n_lines`` (before)
    and ``n_removed``; columns of these names are replaced."""
    lines = line_table(df, id_col, text_col).checkpoint()
    copies = later_copies(lines, min_words)
    # the union of a document's copies as disjoint stretches [a, b)
    doc = Window.partitionBy("k1", "k2").orderBy("ln", "len").rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy("k1", "k2").orderBy("ln", "len").rowsBetween(Window.unboundedPreceding, 0)
    merged = (copies.withColumn("b", F.col("ln") + F.col("len"))
              .withColumn("new", F.when(F.col("ln") <= F.max("b").over(doc), 0).otherwise(1))
              .withColumn("g", F.sum("new").over(runs))
              .groupBy("k1", "k2", "g").agg(F.min("ln").cast("int").alias("a"), F.max("b").cast("int").alias("b"))
              .groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("__cuts")))
    k1, k2 = doc_key(df, id_col, text_col)
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    got = rows.join(merged.hint("shuffle_hash"), ["k1", "k2"], "left").select(
        "row.*", "__cuts", F.split(F.col("row")[text_col], "\n", -1).alias("__lines"))
    cuts, lines = F.col("__cuts"), F.col("__lines")
    n = F.size(cuts)
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.when(i > 0, F.get(cuts, i - 1)["b"]).otherwise(0).alias("a"),
        F.when(i < n, F.get(cuts, i)["a"]).otherwise(F.size(lines)).alias("b")))
    kept = F.filter(kept, lambda x: x["b"] > x["a"])
    text = F.array_join(F.transform(kept, lambda x: F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n")), "\n")
    gone = F.aggregate(cuts, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    cols = [F.when(cuts.isNull(), F.col(f"`{text_col}`")).otherwise(text).alias(text_col) if c == text_col
            else F.col(f"`{c}`") for c in rest]
    return got.select(*cols, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))
