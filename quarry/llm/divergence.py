"""Source divergence audit by hash-consed segment trees over term ids.

Within a language, every group (language, source) gives each kept term a
smoothed share p = 1 + floor(unit * (count + add) / (N + add * V)), V being the
kept terms and N the group's occurrences of them. The audit prices each two
groups of a language, the sum of |p - q| over all kept terms, and names the
terms that a source has more of than its language.

Terms are numbered 0 .. V-1. A group's counts are a segment tree over these
ids; a node is its pair of children, and equal nodes are one node (hash-consed
across the groups that are looked at together), so most of a sparse tree is the
few nodes of "no occurrence". Two trees are walked at once from the root. A
pair of nodes that was met before costs nothing more: each level keeps the
distinct node pairs of every two groups and how often each was met, and only at
the leaves a pair of counts has a price, taken that many times.

Scale: texts are counted in the tasks, one row per (group, term) and flush. A
tree is cut into subtrees of ``SEGMENT`` ids, and the groups of a language into
blocks of ``GROUP_BLOCK``; one (segment, block, block) is one row of work, so
neither a big vocabulary nor many sources make a task large, and what leaves it
is a partial price per two groups. Terms and counts stay in Spark throughout;
no vocabulary is broadcast or collected. Numbers of terms come from range
partitions and their counts, not from one sorted task.

Defined results: a null text has no terms; null languages and sources are the
empty string. Groups without terms, and languages without kept terms, have all
their pairs (with V = 0 at price 0). Prices beyond a long are null. Arithmetic
is in whole numbers of any size. Repeated rows count as often as they occur.
An empty table gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, scratch_path

#: bytes of terms: ASCII letters, lower-cased, and all of a character beyond
#: ASCII; every other byte is a space
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT = 1024          # leaves of one subtree, a power of two
GROUP_BLOCK = 64        # groups of a language that one row of work holds a side
FLUSH = 500_000         # entries that a task counts before it hands them on


@dataclass(frozen=True)
class Audit:
    least_docs: int = 30
    add: int = 5
    unit: int = 1_000_000_000
    top: int = 50


def _own(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


# ------------------------------------------------------------------ counting
def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(key, source, n, docs): occurrences and documents that have a term, in
    one or more rows per (group, term). The key is the term, a zero character,
    which no term holds, and the language."""
    def count(batches):
        seen: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            texts = b["text"].cast(pa.large_binary()).to_pylist()
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), texts):
                if (lang, source) not in seen:
                    seen[lang, source] = Counter(), Counter()
                n, docs = seen[lang, source]
                terms = text.translate(TERM_BYTES).split() if text else []
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size >= FLUSH:
                    yield from flush(seen)
                    seen, size = {}, 0
        yield from flush(seen)

    def flush(seen):
        for (lang, source), (n, docs) in seen.items():
            terms = list(n)
            for a in range(0, len(terms), 50_000):
                part = terms[a:a + 50_000]
                keys = pc.binary_join_element_wise(pa.array(part, pa.binary()).cast(pa.string()), pa.scalar(lang), "\0")
                yield pa.RecordBatch.from_arrays([
                    keys, pa.repeat(source, len(part)), pa.array(map(n.__getitem__, part), pa.int64()),
                    pa.array(map(docs.__getitem__, part), pa.int64())], ["key", "source", "n", "docs"])

    rows = df.select(_own(lang_col).alias("lang"), _own(source_col).alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "key string, source string, n bigint, docs bigint")


def numbered(terms: DataFrame) -> DataFrame:
    """Adds ``id`` to distinct (lang, term): 0 .. V-1 in a language by term, by
    range partitions and the counts before each."""
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = terms.repartitionByRange(parts, "lang", "term").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("lang", "part").agg(F.count("*").alias("c")).select(
        "lang", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("lang", "part").orderBy("term")
    return dealt.withColumn("i", F.row_number().over(inside)).join(F.broadcast(starts), ["lang", "part"]).withColumn(
        "id", F.col("start") + F.col("i") - 1).drop("i", "start", "part")


# ------------------------------------------------------------------ trees of one segment
def hash_consed(leaves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Trees over the rows of ``leaves`` (groups, a power of two), sharing
    equal subtrees: per level from the leaves up, each group's nodes by
    position, and for each distinct node its two children (level 0: its count)."""
    values, code = np.unique(leaves, return_inverse=True)
    nodes, kids = [code.reshape(leaves.shape)], [values]
    while nodes[-1].shape[1] > 1:
        pair = nodes[-1].reshape(len(leaves), -1, 2)
        size = int(pair.max()) + 1
        keys, code = np.unique(pair[..., 0].astype(np.int64) * size + pair[..., 1], return_inverse=True)
        nodes.append(code.reshape(pair.shape[:2]))
        kids.append(np.stack([keys // size, keys % size], 1))
    return nodes, kids


def priced(nodes: list[np.ndarray], kids: list[np.ndarray], pairs: np.ndarray, shares) -> list[int]:
    """Sum of |p - q| over all leaves for each (row, row) of ``pairs``;
    ``shares(rows, counts)`` gives p. Node pairs met more than once between the
    same two trees are walked once, with their number."""
    pair = np.arange(len(pairs))
    a, b = nodes[-1][pairs[:, 0], 0].astype(np.int64), nodes[-1][pairs[:, 1], 0].astype(np.int64)
    times = np.ones(len(pairs), np.int64)
    for level in range(len(kids) - 1, 0, -1):
        a, b = kids[level][a].ravel(), kids[level][b].ravel()
        pair, times = np.repeat(pair, 2), np.repeat(times, 2)
        size = len(kids[level - 1])
        key, at = np.unique((pair * size + a) * size + b, return_inverse=True)
        times = np.bincount(at, times, len(key)).astype(np.int64)
        a, b, pair = key // size % size, key % size, key // size // size
    cost = abs(shares(pairs[pair, 0], kids[0][a]) - shares(pairs[pair, 1], kids[0][b])) * times
    out = np.zeros(len(pairs), cost.dtype)
    np.add.at(out, pair, cost)
    return [int(x) for x in out]


def share(count, total, terms: int, conf: Audit):
    """p of counts (numbers or arrays of them) in groups of these totals."""
    return 1 + conf.unit * (count + conf.add) // (total + conf.add * terms)


def _pair_prices(work: DataFrame, conf: Audit) -> DataFrame:
    """(lang, source, item, part of the price) from ``work``: per (lang,
    segment, block, block) the two blocks' groups, with their counts there."""
    @F.arrow_udf("array<struct<source:string,item:string,price:decimal(38,0)>>")
    def price(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            groups, width, terms = row["groups"].as_py(), row["width"].as_py(), row["terms"].as_py()
            leaves = np.zeros((len(groups), 1 << max(width - 1, 0).bit_length()), np.int64)
            for i, g in enumerate(groups):
                leaves[i, g["at"]] = g["n"]
            nodes, kids = hash_consed(leaves)
            left, right = row["left"].as_py(), row["right"].as_py()
            side = [[i for i, g in enumerate(groups) if g["block"] == s] for s in (left, right)]
            pairs = np.array([(i, j) for i in side[0] for j in side[1] if left != right or i < j], np.int64).reshape(-1, 2)
            totals = np.array([g["total"] for g in groups], object)
            # shares add up to about the unit, so prices fit where unit * total does
            fits = conf.unit * (int(max(totals)) + conf.add * (terms + SEGMENT)) < 1 << 62
            kind = np.int64 if fits else object
            shares = lambda r, c: share(c.astype(kind), totals[r].astype(kind), terms, conf)
            found = priced(nodes, kids, pairs, shares) if len(pairs) else []
            # ids beyond the last term hold no term, but are priced like one without occurrence
            over = leaves.shape[1] - width
            none = [share(0, g["total"], terms, conf) for g in groups]
            out.append([{"source": groups[i]["source"], "item": groups[j]["source"],
                         "price": Decimal(v - over * abs(none[i] - none[j]))} for (i, j), v in zip(pairs, found)])
        return pa.array(out, pa.list_(pa.struct([("source", pa.string()), ("item", pa.string()), ("price", pa.decimal128(38, 0))])))

    row = F.struct("groups", "width", "terms", "left", "right")
    return work.select("lang", F.explode(price(row)).alias("e")).select(
        "lang", F.least("e.source", "e.item").alias("source"), F.greatest("e.source", "e.item").alias("item"), "e.price")


def audit(df: DataFrame, conf: Audit | None = None, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` prices the source
    against each other one, part ``term`` lists its ``top`` terms over its
    language's share."""
    conf = conf or Audit()
    spark = df.sparkSession
    checkpoint_dir(spark)
    groups = df.select(_own(lang_col).alias("lang"), _own(source_col).alias("source")).distinct()
    # one exchange by the key serves the groups' counts and the documents of a term
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = term_counts(df, text_col, lang_col, source_col).repartition(parts, "key").groupBy(
        "key", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.withColumn("docs", F.sum("docs").over(Window.partitionBy("key"))).where(F.col("docs") >= conf.least_docs)
    cut = F.instr("key", "\0")
    kept = kept.select(F.col("key").substr(cut + 1, F.length("key")).alias("lang"), "source",
                       F.col("key").substr(F.lit(1), cut - 1).alias("term"), "n")
    path = scratch_path(spark, "divergence-terms")
    kept.write.parquet(path)
    kept = spark.read.schema(kept.schema).parquet(path)
    terms = numbered(kept.groupBy("lang", "term").agg(F.sum("n").alias("all")))
    langs = groups.select("lang").distinct().join(
        terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total")), "lang", "left").select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    there = kept.join(terms, ["lang", "term"]).checkpoint()
    totals = groups.join(there.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    # groups in blocks by the order of a hash, about GROUP_BLOCK each
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    totals = totals.join(sizes, "lang").join(langs, "lang").withColumn(
        "block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).checkpoint()

    segments = there.withColumn("segment", F.expr(f"id div {SEGMENT}")).groupBy("lang", "segment", "source").agg(
        F.collect_list(F.struct((F.col("id") % SEGMENT).cast("int").alias("at"), "n")).alias("c"))
    every = totals.where("terms > 0").select(
        "lang", "source", "total", "block", "blocks", "terms", F.explode(F.expr(f"sequence(0L, (terms - 1) div {SEGMENT})")).alias("segment"))
    filled = every.join(segments, ["lang", "segment", "source"], "left").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    empty = F.array().cast("array<struct<at:int,n:bigint>>")
    work = filled.withColumn("c", F.coalesce("c", empty)).groupBy(
        "lang", "segment", "terms", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).agg(
        F.collect_list(F.struct("source", "block", "total", F.col("c.at").alias("at"), F.col("c.n").alias("n"))).alias("groups")).withColumn(
        "width", F.least(F.lit(SEGMENT), F.col("terms") - F.col("segment") * SEGMENT).cast("int"))
    half = _pair_prices(work, conf).groupBy("lang", "source", "item").agg(F.sum("price").alias("price"))
    half = half.unionAll(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "price"))
    nothing = totals.where("terms = 0").select("lang", "source")
    others = nothing.join(nothing.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select(
        "lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("price"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("price"), F.asc("item"))
    pairs = half.unionAll(others).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    whole = lambda c, total: F.expr(
        f"1 + CAST(({c} + {conf.add}) AS DECIMAL(24,0)) * {conf.unit} div ({total} + {conf.add} * terms)")
    more = there.join(totals.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (whole("n", "total") - whole("`all`", "lang_total")).alias("price")).where("price > 0")
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= conf.top).withColumn("part", F.lit("term"))
    cols = ["lang", "source", "part", "item", F.expr("try_cast(price AS bigint)").alias("value"), "rank"]
    return pairs.select(*cols).unionAll(terms.select(*cols))
