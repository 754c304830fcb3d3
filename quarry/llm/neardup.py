"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprints: XXH64 (seed 42) of every word shingle of the lower-cased text;
a bit is set where more than half the shingles' hashes set it.

Links: the 64 bits form a ring of segments. If two fingerprints differ in at
most ``radius`` bits, some segment starts a chain in which the first l
segments differ in at most floor(l * radius / segments) bits, for every l.
The leading part of that budget is zero, so the chain's first segments agree
exactly and serve as a key; the rest of the chain is checked segment by
segment before the full Hamming distance.

Scale: copies fold to one row per distinct fingerprint before any pairing. A
key's fingerprints are compared inside one row of at most ``group_limit``
values, and only a spanning forest of the links found there leaves it, never
all pairs. Fuller keys take an exact other way with no group at all: two
fingerprints within the radius share a value at half the radius from both, so
each emits the values around itself, and fingerprints that meet there are
joined in a star (radius 2: 65 values each, at most 65 meet).

Defined results: null and word-less texts have fingerprint zero and link like
any other. Rows with a null id get a component like all others, but the
component's id is its least non-null id (null if there is none). Repeated
rows keep one row each. Columns of the input named ``fingerprint`` or
``component_id`` are replaced. An empty table gives an empty result.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._bits import majority, ring_mask, signed, word_cuts
from quarry.llm._graph import components
from quarry.llm._keys import doc_key
from quarry.session import checkpoint_dir

def shingle_hashes(buf: np.ndarray, off: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the documents' shingles (words joined by one space), and how
    many each document has. Fewer words than a shingle: the whole sequence."""
    low = tx.LOWER[buf]
    start, end = tx.spans(low, ~tx.SEP[low], off)
    per_doc = np.bincount(tx.doc_of(off, start), minlength=len(off) - 1)
    # words joined by single spaces, so that a shingle is one slice
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(at[-1] + size[-1]) if len(size) else 0, 0x20, np.uint8)
    take = np.repeat(start - at, size) + (to := np.repeat(at, size) + _ramp(size))
    joined[to] = low[take]
    n = np.where(per_doc == 0, 0, np.maximum(per_doc - shingle + 1, 1))
    doc = np.repeat(np.arange(len(per_doc)), n)
    first_word = np.concatenate(([0], np.cumsum(per_doc)[:-1]))
    first = first_word[doc] + _ramp(n)
    last = first + np.minimum(per_doc[doc], shingle) - 1
    view, h64 = joined.tobytes(), xxhash.xxh64_intdigest
    a, b = at[first].tolist(), (at[last] + size[last]).tolist()
    return np.fromiter((h64(view[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a)), n


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0..sizes[0]-1, 0..sizes[1]-1, ..."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def simhash(text, shingle: int = 3, seed: int = 42):
    """Column of 64-bit fingerprints (as a signed long) of a text column."""
    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        parts = [majority(*shingle_hashes(buf, off, shingle, seed)) for _, buf, off in tx.blocks(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64), pa.int64())

    return fingerprint(text.cast("string"))


def chain(segments: int, radius: int, start: int) -> tuple[int, list[tuple[int, int]]]:
    """Key mask of the chain that starts at a segment, and (mask, budget) of
    each longer prefix of the chain, up to the whole ring."""
    parts = word_cuts(segments)
    order = [parts[(start + j) % segments] for j in range(segments)]
    budget = [(j + 1) * radius // segments for j in range(segments)]
    zero = sum(b == 0 for b in budget)
    return ring_mask(order[:zero]), [(ring_mask(order[:j + 1]), budget[j]) for j in range(zero, segments)]


def spanning_links(values: np.ndarray, checks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that share a
    chain key. ``checks`` are the chain's budgets, the last one the radius
    over all bits; a candidate that breaks one leaves at once."""
    left, found = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.ones(len(left), bool)
            diff = left ^ x
            for mask, most in checks:
                near &= np.bitwise_count(diff & np.uint64(mask)) <= most
            if near.any():
                hit = left[near]
                found += [(int(x), int(y)) for y in hit]
                queue += list(hit)
                left = left[~near]
    return found


def links(prints: DataFrame, radius: int = 2, segments: int = 5, group_limit: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) that connect
    exactly the fingerprints that links within ``radius`` connect."""
    if radius < 1:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    chains = [chain(segments, radius, i) for i in range(segments)]
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for i, (m, _) in enumerate(chains)])).alias("k")).select("fp", "k.seg", "k.key")
    sizes = keyed.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1").checkpoint()

    @F.arrow_udf("array<struct<u:bigint,v:bigint>>")
    def forest(seg: pa.Array, members: pa.Array) -> pa.Array:
        out = []
        for s, m in zip(seg.to_pylist(), members):
            v = np.sort(m.values.to_numpy().view(np.uint64))
            out.append([(signed(a), signed(b)) for a, b in spanning_links(v, chains[s][1])])
        return pa.array([[{"u": a, "v": b} for a, b in x] for x in out],
                        pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())])))

    small = sizes.where(F.col("n") <= group_limit).drop("n")
    inside = (keyed.join(small, ["seg", "key"]).groupBy("seg", "key").agg(F.collect_list("fp").alias("members"))
              .select(F.explode(forest("seg", "members")).alias("e")).select("e.u", "e.v"))
    crowded = sizes.where(F.col("n") > group_limit).drop("n")
    if not crowded.head(1):
        return inside
    flips = [signed(sum(1 << b for b in bits)) for r in range(math.ceil(radius / 2) + 1)
             for bits in combinations(range(64), r)]
    hot = keyed.join(crowded, ["seg", "key"]).select("fp").distinct()
    around = hot.select("fp", F.explode(F.transform(
        F.array(*[F.lit(x) for x in flips]), lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    if radius % 2 == 0:     # meeting halfway is the link itself
        far = around.groupBy("mid").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("vs"))
        far = far.where(F.size("vs") > 1).select("u", F.explode("vs").alias("v")).where("u <> v")
    else:                   # meeting within (radius + 1) / 2 of both is not enough: check each pair
        far = around.alias("a").join(around.alias("b"), "mid").select(
            F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).where("u < v").where(
            F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return inside.unionAll(far)


def near_duplicates(df: DataFrame, radius: int = 2, shingle: int = 3, segments: int = 5,
                    group_limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, k1, k2, fp, root, component_id).

    ``fp`` is the fingerprint as a signed long, ``root`` the least fingerprint
    of the component, ``component_id`` the least id in it; (k1, k2) is the
    row's key (``_keys.doc_key``)."""
    checkpoint_dir(df.sparkSession)
    k1, k2 = doc_key(df, id_col, text_col)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), k1.alias("k1"), k2.alias("k2"),
                     simhash(F.col(f"`{text_col}`"), shingle).alias("fp")).checkpoint()
    prints = docs.groupBy("fp").agg(F.min("id").alias("low")).checkpoint()
    roots = components(links(prints.select("fp"), radius, segments, group_limit))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id").checkpoint()
    return docs.join(named, "fp").select("id", "k1", "k2", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row
    with the least id stays (nulls last, then the least fingerprint and key;
    of rows equal in id and text, one)."""
    near = near_duplicates(df, id_col=id_col, text_col=text_col, **options).select(
        "k1", "k2", "root", F.struct(F.col("id").isNull(), "id", "fp", "k1", "k2").alias("rank"))
    best = near.groupBy("root").agg(F.min("rank").alias("r")).select("r.k1", "r.k2")
    k1, k2 = doc_key(df, id_col, text_col)
    mine = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    kept = mine.join(best, ["k1", "k2"], "left_semi")
    first = Window.partitionBy("k1", "k2").orderBy("k1")
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
