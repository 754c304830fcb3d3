"""MinHash near-duplicate detection: universal hash minima, banding, signature
verification, confirmation on full sets, alternating large-star / small-star.

A document's set is its distinct word shingles (words of the lower-cased text;
with fewer words than a shingle, the whole sequence). Two documents link if
the Jaccard similarity of their sets is at least ``percent`` / 100, in whole
numbers: 100 * intersection >= percent * union.

Steps, each linear in what it reads unless a group is crowded:

1. Equal sets fold to one row (by a 128-bit digest of the set), so a copied
   document costs one row however many copies there are.
2. ``bands * rows`` hash functions x -> (a x + b) mod 2^64 / 2^32 with random
   odd a; a document's minimum under each. A band's minima make its bucket key.
   Two sets at similarity s share a bucket with chance 1 - (1 - s^rows)^bands;
   at 0.85 and 30 bands of 5 rows a pair is missed once in 4 * 10^7.
3. Signature verification inside buckets: pairs whose signatures agree in fewer
   places than six standard deviations below the threshold are no candidates
   (a true pair fails this once in 10^7). Only links that
   connect a bucket's local components leave it; they make the candidate groups.
4. Confirmation inside candidate groups on the full shingle sets; again
   one link per member at most leaves each group. No estimate decides a link.
5. Components of the confirmed links.

Groups are worked through in parts of at most ``part_rows`` sets and about
``part_bytes`` bytes. A crowded group's parts all hold a share of its members
and a common set of pivots, which joins most of what links; then everything
not yet linked to the main pivots meets every member, part by part. So no
group is ever in one task, no pair is left out, and a group costs rows in
proportion to its members times the parts of its outsiders.

Defined results: null, empty and word-less texts have empty sets and link with
nothing. A null id takes part like any other; a component's id is its least
non-null id (null if there is none). Repeated rows keep one row each. An empty
table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._graph import components
from quarry.llm._keys import doc_key
from quarry.session import checkpoint_dir, scratch_path


@dataclass(frozen=True)
class MinHash:
    shingle: int = 3
    percent: int = 85
    bands: int = 30
    rows: int = 5
    seed: int = 20240607
    part_rows: int = 512
    part_bytes: int = 16 << 20

    @property
    def least_matches(self) -> int:
        """Places in which two signatures must agree to be candidates."""
        n, s = self.bands * self.rows, self.percent / 100
        return max(0, math.floor(n * s - 6 * math.sqrt(n * s * (1 - s))))


# ------------------------------------------------------------------ sets
def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, sorted within it, and
    how many each document has."""
    low = tx.LOWER[buf]
    start, end = tx.spans(low, ~tx.SEP[low], off)
    docs = len(off) - 1
    word = tx.span_hash(tx.rolling(low), start, end)
    doc = tx.doc_of(off, start)
    n = np.bincount(doc, minlength=docs)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    grams = tx.ngram_hash(word, shingle)
    whole = np.flatnonzero(doc[:len(grams)] == doc[len(word) - len(grams):]) if len(grams) else np.zeros(0, np.int64)
    hashes, owner = [grams[whole]], [doc[whole]]
    for d in np.flatnonzero((n > 0) & (n < shingle)):
        hashes.append(tx.ngram_hash(word[first[d]:first[d] + n[d]], int(n[d])))
        owner.append(np.array([d]))
    h, d = tx.mix(np.concatenate(hashes)), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=docs)


def signatures(h: np.ndarray, n: np.ndarray, conf: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """(documents, bands) bucket keys and (documents, bands * rows) signature
    bytes; zeros for empty sets."""
    rnd = np.random.Generator(np.random.PCG64(conf.seed))
    many = conf.bands * conf.rows
    a = rnd.integers(0, 1 << 63, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rnd.integers(0, 1 << 63, many, dtype=np.uint64)
    keys = np.zeros((len(n), conf.bands), np.uint64)
    sig = np.zeros((len(n), many), np.uint8)
    full = np.flatnonzero(n)
    if not len(full):
        return keys, sig
    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
    for i in range(many):
        low = np.minimum.reduceat((h * a[i] + b[i]) >> np.uint64(32), at)
        sig[full, i] = tx.mix(low).astype(np.uint8)
        band = i // conf.rows
        keys[full, band] = tx.mix(keys[full, band] * np.uint64(tx.BASE) + low + np.uint64(1 + band))
    return keys, sig


def set_digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set: two sums of independent finalisers."""
    out = np.zeros((len(n), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, k] = np.add.reduceat(tx.mix(h ^ np.uint64(salt)), at)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """A byte matrix as an Arrow binary array, one value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    flat = pa.py_buffer(rows.tobytes())
    off = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int64) * width).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, off, flat]).cast(pa.binary())


def prints(text: Column, conf: MinHash) -> Column:
    """struct(n, fid, keys, sig) of a text column."""
    @F.arrow_udf("struct<n:bigint,fid:binary,keys:array<bigint>,sig:binary>")
    def make(texts: pa.Array) -> pa.Array:
        parts = []
        for _, buf, off in tx.blocks(texts):
            h, n = shingle_sets(buf, off, conf.shingle)
            keys, sig = signatures(h, n, conf)
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * conf.bands)
            parts.append(pa.StructArray.from_arrays(
                [pa.array(n.astype(np.int64)), _fixed(set_digests(h, n)),
                 pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel())), _fixed(sig)],
                ["n", "fid", "keys", "sig"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
            [("n", pa.int64()), ("fid", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())]))

    return make(text.cast("string"))


def full_set(text: Column, conf: MinHash) -> Column:
    """The document's set as the bytes of its sorted shingle hashes."""
    @F.arrow_udf("binary")
    def make(texts: pa.Array) -> pa.Array:
        out = []
        for _, buf, off in tx.blocks(texts):
            h, n = shingle_sets(buf, off, conf.shingle)
            raw, cut = h.astype("<u8").tobytes(), np.concatenate(([0], np.cumsum(n))) * 8
            out += [raw[i:j] for i, j in zip(cut[:-1], cut[1:])]
        return pa.array(out, pa.binary())

    return make(text.cast("string"))


# ------------------------------------------------------------------ links inside one part
def local_components(n: int, known: np.ndarray, near) -> np.ndarray:
    """Component (the least row in it) of each of the rows 0..n-1 under the
    links that ``near(i)`` (a mask of all rows) tells, rows of one ``known``
    component being linked already."""
    left, out = np.ones(n, bool), np.arange(n)

    def take(i: int) -> list[int]:
        same = np.flatnonzero(left & (known == known[i]))
        left[same] = False
        return same.tolist()

    for s in range(n):
        if not left[s]:
            continue
        queue = take(s)
        while queue:
            x = queue.pop()
            out[x] = s
            if left.any():
                for y in np.flatnonzero(left & near(x)).tolist():
                    if left[y]:
                        queue += take(y)
    return out


def near_signatures(payload: list[bytes], least: int):
    sig = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
    return lambda i: np.count_nonzero(sig == sig[i], axis=1) >= least


def near_sets(payload: list[bytes], percent: int):
    size = np.array([len(p) // 8 for p in payload], np.int64)
    values, code = np.unique(np.frombuffer(b"".join(payload), "<u8"), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(len(values), bool)

    def near(i: int) -> np.ndarray:
        mine = code[ends[i]:ends[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[code], ends[:-1])      # no set here is empty
        mark[mine] = False
        return 100 * both >= percent * (size + size[i] - both)

    return near


MAIN = -1           # label of the members that are linked to a crowded group's main pivots
_EDGES = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())]))


def _links(members: DataFrame, keys: list[str], make) -> DataFrame:
    """(e, main) per group of ``members`` (keys, sid, known, pivot, payload):
    links from the least row of each local component to its other rows, and
    which rows are in the component of the main pivots, those of the largest
    component that the group's pivots make among themselves."""
    @F.arrow_udf("struct<e:array<struct<u:bigint,v:bigint>>,main:array<bigint>>")
    def inside(groups: pa.Array) -> pa.Array:
        edges, mains = [], []
        for g in groups:
            rows = g.values
            sid, at = np.unique(rows.field("sid").to_numpy(), return_index=True)    # a pivot is in its own share too
            known = rows.field("known").to_numpy()[at]
            pivots = np.flatnonzero(rows.field("pivot").to_numpy(zero_copy_only=False)[at])
            payload = rows.field("payload").take(pa.array(at)).to_pylist()
            own = local_components(len(sid), known, make(payload))
            edges.append([{"u": u, "v": v} for u, v in zip(sid[own].tolist(), sid.tolist()) if u != v])
            main = np.zeros(0, np.int64)
            if len(pivots):
                alone = local_components(len(pivots), np.arange(len(pivots)), make([payload[i] for i in pivots]))
                main = sid[own == own[pivots[np.bincount(alone).argmax()]]]
            mains.append(main.tolist())
        return pa.StructArray.from_arrays([pa.array(edges, _EDGES), pa.array(mains, pa.list_(pa.int64()))], ["e", "main"])

    lists = members.groupBy(*keys).agg(F.collect_list(F.struct("sid", "known", "pivot", "payload")).alias("g"))
    return lists.where(F.size("g") > 1).select(keys[0], inside("g").alias("x")).select(keys[0], "x.e", "x.main")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.explode("e").alias("e")).select("e.u", "e.v")


PIVOT_SHARE = 8     # one of so many members of a part's size is a pivot


def spanning(members: DataFrame, make) -> DataFrame:
    """Edges that connect what the links inside each group connect.
    ``members``: (grp, sid, parts, payload), ``parts`` being how many parts
    the group is worked through in; each sid once a group. It is read more
    than once, so it should be a table."""
    alone = members.withColumn("known", F.col("sid")).withColumn("pivot", F.lit(False))
    edges = _edges(_links(alone.where("parts = 1"), ["grp"], make))
    crowded = alone.where("parts > 1")
    if not crowded.head(1):
        return edges
    spark = members.sparkSession
    parts = F.col("parts").cast("bigint")
    every = F.sequence(F.lit(0).cast("bigint"), parts - 1)
    share = crowded.withColumn("part", F.pmod(F.xxhash64("sid", F.lit("part")), parts))
    pivots = crowded.where(F.pmod(F.xxhash64("sid", F.lit("pivot")), parts * PIVOT_SHARE) == 0).withColumn("pivot", F.lit(True))
    path = scratch_path(spark, "minhash-links")
    first = _links(pivots.withColumn("part", F.explode(every)).unionByName(share), ["grp", "part"], make)
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    main = first.select("grp", F.explode("main").alias("sid")).distinct().withColumn("m", F.lit(True))
    named = share.join(main, ["grp", "sid"], "left").withColumn(
        "known", F.when(F.col("m"), F.lit(MAIN)).otherwise(F.col("sid"))).drop("m")
    # those outside meet every member, in turns of about a part's size
    turns = named.groupBy("grp").agg(F.count_if(F.col("known") != MAIN).alias("out"), F.count("*").alias("n"), F.max(parts).alias("p")).where(
        "out > 0").select("grp", F.ceil(F.col("out") * F.col("p") / F.col("n")).cast("bigint").alias("turns"))
    named = named.join(turns, "grp")
    cols = ["grp", "part", "turn", "sid", "known", "pivot", "payload"]
    meet = named.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1))).select(*cols).unionAll(
        named.where(F.col("known") != MAIN).withColumn("turn", F.pmod(F.xxhash64("sid", F.lit("turn")), F.col("turns")))
        .withColumn("part", F.explode(every)).select(*cols))
    return edges.unionAll(_edges(first)).unionAll(_edges(_links(meet, ["grp", "part", "turn"], make)))


# ------------------------------------------------------------------ the operator
def near_duplicates(df: DataFrame, conf: MinHash | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: (id, k1, k2, n_shingles, fid, root, component_id).
    ``fid`` names the set (null for empty sets), ``root`` the component, ``component_id`` the least id in it; (k1, k2) is the row's key."""
    conf = conf or MinHash()
    checkpoint_dir(df.sparkSession)
    k1, k2 = doc_key(df, id_col, text_col)
    mine = df.select(F.col(f"`{id_col}`").alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{text_col}`").alias("text"))
    docs = _table(mine.withColumn("p", prints(F.col("text"), conf)).select(
        "id", "k1", "k2", "p.n", "p.fid", "p.keys", "p.sig"), "minhash-prints")

    # distinct sets; of each, one row whose text stands for it
    sets = docs.where("n > 0").groupBy("fid").agg(
        F.min("id").alias("low"), F.max("n").alias("n"), F.min(F.struct("k1", "k2")).alias("rep"),
        F.first("keys").alias("keys"), F.first("sig").alias("sig")).withColumn("sid", F.monotonically_increasing_id())
    sets = _table(sets, "minhash-set-ids")
    keyed = sets.select("sid", F.explode("keys").alias("grp"))      # the band is part of the hash
    buckets = keyed.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select(
        "grp", F.ceil(F.col("c") / conf.part_rows).cast("int").alias("parts"))
    least, percent = conf.least_matches, conf.percent
    members = _table(keyed.join(buckets, "grp").join(sets.select("sid", F.col("sig").alias("payload")), "sid"), "minhash-members")
    groups = components(spanning(members, lambda p: near_signatures(p, least)))

    # full sets of what has a candidate
    sought = groups.select(F.col("node").alias("sid"), F.col("root").alias("grp")).join(
        sets.select("sid", "n", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")), "sid")
    sizes = sought.groupBy("grp").agg(F.ceil(F.greatest(
        F.count("*") / conf.part_rows, F.sum("n") * 8 / conf.part_bytes)).cast("int").alias("parts"))
    sought = sought.join(sizes, "grp").select("k1", "k2", "sid", "grp", "parts").checkpoint()
    texts = mine.select("k1", "k2", "text").join(sought, ["k1", "k2"])
    texts = texts.dropDuplicates(["k1", "k2"])                      # of repeated rows, one
    full = _table(texts.select("grp", "sid", "parts", full_set(F.col("text"), conf).alias("payload")), "minhash-full")
    linked = components(spanning(full, lambda p: near_sets(p, percent)))

    rooted = sets.select("sid", "fid", "low").join(linked.withColumnRenamed("node", "sid"), "sid", "left").select(
        "fid", "low", F.coalesce("root", "sid").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fid", "root", "component_id").checkpoint()
    got = docs.drop("keys", "sig").join(named, "fid", "left")
    own = F.col("n") == 0
    return got.select("id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(~own, F.col("fid")).alias("fid"),
                      "root", F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
