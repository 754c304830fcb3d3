"""Cell search as a join, exact by bounds.

Every cell of an index knows, beside its centroid, the smallest cosine between
the centroid and its vectors (its angular radius) and their smallest and largest
norm. By the triangle inequality of angles no vector of the cell can have a
larger inner product with a question than ``upper_bounds`` says, so a cell whose
bound lies below the question's current k-th score is skipped and the result is
still exact.

Plan shape, for question tables of any size:

1. Questions are mapped to the cells they ask: (question, cell) rows. Only the
   table of cells is broadcast, in blocks of checked bytes; the questions stay
   in Spark and the driver never holds one.
2. These rows meet the cell's vectors by a co-grouped Arrow step. A cell with many
   vectors is cut into parts and a cell with many questions into blocks, both by a
   hash, so one group holds ``GROUP_BYTES`` of vectors and of questions at most,
   however hot the cell is. A question is shuffled once per part and a vector once per
   block, so parts and blocks are as large as that allows; inside a group
   ``part_rows`` vectors and ``block_questions`` questions are scored at a time.
   Cells that nobody asks are not read.
3. A group returns its top-k per question, so at most k rows per question and part
   are what the final window ranks, and in the second search only those that reach
   the question's k-th score so far.
4. Exact search does this twice: in the ``nprobe`` nearest cells, which gives each
   question its k-th score so far, then in all other cells whose bound reaches it.

Ranking is that of ``search.knn``: score (rounded to 12 decimals) descending, then
the corpus keys. Null and non-finite vectors are left out on both sides.
"""
from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, l2_norm
from ..session import checkpoint_dir
from .search import DEFAULT_BROADCAST_LIMIT, RANK_DECIMALS, TILE_BYTES, _tile_top, _vectors

PART_ROWS = 8192
BLOCK_QUESTIONS = 4096
GROUP_BYTES = 16 * 1024 * 1024      # of vectors, and of questions, as doubles
SLACK = 1e-9            # rounding of bounds, relative to the norms


def cell_bounds(index: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``cell, centroid, n, low_cos, low_norm, high_norm`` of every cell that
    holds vectors: one pass over (cell, vector), partial and final aggregate."""
    c = centroids.select("cell", F.col("centroid").cast("array<double>").alias("centroid"))
    v = F.col(vec_col)
    rows = index.select("cell", vec_col).join(c, "cell").select("cell", "centroid", l2_norm(v).alias("n"), dot(v, F.col("centroid")).alias("d"))
    cos = F.when(F.col("n") > 0, F.try_divide(F.col("d"), F.col("n") * l2_norm("centroid")))
    agg = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min(cos).alias("low_cos"), F.min("n").alias("low_norm"), F.max("n").alias("high_norm"))
    return agg.join(c, "cell").select("cell", "centroid", "n", F.coalesce("low_cos", F.lit(-1.0)).alias("low_cos"), "low_norm", "high_norm")


def upper_bounds(Q: np.ndarray, M: np.ndarray, low_cos: np.ndarray, low_norm: np.ndarray, high_norm: np.ndarray) -> np.ndarray:
    """(question, cell): no inner product with a vector of the cell is larger."""
    q, m = np.linalg.norm(Q, axis=1)[:, None], np.linalg.norm(M, axis=1)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.clip((Q @ M.T) / (q * m), -1, 1)
    gap = np.arccos(np.nan_to_num(cos)) - np.arccos(np.clip(low_cos, -1, 1))[None]
    far = np.cos(np.maximum(gap, 0))
    far = np.where(m > 0, far, 1.0)
    best = np.where(far >= 0, high_norm[None] * far, low_norm[None] * far)
    return q * (best + SLACK * high_norm[None])


def _blocks(bounds: DataFrame, limit: int) -> Iterator[dict]:
    """The cells in blocks of at most ``limit`` bytes of centroids, one in the
    driver at a time."""
    r = bounds.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("w")).first()
    blocks = max(1, math.ceil(r["n"] * (r["w"] or 0) * 8 / limit))
    for b in range(blocks):
        t = (bounds if blocks == 1 else bounds.where(F.pmod(F.xxhash64("cell"), F.lit(blocks)) == b)).orderBy("cell").toArrow()
        if t.num_rows:
            at, M = _vectors(t.column("centroid"), None)
            col = lambda c: t.column(c).to_numpy()[at]  # noqa: E731, B023
            yield {"M": M, "cell": col("cell").astype(np.int32), "low_cos": col("low_cos"), "low_norm": col("low_norm"), "high_norm": col("high_norm")}


def _asked(bc, nprobe: int | None, names: list[str]):
    """Rows (question, cell): its ``nprobe`` best cells of the block with their
    centroid score, or (None) all cells not seen whose bound reaches ``kth``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bc.value
        for rb in batches:
            at, Q = _vectors(rb.column(rb.schema.get_field_index("v")), b["M"].shape[1])
            step = max(1, TILE_BYTES // (8 * len(b["cell"])))
            for a in range(0, len(at), step):
                q, rows = Q[a:a + step], rb.take(pa.array(at[a:a + step]))
                if nprobe is not None:
                    near = np.round(b["M"] @ q.T, RANK_DECIMALS)
                    c, r = _tile_top(near, nprobe)
                    score = near[c, r]
                else:
                    bound = upper_bounds(q, b["M"], b["low_cos"], b["low_norm"], b["high_norm"])
                    kth = rows.column(rows.schema.get_field_index("kth")).to_numpy(zero_copy_only=False)
                    reach = bound >= kth[:, None]
                    for i, seen in enumerate(rows.column(rows.schema.get_field_index("seen")).to_pylist()):
                        reach[i, np.isin(b["cell"], seen)] = False
                    r, c = np.nonzero(reach)
                    score = bound[r, c]
                found = {"cell": pa.array(b["cell"][c]), "near": pa.array(score)}
                rows = rows.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([found[n] if n in found else rows.column(rows.schema.get_field_index(n)) for n in names], names)
    return run


def _cells_of(asks: DataFrame, bounds: DataFrame, nprobe: int | None, limit: int) -> DataFrame:
    """(q, v, k, kth, cell) for the cells that each question asks."""
    out = T.StructType([asks.schema["q"], asks.schema["v"], asks.schema["k"], asks.schema["kth"], T.StructField("cell", T.IntegerType()),
                        T.StructField("near", T.DoubleType())])
    got, blocks = None, 0
    for block in _blocks(bounds, limit):
        bc = asks.sparkSession.sparkContext.broadcast(block)
        part = asks.mapInArrow(_asked(bc, nprobe, out.names), out)
        got, blocks = part if got is None else got.unionAll(part), blocks + 1
    if got is None:
        return asks.sparkSession.createDataFrame([], out)
    if nprobe is not None and blocks > 1:
        w = Window.partitionBy("q").orderBy(F.desc("near"), "cell")
        got = got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= nprobe).drop("n")
    return got


def _best(C: np.ndarray, Q: np.ndarray, low: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, ...]:
    """(row, question, score, rounded score) of the top-k of ``C`` per question, of
    equal scores the first rows, without those below the question's ``low``;
    ``rows`` vectors are scored at a time."""
    low = low.copy()
    row, who, score, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for a in range(0, len(C), rows):
        S = C[a:a + rows] @ Q.T
        with np.errstate(invalid="ignore"):
            found = S >= low - (np.abs(low) + 10) * 10.0 ** -RANK_DECIMALS if np.isfinite(low).any() else np.ones(S.shape, bool)
        if np.count_nonzero(found) > 4 * k * len(Q):
            r, c = _tile_top(np.round(S, RANK_DECIMALS), k)
        else:
            r, c = np.nonzero(found)
        s = S[r, c]
        ranked = np.round(s, RANK_DECIMALS)
        ok = ranked >= low[c]
        if not ok.any():
            continue
        row, who, score, key = (np.concatenate(x) for x in ((row, a + r[ok]), (who, c[ok]), (score, s[ok]), (key, ranked[ok])))
        order = np.lexsort((row, -key, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order = order[place < k]
        row, who, score, key = row[order], who[order], score[order], key[order]
        full = place[place < k] == k - 1
        low[who[full]] = np.maximum(low[who[full]], key[full])
    return row, who, score, key


def _scorer(keys: list[str], vec_col: str, part_rows: int, block_questions: int, out: pa.Schema):
    """Top-k of a group's vectors for each of its questions."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        right = right.take(pc.sort_indices(right, sort_keys=[(c, "ascending") for c in keys]))
        at, C = _vectors(right.column(vec_col), None)
        right = right.select(keys)
        _, Q = _vectors(left.column("v"), C.shape[1] if len(at) else None)
        left = left.drop_columns(["v"])
        kmax = int(pc.max(left.column("k")).as_py())
        low = left.column("kth").to_numpy()
        parts = []
        rows = max(1, min(part_rows, TILE_BYTES // 8))
        step = max(1, min(block_questions, TILE_BYTES // (8 * rows)))
        for a in range(0, len(Q) if len(at) else 0, step):
            r, c, score, key = _best(C, Q[a:a + step], low[a:a + step], kmax, rows)
            mine = right.take(pa.array(at[r]))
            who = left.take(pa.array(a + c))
            cols = {"query_id": who.column("q"), "__k": who.column("k"), "score": pa.array(score), "score_key": pa.array(key)}
            parts.append(pa.table([cols[f.name] if f.name in cols else mine.column(f.name) for f in out], schema=out))
        return pa.concat_tables(parts) if parts else out.empty_table()
    return run


def score_cells(pairs: DataFrame, index: DataFrame, bounds: DataFrame, corpus_keys: Sequence[str], vec_col: str,
                part_rows: int = PART_ROWS, block_questions: int = BLOCK_QUESTIONS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Partial top-k rows ``query_id, __k, <keys>, score, score_key`` of the
    (question, cell) rows ``pairs`` (q, v, k, kth, cell), without those whose
    rounded score is below ``kth``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    keys = list(corpus_keys)
    out = T.StructType([T.StructField("query_id", pairs.schema["q"].dataType), T.StructField("__k", T.LongType())]
                       + [T.StructField(c, index.schema[c].dataType) for c in keys]
                       + [T.StructField("score", T.DoubleType()), T.StructField("score_key", T.DoubleType())])
    fits = F.floor(F.lit(group_bytes) / (8 * F.size("centroid")))
    cut = lambda n, least: F.ceil(F.col(n) / F.greatest(fits, F.lit(least))).cast("int")
    many = pairs.groupBy("cell").agg(F.count("*").alias("asked"))
    sizes = many.join(bounds.select("cell", "n", "centroid"), "cell").select(
        "cell", cut("asked", block_questions).alias("blocks"), cut("n", part_rows).alias("parts"))
    group = ["cell", "part", "block"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = pairs.select("q", "v", "k", "kth", "cell").join(sizes, "cell").withColumn(
        "block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).withColumn("part", every("parts")).drop("parts", "blocks")
    right = index.select("cell", *keys, vec_col).join(sizes, "cell").withColumn(
        "part", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int")).withColumn("block", every("blocks")).drop("parts", "blocks")
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        _scorer(keys, vec_col, part_rows, block_questions, to_arrow_schema(out)), out)


def _top(scored: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score_key"), *[F.asc(c) for c in keys])
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("__k"))


def knn_by_cells(questions: DataFrame, index: DataFrame, bounds: DataFrame, k: int = 5, *, query_key: str = "query_id",
                 query_vec: str = "embedding", corpus_keys: Sequence[str] = ("doc_id", "chunk_index"), corpus_vec: str = "embedding",
                 per_query_k: str | None = None, nprobe: int = 1, exact: bool = True, part_rows: int = PART_ROWS,
                 block_questions: int = BLOCK_QUESTIONS, broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT,
                 group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(hits, work)``: the hits as ``search.knn`` gives them (``query_id,
    rank, <corpus_keys>, score``) and, per question, the cells and rows that
    were scored for it (``query_id, cells, rows``).

    ``index`` has a ``cell`` column, ``bounds`` is its ``cell_bounds``. With
    ``exact`` the result equals that of a search of all rows; without, only the
    ``nprobe`` nearest cells are searched. ``query_key`` must be unique."""
    if k <= 0 or nprobe <= 0:
        raise ValueError("k and nprobe must be positive")
    checkpoint_dir(index.sparkSession)
    keys = list(corpus_keys)
    want = F.coalesce(F.col(per_query_k), F.lit(k)) if per_query_k else F.lit(k)
    vec = F.col(query_vec)
    if not isinstance(questions.schema[query_vec].dataType.elementType, T.FloatType):       # a float is half the bytes of a double
        vec = vec.cast("array<double>")
    asks = questions.where(F.col(query_vec).isNotNull()).select(
        F.col(query_key).alias("q"), vec.alias("v"), want.cast("long").alias("k"), F.lit(float("-inf")).alias("kth")).checkpoint()
    bounds = bounds.checkpoint()
    pairs = _cells_of(asks, bounds, nprobe, broadcast_limit_bytes).checkpoint()
    score = lambda p: score_cells(p, index, bounds, keys, corpus_vec, part_rows, block_questions, group_bytes)
    hits = _top(score(pairs), keys).checkpoint()
    if exact:
        got = hits.groupBy("query_id").agg(F.min("score_key").alias("low"), F.count("*").alias("n"))
        seen = pairs.groupBy("q").agg(F.collect_list("cell").alias("seen"))         # nprobe cells
        more = asks.drop("kth").join(seen, "q").join(got.withColumnRenamed("query_id", "q"), "q", "left").withColumn(
            "kth", F.when(F.col("n") >= F.col("k"), F.col("low")).otherwise(float("-inf")))
        rest = _cells_of(more.select("q", "v", "k", "kth", "seen"), bounds, None, broadcast_limit_bytes).checkpoint()
        cols = ["query_id", "__k", *keys, "score", "score_key"]
        hits = _top(hits.select(*cols).unionAll(score(rest).select(*cols)), keys).checkpoint()
        pairs = pairs.unionAll(rest)
    work = pairs.join(bounds.select("cell", "n"), "cell").groupBy(F.col("q").alias("query_id")).agg(
        F.count("*").alias("cells"), F.sum("n").alias("rows"))
    return hits.select("query_id", "rank", *keys, "score"), work
