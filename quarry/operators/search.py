"""Vector search: exact and cell-pruned top-k (J1, J4, J5, T1-T3, W1, PF6).

Plan shape (no cross join, corpus never shuffled):

1. The question vectors go to every executor as a broadcast variable, in
   blocks whose bytes and candidate rows are bounded (a block nested-loop
   join of a stated question set against all rows). With more than one block
   the corpus is staged once as Parquet, so later blocks read vectors and
   payload instead of running the corpus plan again.
2. The corpus is scanned once per block (only key, vector and payload columns
   are read). Arrow batches are taken in slices of ``SLICE_BYTES`` of vectors and
   scored by NumPy matrix products in tiles of bounded bytes; of every tile only
   the top-k per question survives, cut under the full order, so ties (copies,
   zero vectors) never pile up, and only what reaches the question's k-th score so
   far. Payload is taken for survivors only, and at most ``k x partitions`` rows
   per question reach the shuffle.
3. The final top-k is a ``row_number`` window per question, which Catalyst
   plans as ``WindowGroupLimit`` (partial + final).

Ranking order is score descending, then the corpus key ascending; scores are
compared after rounding to 12 decimals so that bit-level differences between
BLAS kernels never decide a tie between identical vectors.

Vectors that are null or hold a non-finite number are left out before ranking
(``unusable_vectors`` counts them). A vector of another width than the
questions' is an error, on either side.
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

from ..session import checkpoint_dir, remove_path, scratch_path

RANK_DECIMALS = 12
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
TILE_BYTES = 16 * 1024 * 1024
#: vectors of an Arrow batch that a scorer turns into doubles at a time
SLICE_BYTES = 2 * 1024 * 1024
#: candidate rows (questions x k) that a task may hold with their payload
MAX_CANDIDATES = 32768


def _vectors(col: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """List<float> Arrow column -> (row numbers of the usable vectors, dense
    float64 matrix). Raises if a vector's width is not ``dim``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    there = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    lengths = pc.list_value_length(col).drop_null().to_numpy(zero_copy_only=False)
    if not len(there):
        return there, np.zeros((0, dim or 0))
    width = dim or int(lengths[0])
    if (lengths != width).any():
        raise ValueError(f"vector width {int(lengths[lengths != width][0])} where {width} was expected")
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), width)
    ok = np.isfinite(flat).all(axis=1)
    return there[ok], flat[ok]


def unusable_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row ``n_null, n_not_finite``: the vectors that search leaves out."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return df.agg(F.count_if(F.col(vec_col).isNull()).alias("n_null"), F.count_if(bad).alias("n_not_finite"))


def _tile_top(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the top-k of every column; of equal scores the rows
    that come first."""
    n = keys.shape[0]
    if n <= k:
        r, c = np.indices(keys.shape)
        return r.ravel(), c.ravel()
    cut = np.partition(keys, n - k, axis=0)[n - k]
    above = keys > cut
    tied = keys == cut
    tied &= np.cumsum(tied, axis=0) <= k - above.sum(axis=0)
    return np.nonzero(above | tied)


class _Best:
    """Running top-k per question; a batch's survivors carry their payload."""

    def __init__(self, key_cols: list[str], kmax: int, n: int):
        self.key_cols, self.k = key_cols, kmax
        self.low = np.full(n, -np.inf)      # the k-th score of each question that has k rows
        self.rows: pa.Table | None = None
        self.q = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.key = np.zeros(0)

    def add(self, rows: pa.Table, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        table = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        q, score, key = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.key, key)))
        by = pa.table({"q": q, "s": -key, **{f"k{i}": table.column(c) for i, c in enumerate(self.key_cols)}})
        order = pc.sort_indices(by, sort_keys=[("q", "ascending"), ("s", "ascending")] + [
            (f"k{i}", "ascending") for i in range(len(self.key_cols))]).to_numpy()
        qs = q[order]
        first = np.r_[True, qs[1:] != qs[:-1]] if len(qs) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0)) if len(qs) else qs
        place = np.arange(len(qs)) - start
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.low[q[full]] = key[full]
        self.rows = table.take(pa.array(keep)).combine_chunks()
        self.q, self.score, self.key = q[keep], score[keep], key[keep]


def _probed(Q: np.ndarray, centroids: np.ndarray, cells: np.ndarray, nprobe: int) -> dict[int, np.ndarray]:
    """cell -> positions of the questions that probe it: every question's
    ``nprobe`` best centroids, lowest cell on ties."""
    found: dict[int, list] = {}
    step = max(1, TILE_BYTES // (8 * max(1, len(cells))))
    for a in range(0, len(Q), step):
        keys = np.round(centroids @ Q[a:a + step].T, RANK_DECIMALS)
        r, c = _tile_top(keys, nprobe)
        for cell, q in zip(cells[r].tolist(), (c + a).tolist()):
            found.setdefault(cell, []).append(q)
    return {c: np.array(v) for c, v in found.items()}


def _scorer(bc, key_cols: Sequence[str], vec_col: str, payload: Sequence[str],
            kmax: int, cell_col: str | None, out_schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type
    key_cols = list(key_cols)
    carry = list(dict.fromkeys(key_cols + list(payload)))
    arrow_types = {f.name: to_arrow_type(f.dataType) for f in out_schema.fields}
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bc.value
        Q, qids, asked = b["Q"], b["qids"], b["k"]
        probed = _probed(Q, *b["cells"]) if cell_col else None
        best = _Best(key_cols, kmax, len(qids))

        def score(rb: pa.RecordBatch) -> None:
            at, C = _vectors(rb.column(rb.schema.get_field_index(vec_col)), Q.shape[1])
            if not len(at):
                return
            small = pa.Table.from_batches([rb]).select(carry)
            order = pc.sort_indices(small.select(list(dict.fromkeys(key_cols))).take(pa.array(at)),
                                    sort_keys=[(c, "ascending") for c in dict.fromkeys(key_cols)]).to_numpy()
            groups = [(order, np.arange(len(qids)))]
            if cell_col:
                cell = rb.column(rb.schema.get_field_index(cell_col)).to_numpy(zero_copy_only=False)[at][order]
                groups = [(order[cell == c], probed[c]) for c in np.unique(cell).tolist() if c in probed]
            for rows, qpos in groups:
                step = max(kmax, TILE_BYTES // (8 * max(1, len(qpos))), 1)
                wide = max(1, TILE_BYTES // (8 * step))
                for a in range(0, len(rows), step):
                    part = rows[a:a + step]
                    for q0 in range(0, len(qpos), wide):
                        qs = qpos[q0:q0 + wide]
                        S = C[part] @ Q[qs].T
                        keys = np.round(S, RANK_DECIMALS)
                        r, c = _tile_top(keys, kmax)
                        reach = keys[r, c] >= best.low[qs[c]]
                        r, c = r[reach], c[reach]
                        if len(r):
                            best.add(small.take(pa.array(at[part[r]])), qs[c], S[r, c], keys[r, c])

        for rb in batches:
            rows = max(1, SLICE_BYTES // (8 * max(1, Q.shape[1])))
            for a in range(0, rb.num_rows, rows):
                score(rb.slice(a, rows))
            rb = None                       # the next batch is read without this one
        if best.rows is None:
            return
        cols = {"query_id": qids.take(pa.array(best.q)), "score": pa.array(best.score), "score_key": pa.array(best.key),
                "__k": pa.array(asked[best.q])}
        for c in carry:
            cols[c] = best.rows.column(c).combine_chunks()
        yield pa.RecordBatch.from_arrays([cols[n].cast(arrow_types[n]) for n in names], names=names)
    return run


def _measure(queries: DataFrame, query_vec: str, per_query_k: str | None, k: int) -> tuple[int, int, int]:
    """(questions, vector width, largest k) by one aggregate."""
    size = F.size(query_vec)
    kq = F.coalesce(F.col(per_query_k), F.lit(k)) if per_query_k else F.lit(k)
    r = queries.where(F.col(query_vec).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.max(kq).alias("k")).first()
    if r["n"] and r["lo"] != r["hi"]:
        raise ValueError(f"question vectors of different widths: {r['lo']} and {r['hi']}")
    return int(r["n"]), int(r["hi"] or 0), int(r["k"] or k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, *,
        query_key: str = "query_id", query_vec: str = "embedding",
        corpus_keys: Sequence[str] = ("doc_id", "chunk_index"),
        corpus_vec: str = "embedding", payload: Sequence[str] = (),
        per_query_k: str | None = None,
        cell_col: str | None = None, centroids: DataFrame | None = None, nprobe: int = 10,
        broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT,
        max_candidates: int = MAX_CANDIDATES,
        materialize: bool = True) -> DataFrame:
    """Top-k corpus rows per question by inner product.

    Returns ``query_id, rank, <corpus_keys>, score, <payload>`` (``query_id``
    is renamed from ``query_key``, which must be unique). With ``per_query_k``
    each question keeps its own k (T3), of any size. With ``cell_col`` and a
    ``centroids`` table (``cell, centroid``) each question is scored only
    against its ``nprobe`` best cells (J4), and only the cells that some
    question probes are read.

    The hits (at most ``k`` per question) are checkpointed to the shared
    checkpoint folder, so every downstream consumer (context, sources,
    evaluators) reuses one scan of the corpus and the lineage is cut.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    n, dim, kmax = _measure(queries, query_vec, per_query_k, k)
    fields = {c: corpus.schema[c] for c in dict.fromkeys([*corpus_keys, *payload])}
    out_schema = T.StructType(
        [T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("score", T.DoubleType()),
         T.StructField("score_key", T.DoubleType()), T.StructField("__k", T.LongType())]
        + [T.StructField(c, f.dataType) for c, f in fields.items()])
    cols = list(dict.fromkeys([*corpus_keys, corpus_vec, *payload] + ([cell_col] if cell_col else [])))
    final = ["query_id", "rank", *corpus_keys, "score", *[c for c in payload if c not in corpus_keys]]
    if n == 0:
        return spark.createDataFrame([], out_schema).withColumn("rank", F.lit(1)).select(*final)
    if cell_col and _beyond(centroids, broadcast_limit_bytes):
        from .cells import cell_bounds, knn_by_cells
        index = corpus.withColumn("cell", F.col(cell_col))
        hits, _ = knn_by_cells(queries, index, cell_bounds(index, centroids, corpus_vec), k, query_key=query_key, query_vec=query_vec,
                               corpus_keys=corpus_keys, corpus_vec=corpus_vec, per_query_k=per_query_k, nprobe=nprobe, exact=False,
                               broadcast_limit_bytes=broadcast_limit_bytes)
        carried = [c for c in payload if c not in corpus_keys]
        return (hits.join(corpus.select(*corpus_keys, *carried), list(corpus_keys)) if carried else hits).select(*final)
    cells = _cell_table(centroids, nprobe) if cell_col else None
    blocks = max(1, math.ceil(n * (dim * 8 + 32) / broadcast_limit_bytes), math.ceil(n * kmax / max_candidates))
    scan = corpus.select(*cols)
    staged = None
    if blocks > 1:
        staged = scratch_path(spark, "search-corpus")
        scan.write.parquet(staged)
        scan = spark.read.parquet(staged)
    want = F.coalesce(F.col(per_query_k), F.lit(k)) if per_query_k else F.lit(k)
    asks = queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_key).alias("q"), F.col(query_vec).alias("v"), want.cast("long").alias("k"))
    if blocks > 1:
        asks = asks.checkpoint()        # embedded once, then read block by block
    scored, held = None, []
    for b in range(blocks):
        rows = (asks if blocks == 1 else asks.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toArrow()
        at, Q = _vectors(rows.column("v"), dim)
        if not len(at):
            continue
        rows = rows.take(pa.array(at))
        block = {"Q": Q, "qids": rows.column("q").combine_chunks(), "k": rows.column("k").to_numpy()}
        part = scan
        if cells:
            block["cells"] = cells
            part = scan.filter(F.col(cell_col).isin(sorted(_probed(Q, *cells))))     # at most nlist cells
        bc = spark.sparkContext.broadcast(block)
        held.append(bc)
        part = part.mapInArrow(_scorer(bc, corpus_keys, corpus_vec, payload, kmax, cell_col, out_schema), out_schema)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return spark.createDataFrame([], out_schema).withColumn("rank", F.lit(1)).select(*final)
    w = Window.partitionBy("query_id").orderBy(F.desc("score_key"), *[F.asc(c) for c in corpus_keys])
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kmax)
    out = ranked.filter(F.col("rank") <= F.col("__k")).select(*final)
    if materialize:
        checkpoint_dir(spark)
        out = out.checkpoint(eager=True)
        for bc in held:  # the hits are on disk now; free executor memory
            bc.unpersist()
        if staged:
            remove_path(spark, staged)
    return out


def _beyond(centroids: DataFrame | None, limit: int) -> bool:
    """Whether the centroids are too large to be broadcast whole; then the
    join by cell takes them in blocks."""
    if centroids is None:
        raise ValueError("cell search needs a centroid table")
    r = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("w")).first()
    return r["n"] * (r["w"] or 0) * 8 > limit


def _cell_table(centroids: DataFrame, nprobe: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The centroid matrix, its cells, nprobe."""
    t = centroids.select("cell", F.col("centroid").cast("array<double>").alias("centroid")).orderBy("cell").toArrow()
    at, m = _vectors(t.column("centroid"), None)
    return m, t.column("cell").to_numpy()[at], nprobe


def threshold_filter(hits: DataFrame, threshold: float, score_col: str = "score") -> DataFrame:
    """PF6: inclusive similarity threshold."""
    return hits.filter(F.col(score_col) >= F.lit(threshold))
