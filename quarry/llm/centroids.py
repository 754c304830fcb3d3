"""Centroid clustering (k-means) with ns-bounds.

Every vector keeps, per centroid, a lower bound on its distance, and an upper
bound on the distance to its own, each with the round in which it was last
measured. The centroids of past rounds are kept, so a bound measured in round T
is loosened by the norm of the centroid's total displacement since T,
|c(now) - c(T)|, which is at most, and usually well below, the sum of the
drifts of the rounds between (norm of the sum, not sum of the norms). Only
pairs whose loosened bounds fail are measured again, exactly.

Vectors are whole numbers, floor(scale * x); distances are squared Euclidean in
exact integer arithmetic, ties go to the smaller centroid, new centroids are
componentwise floor(sum / count). Bounds are kept with a margin for rounding,
so the result equals that of measuring everything.

Scale: a round is one pass over a table of vectors and bounds (map only, a part
of the table at a time) that writes the next one to the shared folder; the one
before is deleted. Centroid sums follow the vectors that moved: whole-number
sums per (centroid, component), summed in the tasks first. The driver holds
``k`` centroids per remembered round, k * d * (history + 1) numbers, which
``MAX_CENTROID_BYTES`` bounds; bounds older than ``history`` rounds are rebased
to the current one before their centroids are forgotten. No group of vectors is
ever brought together, so equal vectors and huge clusters are no hot spots.

Defined results: only vectors of exactly ``dim`` components, none null, NaN or
infinite, are kept; other rows are left out. Components beyond ``limit(dim)``
(2^27 for 64) after scaling are taken as that value, so that squared distances
fit a long. Rows with a null id or equal ids are clustered like any other; a
null id counts as an empty string where ids are hashed. Fewer usable vectors
than ``k`` give as many clusters as vectors, none gives an empty result. Sums
beyond a long are null. Extra columns are not read.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, remove_path, scratch_path

MAX_CENTROID_BYTES = 256 << 20
_STEP = 4096                       # vectors measured at a time
_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


@dataclass(frozen=True)
class Clustering:
    k: int = 40
    dim: int = 64
    rounds: int = 5
    scale: int = 256
    history: int = 16
    seed: str = "2"


def limit(dim: int) -> int:
    """Largest component whose squared distances surely fit a long."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def usable(vec: Column, dim: int) -> Column:
    """Exactly ``dim`` components, all of them finite numbers."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vec) == dim) & ~odd, F.lit(False))


def whole(vec: Column, conf: Clustering) -> Column:
    most = float(limit(conf.dim))
    return F.transform(vec, lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * F.lit(float(conf.scale)), F.lit(most)), F.lit(-most))).cast("int"))


# ------------------------------------------------------------------ one part of the table
def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to the same row of ``c``."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def _to_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:            # sums of products stay exact in doubles
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        out[:, j] = squared(x, c[j])
    return out


def _above(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), _UP)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), _DOWN), np.float32(0))


def displacements(past: list[np.ndarray]) -> np.ndarray:
    """(round, centroid) -> norm of the way from its place then to its place
    now (the last of ``past``), rounded up."""
    return np.stack([_above(squared(p, past[-1])) for p in past]).astype(np.float32)


@dataclass
class State:
    """Bounds of some vectors: own cluster, its upper bound and that bound's
    round, lower bounds per centroid and their rounds."""
    own: np.ndarray
    up: np.ndarray
    up_at: np.ndarray
    low: np.ndarray
    low_at: np.ndarray


def first_state(x: np.ndarray, c: np.ndarray) -> State:
    d2 = _to_all(x, c)
    own = d2.argmin(1)
    best = d2[np.arange(len(x)), own]
    zero = np.zeros(d2.shape, np.uint8)
    return State(own, _above(best), zero[:, 0].copy(), _below(d2), zero)


def next_state(x: np.ndarray, s: State, past: list[np.ndarray], way: np.ndarray) -> tuple[State, int]:
    """The state under the centroids ``past[-1]``, and how many distances were
    measured. Rounds in the state index ``past``."""
    now, c = len(past) - 1, past[-1]
    rows, cols = np.arange(len(x)), np.arange(c.shape[0])
    # one more rounding step each way keeps sums of rounded numbers safe
    up = np.nextafter(s.up + way[s.up_at, s.own], _UP)
    low = np.nextafter(s.low - way[s.low_at, cols], _DOWN)
    low[rows, s.own] = _UP
    own, up0, up_at, low0, low_at = s.own.copy(), s.up.copy(), s.up_at.copy(), s.low.copy(), s.low_at.copy()
    fails = np.flatnonzero((low <= up[:, None]).any(1))
    measured = len(fails)
    if len(fails):
        best = squared(x[fails], c[own[fails]])
        up0[fails], up_at[fails] = _above(best), now
        i, j = np.nonzero(low[fails] <= up0[fails][:, None])
        measured += len(i)
        if len(i):
            at = fails[i]
            d2 = squared(x[at], c[j])
            old = own[fails]
            old_d2 = best.copy()
            # least (distance, centroid) among its own and the measured ones
            order = np.lexsort((j, d2, i))
            lead = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
            better = (d2[lead] < best[i[lead]]) | ((d2[lead] == best[i[lead]]) & (j[lead] < own[fails][i[lead]]))
            low0[at, j], low_at[at, j] = _below(d2), now
            to = lead[better]
            moved = fails[i[to]]
            own[moved], up0[moved] = j[to], _above(d2[to])
            left = i[to]
            low0[moved, old[left]], low_at[moved, old[left]] = _below(old_d2[left]), now
    return State(own, up0, up_at, low0, low_at), measured


def rebased(s: State, way: np.ndarray) -> State:
    """The same bounds with only the current round's centroids remembered."""
    rows = np.arange(len(s.own))
    up = np.nextafter(s.up + way[s.up_at, s.own], _UP)
    low = np.maximum(np.nextafter(s.low - way[s.low_at, np.arange(s.low.shape[1])], _DOWN), np.float32(0))
    low[rows, s.own] = np.minimum(low[rows, s.own], up)
    return State(s.own, up, np.zeros_like(s.up_at), low, np.zeros_like(s.low_at))


# ------------------------------------------------------------------ the rounds on Spark
_STATE = "vec_id {id}, x array<int>, own int, was int, up float, up_at tinyint, low array<float>, low_at array<tinyint>, checked bigint"


def _matrix(col: pa.Array, kind) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(col), -1)


def _lists(m: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(m).ravel()))


def _round(past: list[np.ndarray], rebase: bool):
    """mapInArrow function of one assignment round."""
    def run(batches):
        way = displacements(past)
        for b in batches:
            for a in range(0, b.num_rows, _STEP):
                part = b.slice(a, _STEP)
                x = _matrix(part["x"], np.int32)
                if "own" not in part.schema.names:
                    was = np.full(len(x), -1)
                    s, measured = first_state(x, past[-1]), x.shape[0] * past[-1].shape[0]
                else:
                    was = part["own"].to_numpy(zero_copy_only=False)
                    s = State(was.astype(np.int64), part["up"].to_numpy(zero_copy_only=False),
                              part["up_at"].to_numpy(zero_copy_only=False), _matrix(part["low"], np.float32),
                              _matrix(part["low_at"], np.int8))
                    s, measured = next_state(x, s, past, way)
                if rebase:
                    s = rebased(s, way)
                checked = np.zeros(len(x), np.int64)
                checked[0] = measured
                yield pa.RecordBatch.from_arrays([
                    part["vec_id"], part["x"], pa.array(s.own.astype(np.int32)), pa.array(was.astype(np.int32)),
                    pa.array(s.up), pa.array(s.up_at.astype(np.int8)), _lists(s.low), _lists(s.low_at.astype(np.int8)),
                    pa.array(checked)], ["vec_id", "x", "own", "was", "up", "up_at", "low", "low_at", "checked"])

    return run


def _moves(k: int, dim: int):
    """mapInArrow function: per batch, what the moved vectors add to and take
    from each centroid's sums (component ``dim`` is the count)."""
    def run(batches):
        for b in batches:
            x = _matrix(b["x"], np.int64)
            own, was = (b[c].to_numpy(zero_copy_only=False) for c in ("own", "was"))
            sums, x = np.zeros((k, dim + 1), np.int64), np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
            np.add.at(sums, own, x)
            np.subtract.at(sums, was[was >= 0], x[was >= 0])
            i, j = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(sums[i, j])], ["c", "j", "s"])

    return run


def seeds(vectors: DataFrame, conf: Clustering) -> np.ndarray:
    """The first centroids: the k vectors (vec_id, x) of smallest hash."""
    text = F.concat(F.lit(conf.seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select("x", F.sha2(text, 256).alias("h")).orderBy("h", "x").limit(conf.k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), conf.dim)


def cluster(df: DataFrame, conf: Clustering | None = None, id_col: str = "vec_id",
            vec_col: str = "embedding") -> tuple[DataFrame, list[dict]]:
    """(vec_id, cluster, distance, centroid) per usable vector, and per round
    its centroids moved, vectors moved and distances measured."""
    conf = conf or Clustering()
    if not 1 <= conf.history <= 127:
        raise ValueError("history is 1 to 127 rounds")
    if conf.k * conf.dim * 8 * (conf.history + 1) > MAX_CENTROID_BYTES:
        raise ValueError("k * dim * (history + 1) centroids exceed MAX_CENTROID_BYTES; lower history or k")
    spark = df.sparkSession
    checkpoint_dir(spark)
    vec = F.col(f"`{vec_col}`")
    kind = df.schema[id_col].dataType.simpleString()
    path = scratch_path(spark, "centroids-0")
    df.where(usable(vec, conf.dim)).select(F.col(f"`{id_col}`").alias("vec_id"), whole(vec, conf).alias("x")).write.parquet(path)
    table = spark.read.schema(f"vec_id {kind}, x array<int>").parquet(path)
    first = seeds(table, conf)
    k = len(first)
    done = spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, centroid string")
    if not k:
        remove_path(spark, path)
        return done, []
    past, sums, log = [first], np.zeros((k, conf.dim + 1), object), []
    state = _STATE.format(id=kind)
    for r in range(conf.rounds + 1):
        rebase = len(past) > conf.history
        was, path = path, scratch_path(spark, f"centroids-{r + 1}")
        table.mapInArrow(_round(list(past), rebase), state).write.parquet(path)
        remove_path(spark, was)
        table = spark.read.schema(state).parquet(path)
        seen = table.agg(F.sum(F.when(F.col("own") != F.col("was"), 1)), F.sum("checked")).first()
        moved, measured = int(seen[0] or 0), int(seen[1] or 0)
        log.append({"round": r, "moved": moved, "measured": measured})
        if r == conf.rounds or (r and not moved):       # without a move the centroids stay as they are
            break
        delta = table.where("own <> was").select("x", "own", "was").mapInArrow(_moves(k, conf.dim), "c int, j int, s bigint")
        for x in delta.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():   # k * (d + 1) rows at most
            sums[x.c, x.j] += int(x.s)
        now = past[-1].copy()
        for j in range(k):
            if n := sums[j, conf.dim]:
                now[j] = [int(v) // int(n) for v in sums[j, :conf.dim]]
        past = [past[-1], now] if rebase else [*past, now]
    last = past[-1]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in last]

    def result(batches):
        for b in batches:
            own = b["own"].to_numpy(zero_copy_only=False)
            d2 = squared(_matrix(b["x"], np.int32), last[own])
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["own"], pa.array(d2), pa.array([names[c] for c in own], pa.string())],
                                             ["vec_id", "cluster", "distance", "centroid"])

    return table.select("vec_id", "x", "own").mapInArrow(result, done.schema), log


def with_inertia(clustered: DataFrame) -> DataFrame:
    """Adds ``cluster_inertia`` and ``inertia``, sums of ``distance``; a row
    per cluster goes through the driver."""
    per = clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    fits = lambda v: v if v < 1 << 63 else None
    total = sum(int(r.d) for r in per)
    named = clustered.sparkSession.createDataFrame(
        [(r.cluster, fits(int(r.d)), fits(total)) for r in per], "cluster int, cluster_inertia bigint, inertia bigint")
    return clustered.join(F.broadcast(named), "cluster")
