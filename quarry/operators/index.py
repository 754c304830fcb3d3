"""Vector index: cell training, assignment, probing, persistence, stats
(J2, J3, J4, SRC7, SRC8, A13).

* Training uses ``pyspark.ml`` KMeans with cosine distance on the non-zero
  vectors (zero vectors break cosine KMeans). ``k = min(nlist, n)`` (S12).
* Assignment is a map-only Arrow step: every batch of vectors is scored
  against the centroids and takes the best cell, lowest id on ties (so a zero
  vector goes to the lowest cell). A centroid table beyond the broadcast limit
  is taken in blocks, with the best cell so far carried along.
* Probing happens inside the scorer (``search.knn``): questions and centroids
  are broadcast, the cells that some question probes become a partition filter.
* The index is Parquet partitioned by ``cell``. Every save is a new version
  beside the others; a small manifest row (version, type, width, cells) is
  appended last, and readers take the highest version that has one.
* A version may be a base and deltas (``append_delta``): new rows, and the
  documents whose earlier rows are void. Readers merge them; ``compact`` writes
  the merged rows as a new base. No version ever changes a file of another.
"""
from __future__ import annotations

import math
import uuid
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists, remove_path
from .search import DEFAULT_BROADCAST_LIMIT, RANK_DECIMALS, SLICE_BYTES, TILE_BYTES, _vectors, knn

#: the cell of vectors that search leaves out (null or not finite)
UNUSABLE_CELL = -1
#: ``deltas`` names the folders of rows appended to the base, in order
MANIFEST = "version long, folder string, type string, width int, cells int, deltas array<string>"


#: what a broadcast id or text digest takes, about
KEY_BYTES = 128
#: vectors, as doubles, that one task of a training keeps
TRAIN_BYTES = 32 * 1024 * 1024


def train_cells(vectors: DataFrame, nlist: int = 100, vec_col: str = "embedding",
                seed: int = 42, max_iter: int = 20) -> DataFrame:
    """``cell INT, centroid ARRAY<DOUBLE>`` (unit length). KMeans runs
    distributed (k-means|| start, one aggregation pass per iteration); only
    the ``nlist`` centres come back to the driver. More than ``TRAIN_BYTES`` of
    vectors are dealt out, so that a task's share does not grow with the table
    (a stored vector column is small, and a scan cuts it into few partitions)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import l2_normalize, sum_squares, vector_sum

    spark = vectors.sparkSession
    nz = vectors.select(vec_col).filter(sum_squares(vec_col) > 0)
    r = nz.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("w")).first()
    n = r["n"]
    if n == 0:
        raise ValueError("no non-zero vectors to train on")
    shares = math.ceil(n * r["w"] * 8 / TRAIN_BYTES)
    if shares > 1:
        nz = nz.repartition(max(shares, spark.sparkContext.defaultParallelism))
    k = max(1, min(nlist, n))  # S12
    if k == 1:
        dim = len(nz.first()[0])
        return nz.agg(vector_sum(vec_col, dim).alias("c")).select(
            F.lit(0).alias("cell"), l2_normalize("c").cast("array<double>").alias("centroid"))
    feats = nz.select(array_to_vector(F.col(vec_col)).alias("features"))
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=max_iter,
                   featuresCol="features").fit(feats)
    rows = []
    for i, c in enumerate(model.clusterCenters()):
        c = np.asarray(c, dtype=np.float64)
        nrm = np.linalg.norm(c)
        rows.append((i, (c / nrm if nrm > 0 else c).tolist()))
    return spark.createDataFrame(rows, "cell int, centroid array<double>")


#: vectors that a training looks at, whatever the table's size
SAMPLE_ROWS = 200_000


def sample_vectors(vectors: DataFrame, rows: int, vec_col: str = "embedding") -> DataFrame:
    """About ``rows`` vectors at most, chosen by a hash of the vector and so
    the same in every run; all of them if there are no more. Equal vectors
    stand or fall together, so a third of equal ones cannot crowd a sample."""
    distinct = vectors.select(vec_col).where(F.col(vec_col).isNotNull())
    n = distinct.count()
    if n <= rows:
        return distinct
    h = F.pmod(F.xxhash64(F.col(vec_col).cast("array<double>")), F.lit(1 << 30))
    return distinct.where(h < int((1 << 30) * rows / n)).distinct()


def train_balanced_cells(vectors: DataFrame, nlist: int = 100, vec_col: str = "embedding", seed: int = 42, max_iter: int = 20,
                         sample_rows: int = SAMPLE_ROWS, most: float = 4.0, levels: int = 3) -> DataFrame:
    """J2 for large tables: ``cell, centroid`` like ``train_cells``, trained on
    a bounded sample (``sample_rows``, a parameter of the result's quality only:
    every row is assigned afterwards).

    Cells that hold more than ``most`` times the mean number of rows are split:
    their own vectors, again a bounded sample, train the cells that replace
    them, up to ``levels`` times. A cell whose vectors are all equal cannot be
    split by distance; it stays, and search deals its rows out in parts."""
    spark = vectors.sparkSession
    cents = train_cells(sample_vectors(vectors, sample_rows, vec_col), nlist, vec_col, seed, max_iter)
    if levels < 2:
        return cents
    for level in range(1, levels):
        assigned = assign_cells(vectors.select(vec_col), cents, vec_col)
        sizes = {r["cell"]: r["count"] for r in assigned.where(F.col("cell") != UNUSABLE_CELL).groupBy("cell").count().collect()}   # a row per cell
        limit = most * sum(sizes.values()) / max(1, nlist)
        rows, split = {r.cell: r.centroid for r in cents.collect()}, False
        for cell, n in sorted(sizes.items()):
            if n <= limit:
                continue
            mine = sample_vectors(assigned.where(F.col("cell") == cell), sample_rows, vec_col).distinct()
            if len(mine.limit(2).collect()) < 2:
                continue
            new = train_cells(mine, max(2, math.ceil(n / limit * 2)), vec_col, seed + level, max_iter).collect()
            del rows[cell]
            top = max([*rows, *sizes])
            rows |= {top + 1 + i: r.centroid for i, r in enumerate(new)}
            split = True
        if not split:
            break
        cents = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(sorted(rows.items()))], "cell int, centroid array<double>")
    return cents


def _assigner(bc, vec_col: str, names: list[str]):
    """Compares each row's best cell so far with a block of centroids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cent, cells = bc.value
        step = max(1, min(TILE_BYTES // (8 * len(cells)), SLICE_BYTES // (8 * max(1, cent.shape[1]))))
        for rb in batches:
            vecs = rb.column(rb.schema.get_field_index(vec_col))
            cell = rb.column(rb.schema.get_field_index("cell")).to_numpy(zero_copy_only=False).copy()
            best = rb.column(rb.schema.get_field_index("__best")).to_numpy(zero_copy_only=False).copy()
            for a in range(0, len(vecs), step):
                at, V = _vectors(vecs.slice(a, step), cent.shape[1])
                S = np.round(V @ cent.T, RANK_DECIMALS)
                top = np.argmax(S, axis=1)             # first maximum = lowest cell
                score, rows = S[np.arange(len(top)), top], at + a
                win = score > best[rows]
                cell[rows[win]], best[rows[win]] = cells[top[win]], score[win]
            made = {"cell": pa.array(cell, pa.int32()), "__best": pa.array(best, pa.float64())}
            yield pa.RecordBatch.from_arrays(
                [made.get(n, rb.column(rb.schema.get_field_index(n))) for n in names], names=names)
    return run


def assign_cells(vectors: DataFrame, centroids: DataFrame, vec_col: str = "embedding",
                 broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Add ``cell INT`` (best centroid by inner product) to every row."""
    spark = vectors.sparkSession
    r = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("w")).first()
    blocks = max(1, math.ceil(r["n"] * (r["w"] or 0) * 8 / broadcast_limit_bytes))
    cur = vectors.drop("cell").withColumn("cell", F.lit(UNUSABLE_CELL)).withColumn("__best", F.lit(float("-inf")))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in cur.schema.fields])
    for b in range(blocks):
        part = centroids.select("cell", F.col("centroid").cast("array<double>").alias("centroid"))
        if blocks > 1:
            part = part.where(F.pmod(F.col("cell"), F.lit(blocks)) == b)
        t = part.orderBy("cell").toArrow()
        at, m = _vectors(t.column("centroid"), None)
        if len(at):
            bc = spark.sparkContext.broadcast((m, t.column("cell").to_numpy()[at].astype(np.int32)))
            cur = cur.mapInArrow(_assigner(bc, vec_col, schema.names), schema)
    return cur.drop("__best")


def search_ivf(questions: DataFrame, index: DataFrame, centroids: DataFrame, k: int = 5,
               nprobe: int = 10, corpus_keys=("doc_id", "chunk_index"), payload=(),
               query_key: str = "query_id", query_vec: str = "embedding", **kw) -> DataFrame:
    """Score each question only inside its ``nprobe`` best cells."""
    return knn(questions, index, k, query_key=query_key, query_vec=query_vec, corpus_keys=corpus_keys,
               payload=payload, cell_col="cell", centroids=centroids, nprobe=nprobe, **kw)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The row of the newest complete version, or None if nothing is saved."""
    if not path_exists(spark, f"{path}/_manifest"):
        return None
    r = spark.read.schema(MANIFEST).json(f"{path}/_manifest").orderBy(F.desc("version")).first()
    return r.asDict() if r else None


def save_index(index: DataFrame, path: str, centroids: DataFrame | None = None,
               keys: tuple | None = None, vec_col: str = "embedding",
               max_records_per_file: int = 1_000_000, keep_versions: int = 2,
               extra: dict[str, DataFrame] | None = None) -> str:
    """SRC7: the chunk store + vectors as Parquet; cell-partitioned when it
    has a ``cell`` column. Rows are range-partitioned on ``(cell, key)``:
    small cells share a task and get few files, while a hot cell (say a
    third of all vectors) is split across many tasks instead of one.

    A save never touches the versions before it, so readers go on; versions
    older than the last ``keep_versions`` are removed afterwards. ``extra``
    tables are kept beside the rows (``load_table`` reads them)."""
    spark = index.sparkSession
    cells = "cell" in index.columns
    if cells != (centroids is not None):
        raise ValueError("a cell index needs both a cell column and its centroids")
    last = manifest(spark, path)
    version = (last["version"] if last else 0) + 1
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"
    if cells:
        keys = keys or tuple(c for c in ("doc_id", "chunk_index", "vec_id") if c in index.columns)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (index.repartitionByRange(n, "cell", *keys).write.option("maxRecordsPerFile", max_records_per_file)
         .partitionBy("cell").parquet(f"{path}/{folder}/data"))
        centroids.coalesce(1).write.parquet(f"{path}/{folder}/centroids")
    else:
        index.write.parquet(f"{path}/{folder}/data")
    for name, table in (extra or {}).items():
        table.write.parquet(f"{path}/{folder}/{name}")
    width = spark.read.parquet(f"{path}/{folder}/data").agg(F.max(F.size(vec_col))).first()[0]
    row = (version, folder, "IVFFlat" if cells else "Flat", width, centroids.count() if cells else None, [])
    _publish(spark, path, row, keep_versions)
    return path


def _publish(spark: SparkSession, path: str, row: tuple, keep_versions: int) -> None:
    """Appends the manifest row, which makes the version visible, then removes
    what only versions older than the last ``keep_versions`` name."""
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")
    rows = spark.read.schema(MANIFEST).json(f"{path}/_manifest").collect()          # one row per save
    names = lambda r: {r.folder, *(r.deltas or [])}
    kept = set().union(*(names(r) for r in rows if r.version > row[0] - keep_versions))
    for name in set().union(*(names(r) for r in rows)) - kept:
        remove_path(spark, f"{path}/{name}")


def append_delta(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None,
                 extra: dict[str, DataFrame] | None = None, max_records_per_file: int = 1_000_000, keep_versions: int = 2) -> int:
    """A new version: the newest one, without the documents of ``gone``
    (``doc_id``), plus ``rows``. Rows of a document that is in both replace it.
    Only the delta is written. ``extra`` tables by name are kept beside the
    rows and merged alike (``load_table``). Returns the version."""
    last = manifest(spark, path)
    if last is None:
        raise RuntimeError(f"index not built: {path}")
    version = last["version"] + 1
    folder = f"d{version}-{uuid.uuid4().hex[:8]}"
    if last["type"] == "IVFFlat":
        cents = spark.read.parquet(f"{path}/{last['folder']}/centroids")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [c for c in ("doc_id", "chunk_index", "vec_id") if c in rows.columns]
        rows = assign_cells(rows, cents).repartitionByRange(n, "cell", *keys)
        rows.write.option("maxRecordsPerFile", max_records_per_file).partitionBy("cell").parquet(f"{path}/{folder}/data")
    else:
        rows.write.parquet(f"{path}/{folder}/data")
    if gone is not None:
        gone.select("doc_id").distinct().write.parquet(f"{path}/{folder}/gone")
    for name, table in (extra or {}).items():
        table.write.parquet(f"{path}/{folder}/{name}")
    row = (version, last["folder"], last["type"], last["width"], last["cells"], [*(last["deltas"] or []), folder])
    _publish(spark, path, row, keep_versions)
    return version


def load_table(spark: SparkSession, path: str, m: dict, name: str = "data") -> DataFrame:
    """One table of a version, its base and deltas merged: a row stands unless
    a later delta voids its document."""
    base = spark.read.parquet(f"{path}/{m['folder']}/{name}")
    deltas = m["deltas"] or []
    if not deltas:
        return base
    rows, gone = base.withColumn("__seq", F.lit(0)), None
    for i, folder in enumerate(deltas, 1):
        # a delta without rows has no file that tells its columns
        rows = rows.unionByName(spark.read.schema(base.schema).parquet(f"{path}/{folder}/{name}").withColumn("__seq", F.lit(i)))
        if path_exists(spark, f"{path}/{folder}/gone"):
            part = spark.read.parquet(f"{path}/{folder}/gone").withColumn("__gone", F.lit(i))
            gone = part if gone is None else gone.unionAll(part)
    if gone is None:
        return rows.drop("__seq")
    few = gone.count() * KEY_BYTES <= DEFAULT_BROADCAST_LIMIT
    gone = gone.groupBy("doc_id").agg(F.max("__gone").alias("__gone"))
    gone = F.broadcast(gone) if few else gone       # or else every row of the index is shuffled
    return rows.join(gone, "doc_id", "left").where("__gone IS NULL OR __seq >= __gone").select(*base.columns)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """SRC8: ``(index, centroids or None)`` of the newest version."""
    m = manifest(spark, path)
    if m is None:
        raise RuntimeError(f"index not built: {path}")
    return load_table(spark, path, m), spark.read.parquet(f"{path}/{m['folder']}/centroids") if m["type"] == "IVFFlat" else None


def compact(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> int:
    """Writes the newest version's merged rows (and ``extra`` tables) as a new
    base. Returns its version."""
    m = manifest(spark, path)
    idx, cents = load_index(spark, path)
    save_index(idx, path, cents, extra={name: load_table(spark, path, m, name) for name in extra})
    return m["version"] + 1


def index_stats(index: DataFrame | None, vec_col: str = "embedding") -> DataFrame:
    """A13 / health: one row ``status, index_loaded, total_chunks, dim``."""
    if index is None:
        raise RuntimeError("index not built")
    return index.agg(F.count(F.lit(1)).alias("total_chunks"),
                     F.max(F.size(vec_col)).cast("int").alias("dim")).select(
        F.when(F.col("total_chunks") > 0, F.lit("healthy")).otherwise(F.lit("empty")).alias("status"),
        (F.col("total_chunks") > 0).alias("index_loaded"), "total_chunks", "dim")
