"""Bounded cell search as a join, late materialisation, index deltas and
incremental builds."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells as C
from quarry.operators.index import append_delta, assign_cells, compact, load_index, manifest, save_index, train_cells
from quarry.operators.search import knn
from quarry.operators.store import fetch, save_store
from quarry.session import scratch_path

DIM = 12


def vectors(spark, n=600, seed=1):
    """Clusters of unequal size, a third of all vectors equal, some zero, null
    and non-finite."""
    rnd = np.random.default_rng(seed)
    mids = rnd.normal(size=(7, DIM)) * 3
    rows = [(i, (mids[int(7 * rnd.random() ** 2)] + rnd.normal(size=DIM) * rnd.choice([0.1, 0.6])).tolist()) for i in range(n)]
    rows += [(10_000 + i, mids[3].tolist()) for i in range(n // 2)]
    rows += [(20_000, [0.0] * DIM), (20_001, None), (20_002, [float("nan")] * DIM), (20_003, [1e-9] * DIM)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def indexed(spark, v, nlist=9):
    cents = train_cells(v.where("vec_id < 20000"), nlist)
    idx = assign_cells(v, cents).checkpoint()
    return idx, C.cell_bounds(idx, cents).checkpoint()


def table(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_bounds_are_never_below_an_inner_product():
    rnd = np.random.default_rng(5)
    for scale in (1e-6, 1.0, 1e6):
        V = rnd.normal(size=(400, DIM)) * scale * rnd.random((400, 1))
        V[:5] = 0
        Q = np.vstack([rnd.normal(size=(20, DIM)), V[5:15], np.zeros((1, DIM))])
        cell = rnd.integers(0, 6, 400)
        M = np.stack([V[cell == c].mean(0) for c in range(6)])
        M[0] = 0
        norm = np.linalg.norm(V, axis=1)
        with np.errstate(all="ignore"):
            cos = np.einsum("ij,ij->i", V, M[cell]) / norm / np.linalg.norm(M, axis=1)[cell]
        stats = [[f(x[(cell == c) & np.isfinite(x)], initial=i) for c in range(6)] for f, x, i in
                 ((np.min, cos, 1.0), (np.min, norm, np.inf), (np.max, norm, 0.0))]
        bound = C.upper_bounds(Q, M, *map(np.array, stats))
        for c in range(6):
            assert ((Q @ V[cell == c].T).max(1) <= bound[:, c]).all()


@pytest.mark.parametrize("limit", [1 << 20, 3 * DIM * 8])
def test_join_by_cell_equals_the_search_of_all_rows(spark, limit):
    v = vectors(spark)
    idx, bounds = indexed(spark, v)
    q = v.where("vec_id % 7 = 0 OR vec_id >= 20000").select(F.col("vec_id").alias("query_id"), "embedding", (F.col("vec_id") % 9 + 1).cast("int").alias("top_k"))
    q = q.where("vec_id <> 20002" if "vec_id" in q.columns else "query_id <> 20002")
    hits, work = C.knn_by_cells(q, idx, bounds, 4, corpus_keys=("vec_id",), per_query_k="top_k", part_rows=50, block_questions=13,
                                broadcast_limit_bytes=limit)
    assert table(hits) == table(knn(q, v, 4, corpus_keys=("vec_id",), per_query_k="top_k"))
    share = work.agg(F.sum("rows") / (F.count("*") * idx.where("cell >= 0").count())).first()[0]
    assert 0 < share < 0.8                      # most questions skip cells
    near, _ = C.knn_by_cells(q, idx, bounds, 4, corpus_keys=("vec_id",), nprobe=2, exact=False, broadcast_limit_bytes=limit)
    cents = bounds.select("cell", "centroid")
    assert table(near) == table(knn(q, idx, 4, corpus_keys=("vec_id",), cell_col="cell", centroids=cents, nprobe=2))


def test_vectors_are_shuffled_once_per_group_of_bounded_bytes(spark):
    """A question goes once to every part of a cell and a vector once to every
    block of its questions, whatever the size of the tiles that are scored."""
    v = vectors(spark, 400)
    idx, bounds = indexed(spark, v, 3)
    q = v.where("vec_id < 20000").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), F.lit(3).cast("long").alias("k"),
                                         F.lit(float("-inf")).alias("kth"))
    pairs = q.crossJoin(bounds.select(F.col("cell").alias("of"))).withColumnRenamed("of", "cell").checkpoint()
    n, cells = q.count(), bounds.count()
    few = C.score_cells(pairs, idx, bounds, ("vec_id",), "embedding", part_rows=8, block_questions=8).checkpoint()
    assert few.count() == n * cells * 3                 # one part a cell: k rows a question and cell
    many = C.score_cells(pairs, idx, bounds, ("vec_id",), "embedding", part_rows=8, block_questions=8, group_bytes=50 * DIM * 8)
    assert many.count() > few.count()
    top = C._top(few, ["vec_id"]).checkpoint()
    found = lambda df: sorted(map(tuple, C._top(df, ["vec_id"]).select("query_id", "rank", "vec_id").collect()))
    assert found(many) == found(few)
    kth = top.groupBy(F.col("query_id").alias("q")).agg(F.min("score_key").alias("kth"))
    again = C.score_cells(pairs.drop("kth").join(kth, "q"), idx, bounds, ("vec_id",), "embedding", part_rows=8, block_questions=8)
    assert again.count() < few.count() and found(again) == found(few)


@pytest.mark.parametrize("rows", [1, 7, 64])
def test_tiles_find_the_best_rows_with_ties(rows):
    rnd = np.random.default_rng(rows)
    V = rnd.integers(-2, 3, (200, 3)).astype(float)      # many equal scores
    Q = rnd.integers(-2, 3, (30, 3)).astype(float)
    S = V @ Q.T
    low = np.where(rnd.random(30) < 0.5, -np.inf, np.sort(S, axis=0)[-3])
    r, c, score, key = C._best(V, Q, low, 5, rows)
    for i in range(30):
        want = [j for j in np.lexsort((np.arange(200), -S[:, i]))[:5] if S[j, i] >= low[i]]
        assert r[c == i].tolist() == want and (score[c == i] == S[want, i]).all() and (key[c == i] == S[want, i]).all()


def test_centroids_beyond_the_broadcast_limit_are_searched_in_blocks(spark):
    from quarry.operators.index import search_ivf
    v = vectors(spark, 200).withColumn("name", F.concat(F.lit("n"), "vec_id"))
    cents = train_cells(v.where("vec_id < 20000"), 8)
    idx = assign_cells(v, cents, broadcast_limit_bytes=2 * DIM * 8).checkpoint()
    q = v.where("vec_id % 5 = 0 AND vec_id < 10000").select(F.col("vec_id").alias("query_id"), "embedding")
    one = search_ivf(q, idx, cents, 3, nprobe=2, corpus_keys=("vec_id",), payload=("name",))
    many = search_ivf(q, idx, cents, 3, nprobe=2, corpus_keys=("vec_id",), payload=("name",), broadcast_limit_bytes=2 * DIM * 8)
    assert many.columns == one.columns and table(many) == table(one)
    assert all(r.name == f"n{r.vec_id}" for r in many.collect())


def test_many_questions_never_reach_the_driver(spark, monkeypatch):
    v = vectors(spark, 300)
    idx, bounds = indexed(spark, v, 5)
    rnd = np.random.default_rng(2)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(20_000, DIM)))], "query_id long, embedding array<double>")
    from pyspark.sql.classic.dataframe import DataFrame
    seen, old = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: seen.append(len(t := old(self))) or t)
    hits, _ = C.knn_by_cells(q, idx, bounds, 2, corpus_keys=("vec_id",), block_questions=500)
    got = hits.groupBy("rank").agg(F.count("*").alias("n"), F.sum(F.round("score", 6)).alias("s")).orderBy("rank").collect()
    assert max(seen) <= 5                       # only cells went through the driver
    monkeypatch.undo()
    V = np.array([r.embedding for r in v.where("vec_id <> 20001 AND vec_id <> 20002").collect()])
    Q = np.array([r.embedding for r in q.orderBy("query_id").collect()])
    best = np.sort(Q @ V.T, axis=1)[:, ::-1]
    assert [r.n for r in got] == [20_000] * 2
    assert [r.s for r in got] == pytest.approx([best[:, 0].sum(), best[:, 1].sum()], abs=0.02)


def test_no_questions_no_vectors(spark):
    v = vectors(spark, 50)
    idx, bounds = indexed(spark, v, 3)
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert C.knn_by_cells(q.limit(0), idx, bounds, corpus_keys=("vec_id",))[0].collect() == []
    assert C.knn_by_cells(q, idx.limit(0), bounds.limit(0), corpus_keys=("vec_id",))[0].collect() == []


def test_texts_are_fetched_for_the_hits_only(spark, workdir):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("text "), "id").alias("chunk_text"),
                                    F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    docs.write.parquet(f"{workdir}/all")
    path = save_store(docs.select("doc_id", "chunk_index", "chunk_text"), f"{workdir}/store")
    scan = spark.read.parquet(f"{workdir}/all").select("doc_id", "chunk_index", "embedding")
    assert "chunk_text" not in scan._jdf.queryExecution().executedPlan().toString()
    q = docs.where("doc_id IN (5, 17)").select(F.col("doc_id").alias("query_id"), "embedding")
    hits = knn(q, scan, 3)
    got = fetch(hits, path, ["chunk_text"])
    assert all(r.chunk_text == f"text {r.doc_id}" for r in got.collect()) and got.count() == 6
    few = fetch(hits.where("rank = 1").limit(1), path, ["chunk_text"])
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    missing = spark.createDataFrame([(-5, 0)], "doc_id long, chunk_index int")
    assert fetch(missing, path, ["chunk_text"]).first().chunk_text is None


@pytest.mark.parametrize("kind", ["flat", "cells"])
def test_deltas_replace_delete_and_compact(spark, workdir, kind):
    path = f"{workdir}/index"
    v = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    cents = train_cells(v, 4) if kind == "cells" else None
    save_index(assign_cells(v, cents) if cents else v, path, cents)
    reader = load_index(spark, path)[0]
    new = v.where("doc_id < 3").withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5)))
    append_delta(spark, path, new, v.where("doc_id < 5").select("doc_id"))
    ids = lambda: sorted(r.doc_id for r in load_index(spark, path)[0].collect())
    assert ids() == [0, 1, 2, *range(5, 60)]
    assert reader.count() == 60                                     # an older version goes on
    assert {tuple(r.embedding) for r in load_index(spark, path)[0].where("doc_id < 3").collect()} == {(0.5, 0.5)}
    append_delta(spark, path, v.where("doc_id = 4"), v.where("doc_id IN (4, 59)").select("doc_id"))
    append_delta(spark, path, v.limit(0))                           # an empty delta
    assert ids() == [0, 1, 2, *range(4, 59)]
    before = load_index(spark, path)[0]
    version = compact(spark, path)
    m = manifest(spark, path)
    assert (m["version"], m["deltas"]) == (version, []) and ids() == [0, 1, 2, *range(4, 59)]
    assert before.count() == 58
    q = v.where("doc_id = 30").select(F.col("doc_id").alias("query_id"), "embedding")
    idx, c = load_index(spark, path)
    assert knn(q, idx, 1, cell_col="cell" if c else None, centroids=c).first().doc_id == 30
    save_index(assign_cells(v, cents) if cents else v, path, cents)
    left = {f.name for f in __import__("pathlib").Path(path).iterdir()} - {"_manifest"}
    assert len(left) == 2                                           # the last two versions only
    with pytest.raises(RuntimeError):
        append_delta(spark, f"{workdir}/none", v)


def test_updates_embed_only_what_changed(spark, workdir):
    from quarry.config import DEFAULT
    from quarry.operators.embed import HashedEmbedder
    from quarry.plans.rag import prepare_chunks, update_index
    path = f"{workdir}/index"
    cfg = DEFAULT.with_(chunk_size=20, chunk_overlap=5)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") % 100 * 50 + i).cast("string")))).alias("text"),
        F.concat(F.lit("f"), "id").alias("filename")).withColumn("text", F.when(F.col("doc_id") == 7, None).otherwise(F.col("text")))
    one = update_index(spark, docs, path, cfg)
    assert (one["new"], one["version"]) == (200, 1) and one["chunks_embedded"] < 0.6 * one["chunks_made"]     # copies once
    assert update_index(spark, docs, path, cfg)["version"] == 1                                               # nothing to do
    later = docs.where("doc_id <> 11").withColumn("text", F.when(F.col("doc_id").isin(3, 4), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))) \
        .unionByName(docs.where("doc_id = 20").withColumn("doc_id", F.lit(900).cast("long")))
    two = update_index(spark, later, path, cfg)
    assert {k: two[k] for k in ("new", "changed", "deleted", "unchanged", "version")} == \
        {"new": 1, "changed": 2, "deleted": 1, "unchanged": 197, "version": 2}
    assert two["chunks_embedded"] == 2                              # the last windows of the changed texts
    cols = ["doc_id", "chunk_index", "chunk_text", "filename", "embedding"]
    want = prepare_chunks(later, cfg, HashedEmbedder(cfg.embedding_dim)).select(*cols)
    got = load_index(spark, path)[0].select(*cols)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    compact(spark, path, ["documents"])
    assert update_index(spark, later, path, cfg)["unchanged"] == 200
    assert key(load_index(spark, path)[0].select(*cols)) == key(want)


def test_stream_reader_sees_a_delta(spark, workdir):
    from quarry.config import DEFAULT
    from quarry.plans.rag import answer_from_index, update_index
    cfg = DEFAULT.with_(chunk_size=20, chunk_overlap=5, similarity_threshold=0.1)
    docs = spark.createDataFrame([(1, "red apples grow here", "a.txt"), (2, "blue boats sail", "b.txt")], "doc_id long, text string, filename string")
    path = scratch_path(spark, "index")
    update_index(spark, docs, path, cfg)
    ask = spark.createDataFrame([(1, "green pears")], "query_id long, question string")
    first = answer_from_index(spark, ask, path, cfg).first()
    update_index(spark, docs.unionByName(spark.createDataFrame([(3, "green pears fall", "c.txt")], docs.schema)), path, cfg)
    second = answer_from_index(spark, ask, path, cfg).first()
    assert first.chunks_used == 0 and [s.filename for s in second.sources][0] == "c.txt"


def test_balanced_cells_train_on_a_sample_and_split_what_is_too_big(spark):
    from quarry.operators.index import sample_vectors, train_balanced_cells
    rnd = np.random.default_rng(9)
    big = rnd.normal(size=DIM)
    rows = [(i, (big + rnd.normal(size=DIM) * 0.3).tolist()) for i in range(1500)]                    # one wide cluster
    rows += [(2000 + i, (rnd.normal(size=DIM) * 3).tolist()) for i in range(300)]
    rows += [(5000 + i, [7.0] * DIM) for i in range(900)]                                             # a third is one vector
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).checkpoint()
    sample = sample_vectors(v, 500)
    assert 200 < sample.count() < 800 and sorted(map(str, sample.collect())) == sorted(map(str, sample_vectors(v, 500).collect()))
    cents = train_balanced_cells(v, 12, sample_rows=500, most=2.0)
    sizes = {r["cell"]: r["count"] for r in assign_cells(v.where("vec_id < 5000"), cents).groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 1800 and max(sizes.values()) <= 2.0 * 2700 / 12 * 1.5
    idx = assign_cells(v, cents).checkpoint()
    assert idx.count() == 2700 and idx.where("vec_id >= 5000").select("cell").distinct().count() == 1
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = table(knn(q, v, 5, corpus_keys=("vec_id",)))
    bounds = C.cell_bounds(idx, cents)
    got, work = C.knn_by_cells(q, idx, bounds, 5, corpus_keys=("vec_id",), part_rows=200)
    assert table(got) == exact
    near = table(C.knn_by_cells(q, idx, bounds, 5, corpus_keys=("vec_id",), nprobe=max(1, cents.count() * 6 // 10), exact=False)[0])
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)


def test_messages_sent_again_are_answered_once(spark, workdir):
    from quarry.streaming.questions import first_of_each

    def send(name, values):
        spark.createDataFrame([(v,) for v in values], "value string").coalesce(1).write.text(f"{workdir}/in/{name}")

    def run():
        lines = first_of_each(spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{workdir}/in/*"), "1 day")
        q = lines.writeStream.format("parquet").option("checkpointLocation", f"{workdir}/ckpt").trigger(availableNow=True).start(f"{workdir}/out")
        q.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(f"{workdir}/out").collect())

    one, two, free = '{"query_id": 1, "question": "a"}', '{"query_id": 2, "question": "b"}', '{"question": "a"}'
    send("a", [one, one, free, "broken"])
    send("b", [one, two, free])
    send("c", [two])
    assert run() == sorted([one, two, free, free, "broken"])
    send("d", [one, two, free, '{"query_id": 3, "question": "a"}'])
    assert run() == sorted([one, two, free, free, free, "broken", '{"query_id": 3, "question": "a"}'])
