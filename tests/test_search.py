"""Exact and cell-pruned search, index persistence, context budget.
Brute force in NumPy is the oracle (the reference tests only counts)."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators.context import budget_context
from quarry.operators.index import (UNUSABLE_CELL, assign_cells, index_stats, load_index, save_index,
                                    search_ivf, train_cells)
from quarry.operators.search import knn, threshold_filter, unusable_vectors


def _vectors(n, dim=384, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _index(spark, n, dim=384, seed=0):
    v = _vectors(n, dim, seed)
    rows = [(i, f"doc_{i // 10}.txt", f"Chunk {i} content", v[i].tolist()) for i in range(n)]
    return v, spark.createDataFrame(
        rows, "chunk_index int, filename string, chunk_text string, embedding array<float>")


def _queries(spark, q):
    return spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))],
                                 "query_id long, embedding array<float>")


def _brute(v, q, k):
    s = q.astype(np.float64) @ v.astype(np.float64).T
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(v)), key=lambda j: (-round(s[i, j], 12), j))[:k]
        out[i] = [(j, s[i, j]) for j in order]
    return out


@pytest.mark.parametrize("n,k", [(100, 5), (50, 3), (50, 10), (7, 10)])
def test_exact_search_matches_brute_force(spark, n, k):
    v, idx = _index(spark, n)
    q = _vectors(6, seed=1)
    hits = knn(_queries(spark, q), idx, k, corpus_keys=("chunk_index",),
               payload=("filename", "chunk_text")).collect()
    want = _brute(v, q, k)
    for qi in range(len(q)):
        got = sorted((h for h in hits if h.query_id == qi), key=lambda h: h.rank)
        assert len(got) == min(k, n)  # fewer hits than k when the index is small (S13)
        assert [h.chunk_index for h in got] == [j for j, _ in want[qi]]
        assert np.allclose([h.score for h in got], [s for _, s in want[qi]], atol=1e-9)
        assert all(h.chunk_text == f"Chunk {h.chunk_index} content" for h in got)


def test_ties_break_on_key_and_blocks_equal_single_pass(spark):
    v, idx = _index(spark, 40, dim=16)
    dup = idx.unionByName(idx.withColumn("chunk_index", F.col("chunk_index") + 1000))
    q = _queries(spark, _vectors(9, 16, seed=3))
    one = knn(q, dup, 4, corpus_keys=("chunk_index",)).orderBy("query_id", "rank").collect()
    many = knn(q, dup, 4, corpus_keys=("chunk_index",), broadcast_limit_bytes=400) \
        .orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_index) for r in one] == [(r.query_id, r.chunk_index) for r in many]
    for r in one:  # duplicates tie: lower key ranks first
        if r.rank % 2 == 1:
            assert r.chunk_index < 1000


def test_per_query_k_and_threshold(spark):
    v, idx = _index(spark, 60, dim=32)
    q = spark.createDataFrame([(i, _vectors(3, 32, 5)[i].tolist(), k) for i, k in enumerate([1, 4, 20])],
                              "query_id long, embedding array<float>, k int")
    hits = knn(q, idx, 5, corpus_keys=("chunk_index",), per_query_k="k")
    counts = {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()}
    assert counts == {0: 1, 1: 4, 2: 20}
    t = sorted(r.score for r in hits.collect())[10]
    kept = threshold_filter(hits, t).collect()
    assert min(r.score for r in kept) >= t and any(r.score == t for r in kept)  # inclusive


def test_cell_search_full_probe_equals_exact_and_counts(spark):
    v, idx = _index(spark, 200, dim=32, seed=7)
    cents = train_cells(idx, nlist=10, seed=1)
    assert cents.count() == 10
    cells = assign_cells(idx, cents)
    assert cells.count() == 200 and cells.filter("cell < 0").count() == 0
    q = _queries(spark, _vectors(5, 32, seed=8))
    exact = knn(q, idx, 5, corpus_keys=("chunk_index",)).orderBy("query_id", "rank").collect()
    full = search_ivf(q, cells, cents, 5, nprobe=10, corpus_keys=("chunk_index",)) \
        .orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_index) for r in exact] == [(r.query_id, r.chunk_index) for r in full]
    few = search_ivf(q, cells, cents, 5, nprobe=2, corpus_keys=("chunk_index",)).collect()
    assert 0 < len(few) <= 25


def test_zero_and_unusable_vectors_get_defined_cells(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8]),
                                (4, [float("nan"), 1.0]), (5, None)], "chunk_index int, embedding array<float>")
    cents = train_cells(df.filter("chunk_index < 4"), nlist=2, seed=3)
    cells = {r.chunk_index: r.cell for r in assign_cells(df, cents).collect()}
    assert cells[2] == 0 and cells[4] == cells[5] == UNUSABLE_CELL  # a zero vector ties everywhere: lowest cell
    blocks = {r.chunk_index: r.cell for r in assign_cells(df, cents, broadcast_limit_bytes=16).collect()}
    assert blocks == cells


def test_vectors_with_nan_cost_no_other_row_its_place(spark):
    v, idx = _index(spark, 30, dim=8, seed=5)
    bad = spark.createDataFrame([(1000 + i, [float("nan")] * 8) for i in range(5)] + [(2000, None), (2001, [float("inf")] * 8)],
                                "chunk_index int, embedding array<float>")
    both = idx.select("chunk_index", "embedding").unionByName(bad).coalesce(1)
    q = _vectors(3, 8, seed=6)
    hits = knn(_queries(spark, q), both, 5, corpus_keys=("chunk_index",)).collect()
    want = _brute(v, q, 5)
    for qi in range(3):
        assert [h.chunk_index for h in sorted(hits, key=lambda h: h.rank) if h.query_id == qi] == [j for j, _ in want[qi]]
    r = unusable_vectors(both).first()
    assert (r.n_null, r.n_not_finite) == (1, 6)


def test_other_widths_are_an_error(spark):
    _, idx = _index(spark, 5, dim=8)
    with pytest.raises(Exception, match="width"):
        knn(_queries(spark, _vectors(2, 6)), idx, 2, corpus_keys=("chunk_index",)).collect()
    mixed = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="width"):
        knn(mixed, idx, 2, corpus_keys=("chunk_index",))


def test_any_k_per_question_is_honoured(spark):
    v, idx = _index(spark, 60, dim=8)
    q = spark.createDataFrame([(0, _vectors(1, 8, 5)[0].tolist(), 30), (1, _vectors(1, 8, 5)[0].tolist(), None)],
                              "query_id long, embedding array<float>, k int")
    hits = knn(q, idx, 5, corpus_keys=("chunk_index",), per_query_k="k")
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {0: 30, 1: 5}


def test_many_equal_vectors_and_questions_stay_bounded(spark):
    n = 100_000
    one = F.array(*[F.lit(x).cast("float") for x in (0.6, 0.8, 0.0, 0.0)])
    idx = spark.range(n).select(F.col("id").alias("vec_id"), one.alias("embedding"), F.expr("repeat('p', 200)").alias("pay"))
    q = spark.range(300).select(F.col("id").alias("query_id"), one.alias("embedding"))
    hits = knn(q, idx, 5, corpus_keys=("vec_id",), payload=("pay",), broadcast_limit_bytes=8000).collect()
    assert len(hits) == 1500 and all(h.vec_id == h.rank - 1 for h in hits)


def test_saving_a_flat_index_over_a_cell_index(spark, workdir):
    _, idx = _index(spark, 50, dim=8)
    cents = train_cells(idx, nlist=4, seed=2)
    path = f"{workdir}/idx"
    with pytest.raises(RuntimeError):
        load_index(spark, path)
    save_index(assign_cells(idx, cents), path, cents)
    old, c = load_index(spark, path)
    assert c.count() == 4
    save_index(idx.limit(20), path)
    new, c = load_index(spark, path)
    assert c is None and new.count() == 20 and old.count() == 50    # readers of the old version go on
    save_index(idx.limit(7), path)
    assert load_index(spark, path)[0].count() == 7
    with pytest.raises(ValueError):
        save_index(idx, path, cents)


def test_cell_search_reads_only_probed_partitions(spark, workdir):
    _, idx = _index(spark, 200, dim=8, seed=3)
    cents = train_cells(idx, nlist=10, seed=1)
    loaded, lc = load_index(spark, save_index(assign_cells(idx, cents), f"{workdir}/idx", cents))
    q = _queries(spark, _vectors(1, 8, seed=4))
    plan = search_ivf(q, loaded, lc, 3, nprobe=2, corpus_keys=("chunk_index",), materialize=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in text.replace("isnotnull(", "")


def test_save_load_roundtrip_and_stats(spark, workdir):
    v, idx = _index(spark, 50)
    cents = train_cells(idx, nlist=4, seed=2)
    path = save_index(assign_cells(idx, cents), f"{workdir}/idx", cents)
    loaded, lc = load_index(spark, path)
    assert loaded.count() == 50 and lc.count() == 4
    st = index_stats(loaded).first()
    assert st.index_loaded and st.total_chunks == 50 and st.dim == 384 and st.status == "healthy"
    flat = save_index(idx, f"{workdir}/flat")
    assert load_index(spark, flat)[1] is None
    with pytest.raises(RuntimeError):
        index_stats(None)


def test_budget_equals_prefix_loop(spark):
    import random
    rnd = random.Random(4)
    rows = [(q, r, rnd.randint(0, 400)) for q in range(30) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id int, rank int, token_count int")
    got = {(r.query_id, r.rank): r.in_context for r in budget_context(df, 700).collect()}
    for q in range(30):
        total, stopped = 0, False
        for r in range(1, 6):
            tc = rows[q * 5 + r - 1][2]
            if stopped or total + tc > 700:
                stopped = True
                assert got[(q, r)] is False
            else:
                total += tc
                assert got[(q, r)] is True


def test_incremental_merge_with_many_small_batches(spark):
    v, idx = _index(spark, 300, dim=24, seed=11)
    q = _vectors(4, 24, seed=12)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        hits = knn(_queries(spark, q), idx.coalesce(1), 6, corpus_keys=("chunk_index",)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = _brute(v, q, 6)
    for qi in range(len(q)):
        got = sorted((h for h in hits if h.query_id == qi), key=lambda h: h.rank)
        assert [h.chunk_index for h in got] == [j for j, _ in want[qi]]


def test_sql_dot_agrees_with_arrow_scorer(spark):
    from quarry.functions.vectors import dot
    v, idx = _index(spark, 80, dim=48, seed=21)
    q = _vectors(3, 48, seed=22)
    arrow = {(h.query_id, h.chunk_index): h.score
             for h in knn(_queries(spark, q), idx, 80, corpus_keys=("chunk_index",)).collect()}
    for qi in range(3):
        lit = F.array(*[F.lit(float(x)) for x in q[qi]])
        for r in idx.select("chunk_index", dot(lit, "embedding").alias("s")).collect():
            assert abs(arrow[(qi, r.chunk_index)] - r.s) < 1e-6


def test_embedder_takes_a_batch_in_bounded_slices(monkeypatch):
    """The vectors of a large batch are never all assembled at once, and equal
    those of row after row."""
    from quarry.operators import embed as E
    rnd = np.random.default_rng(4)
    words = [[f"w{int(x)}" for x in rnd.integers(0, 900, int(n))] for n in rnd.integers(0, 60, 5000)]
    words[7], words[8], words[9] = None, [], [f"long{i}" for i in range(E.SLICE_NUMBERS + 1)]
    rb = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(words, pa.list_(pa.string()))], names=["id", "t"])
    monkeypatch.setattr(E, "KNOWN_TERMS", 100)
    got = list(E._terms_to_vectors(64, "t", "v")(iter([rb])))
    assert max(b.num_rows for b in got) <= E.SLICE_NUMBERS // 64 and len(got) > 2
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(5000))
    vecs = [v for b in got for v in b.column("v").to_pylist()]
    assert vecs[7] is None and set(vecs[8]) == {0.0}
    for i in (0, 9, 1234, 4999):
        one = next(E._terms_to_vectors(64, "t", "v")(iter([rb.slice(i, 1)])))
        assert one.column("v").to_pylist()[0] == vecs[i]
    assert sum(b.num_rows for b in E._terms_to_vectors(64, "t", "v")(iter([rb.slice(0, 0)]))) == 0


def test_scorer_takes_a_batch_in_bounded_slices(monkeypatch):
    """Equal scores across slices are cut under the order of the keys."""
    from types import SimpleNamespace

    from pyspark.sql import types as T

    from quarry.operators import search as S
    rnd = np.random.default_rng(6)
    n, dim, k = 40_000, 16, 3
    V = rnd.integers(-1, 2, (n, dim)).astype(float)
    V[rnd.random(n) < 0.3] = V[0]
    keys = rnd.permutation(n)
    Q = np.vstack([V[0], rnd.normal(size=(4, dim)), np.zeros(dim)])
    bc = SimpleNamespace(value={"Q": Q, "qids": pa.array(range(6)), "k": np.full(6, k)})
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("score_key", T.DoubleType()),
                        T.StructField("__k", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("name", T.StringType())])
    rows, old = [], S._vectors
    monkeypatch.setattr(S, "_vectors", lambda col, d: rows.append(len(col)) or old(col, d))
    rb = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(V)), pa.array([f"n{i}" for i in keys])], names=["vec_id", "embedding", "name"])
    got = pa.Table.from_batches(S._scorer(bc, ["vec_id"], "embedding", ["name"], k, None, out)(iter([rb]))).to_pylist()
    assert max(rows) <= S.SLICE_BYTES // (8 * dim) and len(rows) > 1
    score = np.round(V @ Q.T, S.RANK_DECIMALS)
    for i in range(6):
        want = keys[np.lexsort((keys, -score[:, i]))[:k]].tolist()
        assert [r["vec_id"] for r in got if r["query_id"] == i] == want
    assert all(r["name"] == f"n{r['vec_id']}" for r in got)


def test_training_deals_out_many_vectors(spark, monkeypatch):
    """However few partitions hold them, a task of the training has a bounded share."""
    from pyspark.ml.clustering import KMeans

    from quarry.operators import index as I
    v = _index(spark, 600, 8)[1].coalesce(1)
    seen, old = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *a: seen.append(df.rdd.glom().map(len).collect()) or old(self, df, *a))
    monkeypatch.setattr(I, "TRAIN_BYTES", 8 * 8 * 40)
    assert train_cells(v, 4).count() == 4
    assert sum(seen[0]) == 600 and max(seen[0]) <= 60
