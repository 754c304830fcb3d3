"""Safety (reference cases), quality formula pinned to the published rows,
relevance / groundedness / reliability edge cases, request validation."""
import pytest
from pyspark.sql import functions as F

from quarry.config import demo
from quarry.functions.safety import safety_struct
from quarry.operators.clean import validate_questions
from quarry.operators.embed import HashedEmbedder
from quarry.operators.evaluate import (groundedness, keyword_accuracy, quality_score, relevance,
                                       reliability)


def _safety(spark, answer, enabled=True):
    df = spark.createDataFrame([(answer,)], "a string")
    return df.select(safety_struct(F.col("a"), enabled).alias("s")).first().s


def _cats(s):
    return [f.category for f in s.flags]


def test_safe_answer(spark):
    s = _safety(spark, "The revenue increased by 15% in Q3 compared to the previous quarter.")
    assert s.is_safe and s.risk_level in ("none", "low")


def test_email_is_flagged(spark):
    s = _safety(spark, "Contact john.doe@company.com for more details about this.")
    assert "personal_info_leak" in _cats(s) and not s.is_safe and s.risk_level == "high"


def test_hedging_is_flagged(spark):
    s = _safety(spark, "I think the answer might be correct, but maybe not. I believe it is probably fine.")
    assert "potential_hallucination" in _cats(s)


def test_short_answer_is_flagged(spark):
    s = _safety(spark, "Yes.")
    assert "too_short" in _cats(s)


def test_disabled_filter(spark):
    s = _safety(spark, "Contact john.doe@company.com", enabled=False)
    assert s.is_safe and s.flags == [] and s.total_flags == 0 and s.risk_level == "none"


def test_refusal_is_flagged_once(spark):
    s = _safety(spark, "I cannot determine the answer as the context does not contain enough information.")
    assert _cats(s).count("partial_refusal") == 1 and s.risk_level == "low" and s.is_safe


def test_pii_flag_per_pattern_and_order(spark):
    s = _safety(spark, "SSN 123-45-6789, card 1234567812345678, mail a@b.io. I think maybe probably.")
    assert _cats(s) == ["personal_info_leak"] * 3 + ["potential_hallucination"]
    assert s.total_flags == 4


PUBLISHED = [  # relevance, groundedness, quality (safe, no repeated runs)
    (0.3454, 1.0, 0.8036),
    (0.2202, 0.6667, 0.6661),
    (0.2844, 0.3333, 0.5853),
    (0.3267, 0.7692, 0.7288),
    (0.487, 1.0, 0.8461),
]


def test_quality_formula_reproduces_published_rows(spark):
    df = spark.createDataFrame(PUBLISHED, "r double, g double, q double")
    out = df.select("q", quality_score(F.col("r"), F.col("g"), F.lit(True)).alias("mine")).collect()
    assert [r.mine for r in out] == [r.q for r in out]


def test_keyword_accuracy(spark):
    df = spark.createDataFrame([("Retry after TIMEOUT, fallback used", ["timeout", "retry", "TXN"]),
                                ("anything", [])], "a string, kw array<string>")
    got = [r.x for r in df.select(keyword_accuracy("a", "kw").alias("x")).collect()]
    assert got == [pytest.approx(2 / 3), 0.0]


def test_relevance_precision_uses_hit_count(spark):
    hits = spark.createDataFrame([(1, 1, 0, "f", 0.9), (1, 2, 1, "f", 0.4), (1, 3, 2, "f", 0.8)],
                                 "query_id int, rank int, chunk_index int, filename string, score double")
    r = relevance(hits, 0.7).first()
    assert r.above_threshold == 2 and r.precision_at_k == round(2 / 3, 4) and r.mean_score == 0.7


def test_groundedness_edge_cases(spark):
    emb = HashedEmbedder(64)
    hits = emb.embed(spark.createDataFrame(
        [(1, 1, "The deployment finished after the rollout of version two."),
         (1, 2, "Unrelated text about weather and rain.")], "query_id int, rank int, t string"), "t")
    answers = spark.createDataFrame([(1, "The deployment finished after the rollout of version two. Short."),
                                     (2, "No hits for this one at all, sadly."), (3, "")],
                                    "query_id int, answer string")
    got = {r.query_id: r for r in groundedness(answers, hits, emb, 0.6).collect()}
    assert got[1].overall_score == 1.0 and got[1].total_sentences == 1 and got[1].is_grounded
    assert got[1].sentence_scores[0].best_matching_chunk == 0
    assert got[2].overall_score == 0.0 and got[2].total_sentences == 0 and not got[2].is_grounded
    assert got[3].overall_score == 0.0


def test_reliability_single_run_and_identical_runs(spark):
    emb = HashedEmbedder(64)
    runs = spark.createDataFrame([(1, 0, "same answer text here"), (1, 1, "same answer text here"),
                                  (2, 0, "only one run of this answer")],
                                 "query_id int, run int, answer string")
    got = {r.query_id: r for r in reliability(runs, emb).collect()}
    assert got[1].mean_consistency == 1.0 and got[1].is_reliable and got[1].pairwise_scores == [1.0]
    assert got[2].mean_consistency == 0.0 and not got[2].is_reliable and got[2].num_runs == 1


def test_request_validation(spark):
    q = spark.createDataFrame([(1, "ok?", None), (2, "", 5), (3, "q", 0), (4, "q", 25), (5, "x" * 2001, 5)],
                              "query_id int, question string, top_k int")
    got = {r.query_id: r for r in validate_questions(q).collect()}
    assert got[1].error is None and got[1].k == 5
    assert got[2].error and got[3].error and got[4].error and got[5].error


def test_demo_config():
    c = demo()
    assert (c.chunk_size, c.chunk_overlap, c.top_k, c.similarity_threshold, c.max_context_tokens) == \
        (256, 30, 5, 0.3, 1024)


def test_model_embedder_batches_and_normalises(spark):
    import numpy as np
    from quarry.operators.embed import ModelEmbedder

    class ToyModel:  # local class: shipped to the Python workers by value
        def encode(self, texts):
            import numpy as np
            return np.array([[len(t), t.count("a") + 1.0, 3.0] for t in texts])

    emb = ModelEmbedder(ToyModel, dim=3, batch_size=2)
    df = spark.createDataFrame([(i, "a" * i + "b") for i in range(7)], "id int, t string")
    rows = emb.embed(df, "t", "v").orderBy("id").collect()
    for r in rows:
        v = np.array(r.v, dtype=np.float64)
        want = np.array([len(r.t), r.t.count("a") + 1.0, 3.0])
        assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6)
