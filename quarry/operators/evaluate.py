"""Answer evaluation (C3-C7, F13, A1-A9) over whole tables.

Inputs are tables keyed by ``query_id``:

* hits: ``query_id, rank, score, embedding[, chunk_index, filename]`` -
  the (unthresholded) top-k the answer was built from (S23);
* answers: ``query_id, answer``;
* runs: ``query_id, run, answer`` for reliability.

Every per-question group is bounded by k or by the number of runs; sentence
x hit pairs fan out by at most k per sentence. Means and counts are plain
aggregates (partial + final), so hot questions do not pile into one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safety import safety_struct
from ..functions.text import ellipsize, split_sentences, word_count
from ..functions.vectors import dot


def safety(answers: DataFrame, enabled: bool = True, answer_col: str = "answer") -> DataFrame:
    """C3 as one projection; adds ``safety`` struct."""
    return answers.withColumn("safety", safety_struct(F.col(answer_col), enabled))


def chunk_scores(hits: DataFrame, threshold: float = 0.7, cosine_col: str = "score") -> DataFrame:
    """PF10 in long form: a row per hit with its cosine and ``is_relevant``.
    The hits already carry the cosine of unit vectors (their search score),
    so the chunks are not embedded a second time."""
    cos = F.col(cosine_col)
    return hits.select(
        "query_id", "rank", "chunk_index", F.coalesce(F.col("filename"), F.lit("unknown")).alias("filename"),
        F.round("score", 4).alias("search_score"), F.round(cos, 4).alias("cosine_similarity"),
        (cos >= threshold).alias("is_relevant"), cos.alias("__cos"))


def relevance(hits: DataFrame, threshold: float = 0.7, cosine_col: str = "score",
              questions: DataFrame | None = None) -> DataFrame:
    """C4: per question mean cosine (4 dp), count >= threshold, precision
    with the hit count as denominator (S22) and ordered chunk scores. With
    ``questions`` (``query_id``) those without a hit score zero."""
    per = chunk_scores(hits, threshold, cosine_col)
    item = F.struct("rank", "chunk_index", "filename", "search_score", "cosine_similarity", "is_relevant")
    got = per.groupBy("query_id").agg(
        F.round(F.avg("__cos"), 4).alias("mean_score"),
        F.count_if("is_relevant").cast("int").alias("above_threshold"),
        F.round(F.count_if("is_relevant") / F.count(F.lit(1)), 4).alias("precision_at_k"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("chunk_scores"))
    if questions is None:
        return got
    return questions.select("query_id").join(got, "query_id", "left").select(
        "query_id", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
        F.coalesce("above_threshold", F.lit(0)).alias("above_threshold"),
        F.coalesce("precision_at_k", F.lit(0.0)).alias("precision_at_k"),
        F.coalesce("chunk_scores", F.array().cast(got.schema["chunk_scores"].dataType)).alias("chunk_scores"))


def sentences(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """F6 in long form: ``query_id, sentence_idx, sentence``."""
    return answers.select("query_id", F.posexplode(split_sentences(F.col(answer_col)))
                          .alias("sentence_idx", "sentence"))


def sentence_scores(answers: DataFrame, hits: DataFrame, embedder, threshold: float = 0.6,
                    answer_col: str = "answer") -> DataFrame:
    """C5 in long form: per answer sentence its best similarity among the
    question's hits, the 0-based position of that hit (lowest on ties, S21)
    and whether it reaches the threshold."""
    sents = embedder.embed(sentences(answers, answer_col), "sentence", "s_emb")
    h = hits.select("query_id", "rank", F.col("embedding").alias("c_emb"))
    pairs = sents.join(h, "query_id").withColumn("sim", dot("s_emb", "c_emb"))
    # ties are taken between scores equal to 12 decimals, as in search
    per = pairs.groupBy("query_id", "sentence_idx", "sentence").agg(
        F.max("sim").alias("max_sim"),
        F.max_by(F.col("rank"), F.struct(F.round("sim", 12), -F.col("rank"))).alias("best_rank"))
    return per.select("query_id", "sentence_idx", "sentence", "max_sim",
                      (F.col("best_rank") - 1).alias("best_matching_chunk"),
                      (F.col("max_sim") >= threshold).alias("is_grounded"))


def groundedness(answers: DataFrame, hits: DataFrame, embedder, threshold: float = 0.6,
                 answer_col: str = "answer") -> DataFrame:
    """Each answer sentence against the question's hits; a sentence is
    grounded when its best similarity reaches the threshold; the overall
    score is the grounded fraction, and the verdict compares that fraction
    before rounding. Empty answer, no hits or no sentence -> 0.0 / not
    grounded with zero counts (S35)."""
    per_sentence = sentence_scores(answers, hits, embedder, threshold, answer_col)
    item = F.struct(
        F.col("sentence_idx"),
        ellipsize("sentence", 100).alias("sentence"),
        F.round("max_sim", 4).alias("max_similarity"),
        F.col("best_matching_chunk"),
        F.col("is_grounded"))
    agg = per_sentence.groupBy("query_id").agg(
        F.count_if("is_grounded").cast("int").alias("grounded_sentences"),
        F.count(F.lit(1)).cast("int").alias("total_sentences"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("sentence_idx"))
        .alias("sentence_scores"))
    share = F.coalesce(F.col("grounded_sentences") / F.col("total_sentences"), F.lit(0.0))
    # a question without hits has no pairs, so no row in agg
    out = answers.select("query_id").join(agg, "query_id", "left")
    return out.select(
        "query_id", F.round(share, 4).alias("overall_score"),
        (F.col("total_sentences").isNotNull() & (share >= threshold)).alias("is_grounded"),
        F.coalesce("grounded_sentences", F.lit(0)).alias("grounded_sentences"),
        F.coalesce("total_sentences", F.lit(0)).alias("total_sentences"),
        F.coalesce("sentence_scores", F.array().cast(agg.schema["sentence_scores"].dataType))
        .alias("sentence_scores"))


def run_pairs(runs: DataFrame, embedder, answer_col: str = "answer") -> DataFrame:
    """``query_id, ra, rb, similarity`` of the answers of runs ra < rb.
    Runs per question are a small fixed number (the reliability setting)."""
    emb = embedder.embed(runs.select("query_id", "run", F.col(answer_col).alias("answer")), "answer", "emb")
    a = emb.select("query_id", F.col("run").alias("ra"), F.col("emb").alias("ea"))
    b = emb.select(F.col("query_id").alias("q2"), F.col("run").alias("rb"), F.col("emb").alias("eb"))
    return a.join(b, (F.col("query_id") == F.col("q2")) & (F.col("ra") < F.col("rb"))).select(
        "query_id", "ra", "rb", dot("ea", "eb").alias("similarity"))


def reliability(runs: DataFrame, embedder, answer_col: str = "answer",
                min_consistency: float = 0.75, max_cv: float = 0.5) -> DataFrame:
    """C6 over stored runs ``query_id, run, answer``: pairwise cosine of
    run answers (i < j), mean / min / population std, coefficient of
    variation of answer lengths, and the verdict. Runs per question are a
    small fixed number (the reliability setting), so the i < j self-join
    has a bounded fan-out. One run -> no pairs -> 0.0 consistency (S25)."""
    pairs = run_pairs(runs, embedder, answer_col).withColumnRenamed("similarity", "sim")
    emb = runs.select("query_id", "run", word_count(answer_col).alias("words"))
    pstats = pairs.groupBy("query_id").agg(
        F.avg("sim").alias("mean_c"), F.min("sim").alias("min_c"),
        F.stddev_pop("sim").alias("std_c"),
        F.transform(F.array_sort(F.collect_list(F.struct("ra", "rb", F.round("sim", 4).alias("s")))),
                    lambda x: x["s"]).alias("pairwise_scores"))
    lstats = emb.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_runs"),
        F.stddev_pop("words").alias("std_w"), F.avg("words").alias("avg_w"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "words"))), lambda x: x["words"])
        .alias("response_lengths"))
    cv = F.when(F.col("avg_w") > 0, F.col("std_w") / F.col("avg_w")).otherwise(F.lit(0.0))
    mean_c = F.coalesce("mean_c", F.lit(0.0))
    return lstats.join(pstats, "query_id", "left").select(
        "query_id",
        F.round(mean_c, 4).alias("mean_consistency"),
        F.round(F.coalesce("min_c", F.lit(0.0)), 4).alias("min_consistency"),
        F.round(F.coalesce("std_c", F.lit(0.0)), 4).alias("std_consistency"),
        F.round(cv, 4).alias("length_coefficient_of_variation"),
        "num_runs",
        ((mean_c >= min_consistency) & (cv <= max_cv)).alias("is_reliable"),
        "response_lengths",
        F.coalesce("pairwise_scores", F.array().cast("array<double>")).alias("pairwise_scores"))


def keyword_accuracy(answer, keywords) -> "F.Column":
    """share of expected keywords found in the answer, case-insensitive
    substring match; 0.0 for an empty list (S29)."""
    a = F.lower(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    kw = F.col(keywords) if isinstance(keywords, str) else keywords
    found = F.size(F.filter(kw, lambda k: F.contains(a, F.lower(k))))
    return F.when(F.size(kw) > 0, found / F.size(kw)).otherwise(F.lit(0.0))


def quality_score(relevance_mean, groundedness_overall, is_safe, reliability=None,
                  w=(0.3, 0.3, 0.2, 0.2)) -> "F.Column":
    """Weighted sum (relevance, groundedness, reliability, safety);
    reliability counts 1.0 when no repeated runs were evaluated, safety is
    1.0 when safe and 0.0 otherwise. Rounded to 4 dp.

    The sum is taken in exact decimal arithmetic over the 4-dp components,
    so the result does not depend on binary rounding at a .5 tie (S30)."""
    from decimal import Decimal

    def dec(c):
        return F.coalesce(c, F.lit(0.0)).cast("decimal(12,6)")

    def wt(x):
        return F.lit(Decimal(str(x))).cast("decimal(6,4)")
    rel = F.lit(Decimal("1")) if reliability is None else F.coalesce(reliability, F.lit(1.0))
    s = F.when(is_safe, F.lit(1)).otherwise(F.lit(0))
    total = (wt(w[0]) * dec(relevance_mean) + wt(w[1]) * dec(groundedness_overall)
             + wt(w[2]) * dec(rel) + wt(w[3]) * dec(s))
    return F.round(total, 4).cast("double")


def evaluate(answers: DataFrame, hits: DataFrame, embedder, cfg, runs: DataFrame | None = None) -> DataFrame:
    """Join C3-C6 per question into ``quality_score`` and ``pass``
    (quality >= pass threshold and safe)."""
    rel = relevance(hits, cfg.relevance_threshold, questions=answers)
    gr = groundedness(answers, hits, embedder, cfg.groundedness_threshold)
    sf = safety(answers.select("query_id", "answer"), cfg.enable_safety)
    out = sf.join(rel, "query_id", "left").join(gr, "query_id", "left")
    reli = None
    if runs is not None:
        rb = reliability(runs, embedder)
        out = out.join(rb.select("query_id", F.col("mean_consistency").alias("__rel")), "query_id", "left")
        reli = F.col("__rel")
    w = (cfg.w_relevance, cfg.w_groundedness, cfg.w_reliability, cfg.w_safety)
    q = quality_score(F.col("mean_score"), F.col("overall_score"), F.col("safety.is_safe"), reli, w)
    return out.select(
        "query_id",
        q.alias("quality_score"),
        F.coalesce("mean_score", F.lit(0.0)).alias("relevance"),
        F.coalesce("overall_score", F.lit(0.0)).alias("groundedness"),
        F.col("safety.is_safe").alias("safety"),
        ((q >= cfg.pass_threshold) & F.col("safety.is_safe")).alias("pass"))
