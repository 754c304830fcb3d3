"""The registered queries: each reads the shared tables at ``sf_dir`` and
returns a DataFrame; ``oracle_sql()`` in the entry module holds their DuckDB
twins. Parameters are the reference's published demo configuration
(256/30 windows, exact index, k=5, threshold 0.3, budget 1024).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import demo
from ..functions import text as TX
from ..functions.tokens import window_count, word_pieces
from ..operators.chunk import chunk_documents
from ..operators.clean import clean_documents
from ..plans.rag import answer_without_context, context_texts, in_context, prepare_chunks, retrieve
from ..sources.tables import documents_from_table, questions_from_table, read_table

CFG = demo()

# Injected artifacts: the shared documents contain no page lines, separators,
# blank runs or typographic characters, so both the query and its oracle add
# the same ones, derived from each row's own columns.
INJECT = [
    ("lit", "Page "), ("col", "doc_id"), ("lit", " of 99\n\n\n\n"),
    ("col", "text"),
    ("lit", "\n  "), ("col", "doc_id"), ("lit", "  \n=-=-=_\n\t“"), ("col", "lang"),
    ("lit", "” it’s… ok—done   x \t y\n\n\n\n‘end’ – 3 OF 10\n----\npage 7"),
]


def inject_spark() -> F.Column:
    return F.concat(*[F.lit(v) if t == "lit" else F.col(v).cast("string") for t, v in INJECT])


def inject_sql() -> str:
    from .oracle import lit
    return " || ".join(lit(v) if t == "lit" else f"CAST({v} AS VARCHAR)" for t, v in INJECT)


def _docs(spark, sf_dir) -> DataFrame:
    return documents_from_table(read_table(spark, sf_dir, "documents"))


def _injected(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", inject_spark().alias("raw"))


# --- cleaning -------------------------------------------------------------

def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir).select("doc_id", TX.normalize_whitespace("raw").alias("text"))


def clean_lines(spark, sf_dir):
    return _injected(spark, sf_dir).select("doc_id", TX.remove_headers_footers("raw").alias("text"))


def clean_typography(spark, sf_dir):
    return _injected(spark, sf_dir).select("doc_id", TX.fix_encoding_artifacts("raw").alias("text"))


def clean_full(spark, sf_dir):
    return _injected(spark, sf_dir).select("doc_id", TX.clean_text("raw").alias("text"))


# --- chunking -------------------------------------------------------------

def _clean_docs(spark, sf_dir):
    return clean_documents(_docs(spark, sf_dir))


def chunk_windows(spark, sf_dir):
    ch = chunk_documents(_clean_docs(spark, sf_dir), CFG.chunk_size, CFG.chunk_overlap)
    return ch.select("doc_id", "chunk_index", "token_count", "chunk_text")


def chunk_windows_long(spark, sf_dir):
    """F1 with long documents in parallel: texts over 2000 characters are cut
    into segments that spread over the tasks; equals ``chunk_windows``."""
    from ..operators.chunk import chunk_long_documents
    ch = chunk_long_documents(_clean_docs(spark, sf_dir), CFG.chunk_size, CFG.chunk_overlap, segment_chars=2000)
    return ch.select("doc_id", "chunk_index", "token_count", "chunk_text")


def chunk_table(spark, sf_dir):
    """UD5: the windows by the SQL table function; equals ``chunk_windows``."""
    from ..operators.chunk import register_chunk_table
    register_chunk_table(spark)
    _clean_docs(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("chunk_table_docs")
    return spark.sql(f"SELECT * FROM chunk_table(TABLE(SELECT doc_id, text FROM chunk_table_docs) PARTITION BY (doc_id), "
                     f"{CFG.chunk_size}, {CFG.chunk_overlap})")


class CharRuns:
    """A tokenizer of another kind than the built-in one: runs of letters, of
    digits and of anything else (ASCII classes), which join to the text."""
    PATTERN = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"

    def __call__(self, texts: list) -> list:
        import re
        run = re.compile(self.PATTERN)
        return [run.findall(t) for t in texts]


def chunk_tokenizer(spark, sf_dir):
    """UD4: windows over the pieces of a tokenizer written in Python."""
    from ..operators.chunk import python_pieces
    ch = chunk_documents(_clean_docs(spark, sf_dir), CFG.chunk_size, CFG.chunk_overlap, tokenizer=python_pieces(CharRuns()))
    return ch.select("doc_id", "chunk_index", "token_count", "chunk_text")


def chunk_counts(spark, sf_dir):
    """Chunks actually produced per document next to ``ceil(n/step)``."""
    docs = _clean_docs(spark, sf_dir)
    made = chunk_documents(docs, CFG.chunk_size, CFG.chunk_overlap) \
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    n = F.size(word_pieces("text"))
    return docs.select("doc_id", n.cast("long").alias("n_tokens"),
                       window_count(n, CFG.chunk_size, CFG.chunk_overlap).cast("long").alias("expected")) \
        .join(made, "doc_id", "left") \
        .select("doc_id", "n_tokens", "expected",
                F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


# --- embedding and search over documents ----------------------------------

def _chunks(spark, sf_dir):
    return prepare_chunks(_docs(spark, sf_dir), CFG)


def _questions(spark, sf_dir):
    return questions_from_table(read_table(spark, sf_dir, "benchmark"))


def embed_hashed(spark, sf_dir):
    ch = _chunks(spark, sf_dir)
    return ch.select("doc_id", "chunk_index", F.posexplode("embedding").alias("bucket", "w")) \
        .filter(F.col("w") > 0) \
        .select("doc_id", "chunk_index", F.col("bucket").cast("int").alias("bucket"),
                F.col("w").cast("double").alias("weight"))


class LetterModel:
    """A model for ``ModelEmbedder``: how often each ASCII letter and digit occurs."""
    LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"

    def encode(self, texts: list):
        import numpy as np
        at = np.frombuffer(self.LETTERS.encode(), np.uint8)
        return np.stack([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[at] for t in texts])


def embed_model(spark, sf_dir):
    """UD1: chunks embedded by a model that each Python worker loads once."""
    from ..operators.embed import ModelEmbedder
    ch = chunk_documents(_clean_docs(spark, sf_dir), CFG.chunk_size, CFG.chunk_overlap)
    got = ModelEmbedder(LetterModel, len(LetterModel.LETTERS)).embed(ch.select("doc_id", "chunk_index", "chunk_text"), "chunk_text")
    return got.select("doc_id", "chunk_index", F.posexplode("embedding").alias("bucket", "w")).where("w > 0").select(
        "doc_id", "chunk_index", "bucket", F.col("w").cast("double").alias("weight"))


def knn_documents(spark, sf_dir):
    hits = retrieve(_questions(spark, sf_dir), _chunks(spark, sf_dir), CFG, k=CFG.top_k)
    return hits.select("query_id", "rank", "doc_id", "chunk_index",
                       F.round("score", 6).alias("score"))


def hit_sources(spark, sf_dir):
    from ..functions.text import preview
    hits = retrieve(_questions(spark, sf_dir), _chunks(spark, sf_dir), CFG, k=CFG.top_k)
    return hits.filter(F.col("score") >= CFG.similarity_threshold).select(
        "query_id", "rank", "filename", "chunk_index",
        F.round("score", 4).alias("score"), preview("chunk_text").alias("preview"))


# --- answering: context, prompts, generation --------------------------------

def _hits(spark, sf_dir, payload=("filename", "chunk_text", "token_count", "embedding")):
    return retrieve(_questions(spark, sf_dir), _chunks(spark, sf_dir), CFG, k=CFG.top_k,
                    payload=payload)


def _answers(spark, sf_dir, hits=None):
    from .rag import answer_questions
    q = _questions(spark, sf_dir)
    return answer_questions(q, None, CFG, hits=hits if hits is not None else _hits(spark, sf_dir))


def _answer_columns(a):
    return a.select("query_id", "answer", "error", "model",
                    F.size("sources").cast("int").alias("n_sources"),
                    F.try_element_at("scores", F.lit(1)).alias("top_score"),
                    "chunks_retrieved", "chunks_used", "chunks_in_context")


def rag_answers(spark, sf_dir):
    """C2 over the whole benchmark table, flattened."""
    return _answer_columns(_answers(spark, sf_dir))


def context_budget(spark, sf_dir):
    from ..operators.context import budget_context
    from ..operators.search import threshold_filter
    passed = budget_context(threshold_filter(_hits(spark, sf_dir), CFG.similarity_threshold),
                            CFG.max_context_tokens)
    return passed.select("query_id", "rank", "token_count",
                         F.col("running_tokens").cast("long").alias("running_tokens"), "in_context")


def prompt_messages(spark, sf_dir):
    from ..functions import prompt as P
    from .rag import summarize_hits
    ctx = summarize_hits(_hits(spark, sf_dir), CFG).filter(F.col("chunks_in_context") > 0)
    msgs = _questions(spark, sf_dir).join(ctx, "query_id") \
        .withColumn("m", P.messages(F.col("context"), F.col("question")))
    return msgs.select("query_id", F.col("m")[0]["content"].alias("system_message"),
                       F.col("m")[1]["content"].alias("user_message"),
                       "chunks_in_context", "context_tokens")


def _conversations(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


def chat_render(spark, sf_dir):
    """F17 per conversation: ordered messages -> transcript prompt."""
    from ..operators.context import render_conversations
    return render_conversations(_conversations(spark, sf_dir))


def chat_segments(spark, sf_dir):
    """F17 in long form: a rendered message per turn, for conversations of any
    length."""
    from ..operators.context import conversation_segments
    return conversation_segments(_conversations(spark, sf_dir))


def answer_postprocess(spark, sf_dir):
    """F18 on generated text built from each conversation turn: an echoed
    prompt on even turns, and a ``---`` tail on all."""
    from ..functions import prompt as P
    conv = _conversations(spark, sf_dir)
    prompt = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    gen = F.concat(F.when(F.col("turn") % 2 == 0, prompt).otherwise(F.lit("")),
                   F.col("text"), F.lit("\n\n---\nnotes for turn "), F.col("turn").cast("string"))
    return conv.select("conv_id", "turn", P.postprocess_answer(gen, prompt).alias("answer"))


def prompt_defaults(spark, sf_dir):
    """a context section per document, whose metadata is missing by
    its id: no file name on every third, no chunk number on every fifth."""
    from ..functions import prompt as P
    d = read_table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    chunk = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7)
    return d.select("doc_id", P.section(name, chunk, F.col("doc_id") % 1000 / 1000, F.col("text")).alias("section"))


def text_previews(spark, sf_dir):
    """F20, PF8, PF11: every document's text shortened in the three ways that
    sentence scores, sources and reports use."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.ellipsize("text", 100).alias("ellipsized"), TX.preview("text", 150).alias("preview"),
                    TX.truncate("text", 200).alias("truncated"))


def _turn_messages(spark, sf_dir):
    """A prompt per conversation turn; a null text asks nothing."""
    from ..functions import prompt as P
    return _conversations(spark, sf_dir).select("conv_id", "turn", P.no_context_messages(F.coalesce("text", F.lit(""))).alias("messages"))


class WordReplies:
    """A model for ``BatchGenerator``: the question's words in reverse order. It
    answers a list at a time and tells how many words it read."""

    def __call__(self, asked: list) -> list:
        words = [m[-1]["content"].split(" ") for m in asked]
        return [{"answer": " ".join(reversed(w)), "model": "reverse", "usage": {"words": len(w)}} for w in words]


def generate_batch(spark, sf_dir):
    """UD2: every turn answered in batches by a model loaded once per worker."""
    from ..operators.generate import BatchGenerator, generate_with
    got = generate_with(_turn_messages(spark, sf_dir), BatchGenerator(WordReplies))
    return got.select("conv_id", "turn", "answer", F.col("usage")["words"].alias("words"), "model", "error")


def _no_question_marks(messages):
    """A generator that fails on some prompts."""
    text = messages[-1]["content"]
    if "?" in text or not text:
        raise ValueError("refused: " + text[:20])
    return {"answer": text[:40], "usage": {"calls": 1}}


def generate_errors(spark, sf_dir):
    """UD2: calls that fail become answers with an error, row by row."""
    from ..operators.generate import generate_with
    got = generate_with(_turn_messages(spark, sf_dir), _no_question_marks, model_name="picky")
    return got.select("conv_id", "turn", "answer", F.size("usage").alias("n_usage"), "model", "error")


def request_validation(spark, sf_dir):
    """PF9 on conversation turns used as requests; top_k from the turn
    number (NULL for system turns -> default)."""
    from ..operators.clean import validate_questions
    conv = _conversations(spark, sf_dir).select(
        "conv_id", "turn", F.col("text").alias("question"),
        F.when(F.col("role") == "system", F.lit(None)).otherwise(F.col("turn") * 4 - 1)
        .cast("int").alias("top_k"))
    v = validate_questions(conv, CFG.top_k, CFG.max_top_k, CFG.max_question_chars)
    return v.select("conv_id", "turn", "k", "error")


# --- evaluation -----------------------------------------------------------

def _safety_out(df, keys, answer):
    from ..functions.safety import safety_struct
    s = safety_struct(answer)
    return df.select(*keys, s.alias("s")).select(
        *keys, F.col("s.is_safe").alias("is_safe"), F.col("s.risk_level").alias("risk_level"),
        F.col("s.total_flags").alias("total_flags"),
        F.array_join(F.transform("s.flags", lambda f: f["category"]), ",").alias("categories"))


def safety_flags(spark, sf_dir):
    """C3 over every document text (emails, card-like numbers, long texts)."""
    return _safety_out(read_table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))


SAFETY_SUFFIX = {"assistant": " I think it is probably right, maybe.",
                 "user": " I cannot determine that from here."}


def safety_verdict(spark, sf_dir):
    """C3 over conversation turns with role-dependent hedging/refusal text."""
    conv = _conversations(spark, sf_dir)
    suffix = F.coalesce(*[F.when(F.col("role") == r, F.lit(v)) for r, v in SAFETY_SUFFIX.items()],
                        F.lit(""))
    return _safety_out(conv, ["conv_id", "turn"], F.concat(F.col("text"), suffix))


def sentence_split(spark, sf_dir):
    from ..functions.text import split_sentences
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("sentence_idx", "sentence")) \
        .withColumn("sentence_idx", F.col("sentence_idx").cast("int"))


def relevance_scores(spark, sf_dir):
    from ..operators.evaluate import relevance
    r = relevance(_hits(spark, sf_dir), CFG.relevance_threshold, questions=_questions(spark, sf_dir))
    return r.select("query_id", "mean_score", "above_threshold", "precision_at_k")


def chunk_scores(spark, sf_dir):
    """PF10: every hit of every question with its verdict."""
    from ..operators.evaluate import chunk_scores as scores
    return scores(_hits(spark, sf_dir), CFG.relevance_threshold).drop("__cos")


def sources_long(spark, sf_dir):
    """The ``sources`` and ``scores`` arrays of C2, a row per entry."""
    a = _answers(spark, sf_dir)
    pairs = F.arrays_zip(F.col("sources").alias("src"), F.col("scores").alias("score"))
    x = a.select("query_id", F.posexplode(pairs).alias("pos", "x"))
    return x.select("query_id", F.col("pos").cast("int").alias("pos"), F.col("x")["src"]["filename"].alias("filename"),
                    F.col("x")["src"]["chunk_index"].alias("chunk_index"), F.col("x")["src"]["score"].alias("source_score"),
                    F.col("x")["score"].alias("score"), F.col("x")["src"]["preview"].alias("preview"))


def _embedder():
    from .rag import default_embedder
    return default_embedder(CFG)


def groundedness_scores(spark, sf_dir):
    """C5 with each benchmark passage as the answer to check against its
    own top-5 chunks (passages are planted in some documents)."""
    from ..operators.evaluate import groundedness
    ans = _questions(spark, sf_dir).select("query_id", F.col("question").alias("answer"))
    g = groundedness(ans, _hits(spark, sf_dir), _embedder(), CFG.groundedness_threshold)
    return g.select("query_id", "overall_score", "is_grounded", "grounded_sentences", "total_sentences")


def sentence_scores(spark, sf_dir):
    """Each sentence of each benchmark passage, its best similarity
    among the question's hits and the position of that hit."""
    from ..operators.evaluate import sentence_scores as scores
    ans = _questions(spark, sf_dir).select("query_id", F.col("question").alias("answer"))
    g = scores(ans, _hits(spark, sf_dir), _embedder(), CFG.groundedness_threshold)
    return g.select("query_id", F.col("sentence_idx").cast("int").alias("sentence_idx"), "sentence",
                    F.round("max_sim", 4).alias("max_similarity"), "best_matching_chunk", "is_grounded")


def _runs(spark, sf_dir):
    """The question asked ``reliability_runs`` times; run r gets the
    context without its first r sections, so the answers differ as repeated
    generations do, and every engine can compute them."""
    from ..operators.generate import extractive_answer
    h = in_context(_hits(spark, sf_dir), CFG).filter("in_context").withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.lit(CFG.reliability_runs - 1))))
    texts = h.groupBy("query_id", "run").agg(context_texts(F.col("rank") > F.col("run")).alias("t"))
    return _questions(spark, sf_dir).join(texts, "query_id").select(
        "query_id", "run", extractive_answer(F.col("t"), F.col("question")).alias("answer"))


def reliability_scores(spark, sf_dir):
    from ..operators.evaluate import reliability
    r = reliability(_runs(spark, sf_dir), _embedder())
    return r.select("query_id", "mean_consistency", "min_consistency", "std_consistency",
                    "length_coefficient_of_variation", "num_runs", "is_reliable")


def _start_of_prompt(messages):
    """A generator that SQL can follow: the start of the user's message."""
    return {"answer": messages[-1]["content"][:120], "model": "start", "usage": {"calls": 1}}


def _callable_runs(spark, sf_dir):
    from ..functions import prompt as P
    from ..operators.generate import repeat_runs
    from .rag import summarize_hits
    ctx = summarize_hits(_hits(spark, sf_dir), CFG).filter(F.col("chunks_in_context") > 0)
    prompts = _questions(spark, sf_dir).join(ctx, "query_id").select("query_id", P.messages(F.col("context"), F.col("question")).alias("messages"))
    return repeat_runs(prompts, _start_of_prompt, CFG.reliability_runs)


def callable_runs(spark, sf_dir):
    """UD2/UD3: the engine's own callable asked several times per question."""
    return _callable_runs(spark, sf_dir).select("query_id", F.col("run").cast("int").alias("run"), "answer")


def reliability_callable(spark, sf_dir):
    """C6 over the answers of the callable under test."""
    from ..operators.evaluate import reliability
    r = reliability(_callable_runs(spark, sf_dir), _embedder())
    return r.select("query_id", "mean_consistency", "min_consistency", "std_consistency",
                    "length_coefficient_of_variation", "num_runs", "is_reliable")


def question_report(spark, sf_dir):
    """PF12: the evaluation per question with the question's text."""
    from .report import question_report as report
    return report(quality_scores(spark, sf_dir), _questions(spark, sf_dir), 60)


def reliability_pairs(spark, sf_dir):
    """The pairwise scores behind the reliability figures."""
    from ..operators.evaluate import run_pairs
    p = run_pairs(_runs(spark, sf_dir), _embedder())
    return p.select("query_id", "ra", "rb", F.round("similarity", 4).alias("similarity"))


def _keywords(question):
    from ..functions.tokens import embed_terms
    return F.array_distinct(embed_terms(question))


def keyword_accuracy(spark, sf_dir):
    """RAG answers against keywords drawn from each question (its
    distinct terms)."""
    from ..operators.evaluate import keyword_accuracy as kacc
    a = _answers(spark, sf_dir).withColumn("kw", _keywords(F.col("question")))
    return a.select("query_id", F.size("kw").cast("int").alias("n_keywords"),
                    F.round(kacc("answer", "kw"), 4).alias("keyword_accuracy"))


def _scored(spark, sf_dir):
    """(hits, answers, quality) from one scan of the corpus: the hits are on
    disk once ``retrieve`` returns, and all else reads them."""
    from ..operators.evaluate import evaluate
    hits = _hits(spark, sf_dir)
    ans = _answers(spark, sf_dir, hits)
    return hits, ans, evaluate(ans.select("query_id", "answer"), hits, _embedder(), CFG)


def quality_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[2]


def quality_with_runs(spark, sf_dir):
    """C7 with reliability measured on repeated runs."""
    from ..operators.evaluate import evaluate
    hits = _hits(spark, sf_dir)
    ans = _answers(spark, sf_dir, hits).select("query_id", "answer")
    return evaluate(ans, hits, _embedder(), CFG, runs=_runs(spark, sf_dir))


def benchmark_compare(spark, sf_dir):
    """RAG vs no-context answers on keyword accuracy (U2 union, A11
    averages, A12 improvement) plus the mean quality score."""
    from .report import compare_answers, comparison
    _, ans, quality = _scored(spark, sf_dir)
    base = answer_without_context(_questions(spark, sf_dir))
    return comparison(compare_answers(ans, base, _keywords(F.col("question"))), quality)


def benchmark_results(spark, sf_dir):
    """C8 per question: both variants side by side, answers cut to 200
    characters (PF11)."""
    from .report import compare_answers
    base = answer_without_context(_questions(spark, sf_dir))
    per = compare_answers(_answers(spark, sf_dir), base, _keywords(F.col("question")))
    return per.withColumn("keyword_accuracy", F.round("keyword_accuracy", 4))


def demo_summary(spark, sf_dir):
    """Mean quality, pass rate and index size for the run; chunks are
    counted before they are embedded."""
    from .report import demo_summary as summary
    chunks = chunk_documents(_clean_docs(spark, sf_dir), CFG.chunk_size, CFG.chunk_overlap)
    return summary(_scored(spark, sf_dir)[2], chunks.agg(F.count(F.lit(1)).alias("total_chunks")))


# --- vector table: exact, per-question k, threshold, cells, index ---------

THRESHOLD_EMB = 0.35
NLIST = 100
PAYLOAD = ["filename", "chunk_text", "token_count"]
UPDATE_COUNTS = ["new", "changed", "deleted", "unchanged", "chunks_made", "chunks_embedded"]
#: of the ten label cells; fewer miss more than a tenth of the neighbours
NPROBE_CELLS = 8


def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def label_centroids(emb: DataFrame) -> DataFrame:
    """One question per label: the normalised sum of its vectors (a plain
    partial + final aggregate, so a hot label costs no more than others)."""
    from ..functions.vectors import l2_norm, vector_sum
    dim = int(emb.select(F.size("embedding")).first()[0])
    c = emb.groupBy("label").agg(vector_sum("embedding", dim).alias("s"))
    n = l2_norm("s")
    return c.select(F.col("label").cast("long").alias("query_id"),
                    F.transform("s", lambda x: x / n).alias("embedding"),
                    (F.col("label") + 1).cast("int").alias("top_k"))


def _knn_emb(spark, sf_dir, **kw):
    from ..operators.search import knn
    e = _emb(spark, sf_dir)
    return knn(label_centroids(e), e, kw.pop("k", CFG.top_k), corpus_keys=("vec_id",), **kw)


def knn_exact(spark, sf_dir):
    h = _knn_emb(spark, sf_dir)
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def knn_exact_arrow(spark, sf_dir):
    """k = 30 with the questions in several broadcast blocks over a staged
    corpus, as a large question table would run."""
    h = _knn_emb(spark, sf_dir, k=30, max_candidates=100)
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def knn_per_query_k(spark, sf_dir):
    h = _knn_emb(spark, sf_dir, per_query_k="top_k")
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def knn_threshold(spark, sf_dir):
    """PF6 + A15 + PF7: retrieved vs used counts and the no-hit fallback."""
    from ..functions.prompt import NO_HIT_ANSWER
    h = _knn_emb(spark, sf_dir)
    per = h.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunks_retrieved"),
        F.count_if(F.col("score") >= THRESHOLD_EMB).cast("int").alias("chunks_used"),
        F.min_by(F.when(F.col("score") >= THRESHOLD_EMB, F.col("vec_id")),
                 F.when(F.col("score") >= THRESHOLD_EMB, F.col("rank"))).alias("best_vec_id"))
    q = label_centroids(_emb(spark, sf_dir)).select("query_id")
    return q.join(per, "query_id", "left").select(
        "query_id", F.coalesce("chunks_retrieved", F.lit(0)).alias("chunks_retrieved"),
        F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"), "best_vec_id",
        F.when(F.coalesce("chunks_used", F.lit(0)) == 0, F.lit(NO_HIT_ANSWER)).alias("fallback_answer"))


def _label_cells(e: DataFrame) -> DataFrame:
    """The label centroids as the cells of an index: no training, so that
    assignment, probing and recall can be recomputed elsewhere."""
    return label_centroids(e).select(F.col("query_id").cast("int").alias("cell"), F.col("embedding").alias("centroid"))


def _saved_cells(spark, sf_dir):
    """(index, centroids), written cell by cell and loaded again."""
    from ..operators.index import assign_cells, load_index, save_index
    from ..session import scratch_path
    e = _emb(spark, sf_dir)
    cents = _label_cells(e)
    return load_index(spark, save_index(assign_cells(e, cents), scratch_path(spark, "index"), cents))


def _vector_questions(e: DataFrame) -> DataFrame:
    """Every hundredth vector is a question."""
    return e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def ivf_assign(spark, sf_dir):
    """The cell of every vector, from the saved index."""
    return _saved_cells(spark, sf_dir)[0].select("vec_id", "cell")


def ivf_probe(spark, sf_dir):
    """Top-k inside the ``NPROBE_CELLS`` best cells of each question, from the
    saved index (only probed cells are read)."""
    from ..operators.index import search_ivf
    idx, cents = _saved_cells(spark, sf_dir)
    h = search_ivf(_vector_questions(_emb(spark, sf_dir)), idx, cents, CFG.top_k, nprobe=NPROBE_CELLS, corpus_keys=("vec_id",))
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def ivf_full_probe(spark, sf_dir):
    """``nprobe`` = all trained cells must equal exact search."""
    from ..operators.index import assign_cells, search_ivf, train_cells
    e = _emb(spark, sf_dir)
    cents = train_cells(e, NLIST, seed=CFG.kmeans_seed, max_iter=CFG.kmeans_max_iter)
    h = search_ivf(label_centroids(e), assign_cells(e, cents), cents, CFG.top_k, nprobe=cents.count(),
                   corpus_keys=("vec_id",))
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def ivf_recall(spark, sf_dir):
    """recall@k of ``NPROBE_CELLS`` probed cells against exact search."""
    from ..operators.index import search_ivf
    from ..operators.search import knn
    e = _emb(spark, sf_dir)
    idx, cents = _saved_cells(spark, sf_dir)
    q = _vector_questions(e)
    approx = search_ivf(q, idx, cents, CFG.top_k, nprobe=NPROBE_CELLS, corpus_keys=("vec_id",))
    exact = knn(q, e, CFG.top_k, corpus_keys=("vec_id",))
    found = exact.join(approx.select("query_id", "vec_id", F.lit(1).alias("hit")),
                       ["query_id", "vec_id"], "left")
    return found.groupBy("query_id").agg(
        F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall_at_k"),
        F.count(F.lit(1)).alias("k"))


def cell_search(spark, sf_dir):
    """Exact top-k by bounded cells, from the saved index: cells whose bound
    lies below a question's k-th score are not read for it."""
    from ..operators.cells import cell_bounds, knn_by_cells
    idx, cents = _saved_cells(spark, sf_dir)
    h, _ = knn_by_cells(_vector_questions(_emb(spark, sf_dir)), idx, cell_bounds(idx, cents), CFG.top_k, corpus_keys=("vec_id",))
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def cell_search_all(spark, sf_dir):
    """Every vector of the table is a question, joined with the index by
    cell, hot cells in parts; exact top-k of each."""
    from ..operators.cells import cell_bounds, knn_by_cells
    idx, cents = _saved_cells(spark, sf_dir)
    q = _emb(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    h, _ = knn_by_cells(q, idx, cell_bounds(idx, cents), CFG.top_k, corpus_keys=("vec_id",), part_rows=512, block_questions=256)
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def cell_search_nprobe(spark, sf_dir):
    """The approximate form of the join; equals ``ivf_probe``."""
    from ..operators.cells import cell_bounds, knn_by_cells
    idx, cents = _saved_cells(spark, sf_dir)
    h, _ = knn_by_cells(_vector_questions(_emb(spark, sf_dir)), idx, cell_bounds(idx, cents), CFG.top_k, corpus_keys=("vec_id",),
                        nprobe=NPROBE_CELLS, exact=False)
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def hit_sources_late(spark, sf_dir):
    """Keys and vectors are searched, then the hits' texts are fetched from
    the sliced store; equals ``hit_sources``."""
    from ..functions.text import preview
    from ..operators.store import fetch, save_store
    from ..session import scratch_path
    path, texts = scratch_path(spark, "vectors"), scratch_path(spark, "texts")
    chunks = _chunks(spark, sf_dir)
    chunks.select("doc_id", "chunk_index", "filename", "chunk_text", "embedding").write.parquet(path)
    chunks = spark.read.parquet(path)
    save_store(chunks.select("doc_id", "chunk_index", "filename", "chunk_text"), texts)
    hits = retrieve(_questions(spark, sf_dir), chunks, CFG, k=CFG.top_k, payload=())
    hits = fetch(hits.filter(F.col("score") >= CFG.similarity_threshold), texts, ["filename", "chunk_text"])
    return hits.select("query_id", "rank", "filename", "chunk_index",
                       F.round("score", 4).alias("score"), preview("chunk_text").alias("preview"))


def rag_answers_cells(spark, sf_dir):
    """C2 on a saved index with trained cells, searched exactly by bounds in a
    part of the cells, texts fetched for the hits; equals ``rag_answers``."""
    from ..operators.cells import cell_bounds, knn_by_cells
    from ..operators.index import load_index
    from ..operators.store import fetch, save_store
    from ..session import scratch_path
    from .rag import answer_questions, build_index, embed_questions
    path, texts = scratch_path(spark, "cells"), scratch_path(spark, "texts")
    cfg = CFG.with_(index_type="IVFFlat", nlist=16, nprobe=2)
    build_index(spark, _docs(spark, sf_dir), path, cfg)
    idx, cents = load_index(spark, path)
    save_store(idx.select("doc_id", "chunk_index", *PAYLOAD), texts)
    q = _questions(spark, sf_dir)
    hits, _ = knn_by_cells(embed_questions(q.select("query_id", "question"), cfg), idx, cell_bounds(idx, cents), cfg.top_k, nprobe=cfg.nprobe)
    return _answer_columns(answer_questions(q, None, cfg, hits=fetch(hits, texts, PAYLOAD)))


def _earlier(docs: DataFrame) -> DataFrame:
    """An earlier state of the documents: one in 100 had another text, and one
    in 100 another id."""
    return docs.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit(" As it was."))).otherwise(F.col("text"))) \
        .withColumn("doc_id", F.when(F.col("doc_id") % 100 == 1, -F.col("doc_id")).otherwise(F.col("doc_id")))


def _updated(spark, sf_dir):
    """(path, counters) of an index of an earlier state brought to the present."""
    from ..session import scratch_path
    from .rag import update_index
    path = scratch_path(spark, "updated")
    docs = _docs(spark, sf_dir)
    update_index(spark, _earlier(docs), path, CFG)
    return path, update_index(spark, docs, path, CFG)


def index_update(spark, sf_dir):
    """The chunks of an index that was brought up to date by a delta equal
    those of a build from nothing."""
    from ..operators.index import load_index
    path, _ = _updated(spark, sf_dir)
    return load_index(spark, path)[0].select("doc_id", "chunk_index", "token_count", "chunk_text")


def index_update_counts(spark, sf_dir):
    """A14 of the update: what was new, changed and deleted, and how many
    chunks of other texts had to be embedded."""
    _, seen = _updated(spark, sf_dir)
    return spark.createDataFrame([tuple(seen[c] for c in UPDATE_COUNTS)], ", ".join(f"{c} long" for c in UPDATE_COUNTS))


def index_compacted(spark, sf_dir):
    """SRC7: the updated index compacted into a new base; every weight of every
    vector equals ``embed_hashed``."""
    from ..operators.index import compact, load_index
    path, _ = _updated(spark, sf_dir)
    compact(spark, path, ["documents"])
    return load_index(spark, path)[0].select("doc_id", "chunk_index", F.posexplode("embedding").alias("bucket", "w")) \
        .filter(F.col("w") > 0) \
        .select("doc_id", "chunk_index", F.col("bucket").cast("int").alias("bucket"), F.col("w").cast("double").alias("weight"))


def rag_answers_ivf(spark, sf_dir):
    """C1 + C2 on a saved cell index: build with trained cells, then answer
    from the index with every cell probed, which must equal the exact run."""
    from ..session import scratch_path
    from .rag import answer_from_index, build_index
    path = scratch_path(spark, "ivf")
    cfg = CFG.with_(index_type="IVFFlat", nlist=16, nprobe=16)
    build_index(spark, _docs(spark, sf_dir), path, cfg)
    return _answer_columns(answer_from_index(spark, _questions(spark, sf_dir), path, cfg))


def index_stats(spark, sf_dir):
    """A13 on a cell-partitioned index written to and read back from the
    shared folder."""
    from ..operators.index import index_stats as stats
    return stats(_saved_cells(spark, sf_dir)[0])


def index_roundtrip(spark, sf_dir):
    """SRC7 + SRC8: every number of every vector after the write and read."""
    idx, _ = _saved_cells(spark, sf_dir)
    return idx.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "label", F.col("pos").cast("int").alias("pos"), F.col("x").cast("double").alias("x"))


def result_json(spark, sf_dir):
    """SRC9: the C2 results written as JSON lines to the shared folder and
    read back with their schema."""
    from ..session import scratch_path
    res = rag_answers(spark, sf_dir)
    path = scratch_path(spark, "results")
    res.write.mode("overwrite").json(path)
    return spark.read.schema(res.schema).json(path)


def pipeline_counters(spark, sf_dir):
    """C1 + A14: build a flat index from every document into the shared
    folder; the observed counters beside the counts of the written index."""
    from ..operators.index import load_index
    from ..session import scratch_path
    from .rag import build_index
    path = scratch_path(spark, "c1")
    seen = build_index(spark, _docs(spark, sf_dir), path, CFG)
    return load_index(spark, path)[0].agg(F.count(F.lit(1)).alias("chunks_written"), F.count("embedding").alias("vectors_written")).select(
        F.lit(seen["documents"]).cast("long").alias("documents"), F.lit(seen["chunks_indexed"]).cast("long").alias("chunks_indexed"),
        F.lit(seen["vectors"]).cast("long").alias("vectors"), "chunks_written", "vectors_written")


def knn_single(spark, sf_dir):
    """One question - the normalised centroid of the whole vector table -
    and its top-k by ``orderBy(score desc).limit(k)`` (TakeOrderedAndProject).
    The question is one vector of ``dim`` numbers, so it enters the plan as
    a literal array: no join."""
    from ..functions.vectors import dot, l2_norm, vector_sum
    e = _emb(spark, sf_dir)
    dim = int(e.select(F.size("embedding")).first()[0])
    c = e.agg(vector_sum("embedding", dim).alias("s"))
    q = c.select(F.transform("s", lambda x: x / l2_norm("s")).alias("q")).first()["q"]
    qv = F.array(*[F.lit(float(x)) for x in q])
    scored = e.select("vec_id", dot(qv, "embedding").alias("score"))
    top = scored.orderBy(F.desc(F.round("score", 12)), "vec_id").limit(CFG.top_k)
    return top.select("vec_id", F.round("score", 6).alias("score"))


# --- streaming -------------------------------------------------------------

def _write_questions(spark, sf_dir, path):
    q = _questions(spark, sf_dir)
    q.select(F.to_json(F.struct("query_id", "question")).alias("value")).write.mode("overwrite").text(path)


def _build_flat_index(spark, sf_dir, cfg, path):
    from ..operators.index import save_index
    return save_index(prepare_chunks(_docs(spark, sf_dir), cfg), path)


def stream_questions(spark, sf_dir):
    """ST1/ST2: the benchmark questions as a JSON message stream answered
    micro-batch by micro-batch; equals the batch C2 result."""
    from ..session import scratch_path
    from ..streaming.questions import answer_stream, write_pointer
    base = scratch_path(spark, "stream")
    _write_questions(spark, sf_dir, base + "/in")
    write_pointer(spark, base + "/pointer", _build_flat_index(spark, sf_dir, CFG, base + "/index"), 1)
    q = answer_stream(spark, base + "/in", base + "/pointer", base + "/out", base + "/ckpt", CFG)
    q.awaitTermination()
    out = spark.read.parquet(base + "/out")
    return out.select("query_id", "answer", "error", "model", "n_sources", "top_score",
                      "chunks_retrieved", "chunks_used", "chunks_in_context")


def stream_once(spark, sf_dir):
    """ST1/ST2 with keyed state: every question is sent three times, twice in
    batches of one run and once after a restart, and answered once."""
    from ..session import scratch_path
    from ..streaming.questions import answer_stream, write_pointer
    base = scratch_path(spark, "once")
    write_pointer(spark, base + "/pointer", _build_flat_index(spark, sf_dir, CFG, base + "/index"), 1)
    for sent in (("a", "b"), ("c",)):
        for name in sent:
            _write_questions(spark, sf_dir, f"{base}/in/{name}")
        answer_stream(spark, base + "/in/*", base + "/pointer", base + "/out", base + "/ckpt", CFG, max_files_per_trigger=1,
                      once_within="7 days").awaitTermination()
    return spark.read.parquet(base + "/out").select("query_id", "answer", "error", "model", "n_sources", "top_score",
                                                    "chunks_retrieved", "chunks_used", "chunks_in_context")


def stream_index_refresh(spark, sf_dir):
    """ST3: the same stream restarted after an index rebuild; the second
    batch sees the new index (version 2, default 512/50 windows)."""
    from ..config import DEFAULT
    from ..session import scratch_path
    from ..streaming.questions import answer_stream, write_pointer
    base = scratch_path(spark, "refresh")
    _write_questions(spark, sf_dir, base + "/in/a")
    write_pointer(spark, base + "/pointer", _build_flat_index(spark, sf_dir, CFG, base + "/v1"), 1)
    answer_stream(spark, base + "/in/*", base + "/pointer", base + "/out", base + "/ckpt", CFG).awaitTermination()
    v2 = CFG.with_(chunk_size=DEFAULT.chunk_size, chunk_overlap=DEFAULT.chunk_overlap)
    write_pointer(spark, base + "/pointer", _build_flat_index(spark, sf_dir, v2, base + "/v2"), 2)
    _write_questions(spark, sf_dir, base + "/in/b")
    answer_stream(spark, base + "/in/*", base + "/pointer", base + "/out", base + "/ckpt", CFG).awaitTermination()
    out = spark.read.parquet(base + "/out")
    return out.select("batch_id", "index_version", "query_id", "chunks_retrieved", "chunks_used", "top_score")


# --- files -----------------------------------------------------------------

FILE_BYTES = 1 << 20
RANGE_BYTES = 1 << 17


def _written_files(spark, sf_dir) -> str:
    """The folder of the documents written as text files, one per source and
    ``FILE_BYTES`` of text (a document that crosses the border ends its file), plus
    a CSV copy of the questions that a scan must skip."""
    from ..session import scratch_path
    from ..sources.logs import running_total
    base = scratch_path(spark, "files") + "/docs"
    d = read_table(spark, sf_dir, "documents")
    # the place of a document's first byte in its source's text, from sizes alone: a
    # running sum over all sources, less what stands before the source (a row a source)
    sizes = d.select("source", "doc_id", (F.octet_length("text") + 1).cast("long").alias("bytes"))
    at = running_total(sizes, F.col("bytes"), "source", "doc_id").withColumn("at", F.col("total") - F.coalesce("bytes", F.lit(0)))
    first = at.groupBy(F.col("source").alias("of")).agg(F.min("at").alias("first"))
    parts = at.join(first, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", F.floor((F.col("at") - F.col("first")) / FILE_BYTES).alias("part"))
    (d.join(parts, "doc_id").select("source", "part", "doc_id", "text").repartition("source", "part")
     .sortWithinPartitions("source", "part", "doc_id").select("source", "part", "text")
     .write.partitionBy("source", "part").text(base))
    read_table(spark, sf_dir, "benchmark").write.csv(base + "/extra_csv")
    return base


def _file_keys() -> list:
    return [F.regexp_extract("filepath", r"source=([^/]+)", 1).alias("source"),
            F.regexp_extract("filepath", r"part=(\d+)", 1).cast("long").alias("part")]


def doc_scan(spark, sf_dir):
    """SRC1-3, SRC6: the documents' files scanned back: one row per file with
    its type, size and a hash of the loaded text."""
    from ..sources.files import load_documents
    docs, bad = load_documents(spark, _written_files(spark, sf_dir))
    return docs.select(
        *_file_keys(), F.regexp_extract("filename", r"\.[a-z]+$", 0).alias("suffix"), "format", "size_bytes",
        F.md5("text").alias("text_md5"))


def doc_ranges(spark, sf_dir):
    """SRC1-3 by bytes: the same files read in ranges of ``RANGE_BYTES`` by the
    data source, and put together again; a file is bounded by ``FILE_BYTES`` and
    the document that crosses it, so a row is too."""
    from ..functions.text import strip
    from ..sources.ranges import load_ranges
    docs, bad = load_ranges(spark, _written_files(spark, sf_dir), "format = '.txt'", rangebytes=RANGE_BYTES)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    got = docs.groupBy("doc_id", "filepath", "format", "size_bytes").agg(
        F.count("*").alias("n_ranges"), F.sum(F.octet_length("text")).alias("range_bytes"),
        F.sum(F.regexp_count("text", F.lit("\n"))).alias("n_lines"), text.alias("text"))
    return got.select(*_file_keys(), "format", "size_bytes", "n_ranges", "range_bytes", "n_lines", F.md5(strip("text")).alias("text_md5"))


def _docx_bytes(df: DataFrame) -> DataFrame:
    """DOCX packages built from each document's lines (one paragraph each), a few
    hundred at a time."""
    import pyarrow as pa
    from ..sources.files import make_docx

    def run(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, 256):
                part = rb.slice(a, 256)
                names = [f"doc-{i}.docx" for i in part.column(0).to_pylist()]
                made = [make_docx((t or "").split("\n")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names), pa.array([".docx"] * len(names)), pa.array(made, pa.binary())],
                                                 names=["filepath", "filename", "format", "content"])
            rb = part = names = made = None     # the next batch is read without this one
    return df.select("doc_id", "text").mapInArrow(
        run, "filepath string, filename string, format string, content binary") \
        .withColumn("size_bytes", F.length("content").cast("long"))


def docx_text(spark, sf_dir):
    """SRC4: DOCX extraction over every document packaged as DOCX."""
    from ..sources.files import split_documents
    docs, _ = split_documents(_docx_bytes(read_table(spark, sf_dir, "documents")))
    return docs.select(F.regexp_extract("doc_id", r"doc-(\d+)", 1).cast("long").alias("doc_id"), "text")


def quarantine(spark, sf_dir):
    """SRC5: every document as bytes, with a byte that no UTF-8 text holds
    appended where the text is not plain ASCII: those are quarantined with
    their error, the others load."""
    from ..sources.files import split_documents
    d = read_table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    raw = F.encode("text", "UTF-8")
    odd = F.octet_length("text") != F.length("text")
    files = d.select(name.alias("filepath"), name.alias("filename"), F.lit(".txt").alias("format"),
                     F.when(odd, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw).alias("content")) \
        .withColumn("size_bytes", F.length("content").cast("long"))
    docs, bad = split_documents(files)
    ok = docs.select("doc_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    q = bad.select("doc_id", F.lit("quarantined").alias("status"), "error")
    return ok.unionByName(q).select(
        F.regexp_extract("doc_id", r"doc-(\d+)", 1).cast("long").alias("doc_id"), "status", "error")


# --- event logs ---------------------------------------------------------------

def event_lines(spark, sf_dir):
    """every event as a log line."""
    from ..sources.logs import event_lines as lines
    return lines(read_table(spark, sf_dir, "events")).select("event_id", "day", "level", "line")


def event_files(spark, sf_dir):
    """SRC12: the log lines written as day directories of bounded files and
    read back."""
    from ..session import scratch_path
    from ..sources.logs import event_lines as lines, write_log_files
    path = write_log_files(lines(read_table(spark, sf_dir, "events")), scratch_path(spark, "logs"), entries_per_file=1000)
    back = spark.read.text(path)
    return back.select(F.col("day").cast("string").alias("day"), F.col("value").alias("line"))


def event_running_total(spark, sf_dir):
    """The running sum of the events' value (in cents) in time order. One
    event in 97 has its time taken away; such rows come last, and count."""
    from ..sources.logs import running_total
    e = read_table(spark, sf_dir, "events")
    e = e.withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    cents = F.round(F.col("value") * 100).cast("long")
    return running_total(e, cents, "ts", "event_id").select("event_id", F.col("total").cast("long").alias("total"))


QUERIES = {
    "clean_whitespace": clean_whitespace,
    "clean_lines": clean_lines,
    "clean_typography": clean_typography,
    "clean_full": clean_full,
    "chunk_windows": chunk_windows,
    "chunk_windows_long": chunk_windows_long,
    "chunk_table": chunk_table,
    "chunk_tokenizer": chunk_tokenizer,
    "chunk_counts": chunk_counts,
    "embed_hashed": embed_hashed,
    "embed_model": embed_model,
    "knn_documents": knn_documents,
    "hit_sources": hit_sources,
    "rag_answers": rag_answers,
    "pipeline_counters": pipeline_counters,
    "knn_single": knn_single,
    "result_json": result_json,
    "context_budget": context_budget,
    "prompt_messages": prompt_messages,
    "chat_render": chat_render,
    "chat_segments": chat_segments,
    "answer_postprocess": answer_postprocess,
    "prompt_defaults": prompt_defaults,
    "text_previews": text_previews,
    "generate_batch": generate_batch,
    "generate_errors": generate_errors,
    "request_validation": request_validation,
    "safety_flags": safety_flags,
    "safety_verdict": safety_verdict,
    "sentence_split": sentence_split,
    "relevance_scores": relevance_scores,
    "chunk_scores": chunk_scores,
    "sources_long": sources_long,
    "sentence_scores": sentence_scores,
    "callable_runs": callable_runs,
    "reliability_callable": reliability_callable,
    "question_report": question_report,
    "reliability_pairs": reliability_pairs,
    "quality_with_runs": quality_with_runs,
    "groundedness_scores": groundedness_scores,
    "reliability_scores": reliability_scores,
    "keyword_accuracy": keyword_accuracy,
    "quality_scores": quality_scores,
    "benchmark_compare": benchmark_compare,
    "demo_summary": demo_summary,
    "benchmark_results": benchmark_results,
    "knn_exact": knn_exact,
    "knn_exact_arrow": knn_exact_arrow,
    "knn_per_query_k": knn_per_query_k,
    "knn_threshold": knn_threshold,
    "ivf_full_probe": ivf_full_probe,
    "ivf_assign": ivf_assign,
    "ivf_probe": ivf_probe,
    "rag_answers_ivf": rag_answers_ivf,
    "ivf_recall": ivf_recall,
    "cell_search": cell_search,
    "cell_search_all": cell_search_all,
    "cell_search_nprobe": cell_search_nprobe,
    "hit_sources_late": hit_sources_late,
    "rag_answers_cells": rag_answers_cells,
    "index_update": index_update,
    "index_update_counts": index_update_counts,
    "index_compacted": index_compacted,
    "index_stats": index_stats,
    "index_roundtrip": index_roundtrip,
    "stream_questions": stream_questions,
    "stream_once": stream_once,
    "stream_index_refresh": stream_index_refresh,
    "doc_scan": doc_scan,
    "doc_ranges": doc_ranges,
    "docx_text": docx_text,
    "quarantine": quarantine,
    "event_lines": event_lines,
    "event_files": event_files,
    "event_running_total": event_running_total,
}
