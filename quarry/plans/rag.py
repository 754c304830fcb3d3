"""Composite pipelines C1 (build the chunk store) and C2 (answer a table of
questions), plus the pieces the evaluators reuse (retrieve, contexts).

C2 plan: validate -> embed questions -> broadcast top-k scan of the chunk
store -> threshold -> running-sum budget -> sections -> messages ->
generation -> left join back so every question (valid or not, with or
without hits) keeps exactly one result row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import prompt as P
from ..operators.chunk import chunk_documents
from ..operators.clean import clean_documents, validate_questions
from ..operators.embed import HashedEmbedder
from ..operators.generate import EXTRACTIVE_MODEL, extractive_answer, generate_with
from ..operators.search import knn
from ..session import checkpoint_dir, remove_path, scratch_path

CHUNK_PAYLOAD = ("filename", "chunk_text", "token_count")


def default_embedder(cfg: Config = DEFAULT):
    return HashedEmbedder(cfg.embedding_dim)


def prepare_chunks(docs: DataFrame, cfg: Config = DEFAULT, embedder=None) -> DataFrame:
    """C1 up to the vectors: clean -> chunk -> embed (one narrow stage plus
    the Arrow embedding step; no shuffle)."""
    cfg.validate()
    embedder = embedder or default_embedder(cfg)
    chunks = chunk_documents(clean_documents(docs), cfg.chunk_size, cfg.chunk_overlap)
    return embedder.embed(chunks, "chunk_text", "embedding")


def embed_questions(questions: DataFrame, cfg: Config = DEFAULT, embedder=None) -> DataFrame:
    embedder = embedder or default_embedder(cfg)
    return embedder.embed(questions, "question", "embedding")


def retrieve(questions: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT,
             embedder=None, k: int | None = None, per_query_k: str | None = None,
             payload=CHUNK_PAYLOAD, keys=("doc_id", "chunk_index"), key: str = "query_id",
             centroids: DataFrame | None = None) -> DataFrame:
    """Embed the questions and return their top-k hits (T1/T3) with the
    chunk payload carried through the scan (J5 without a second scan). With
    ``centroids`` only each question's ``cfg.nprobe`` best cells are searched
    (J4). ``key`` must be unique; the hits carry it as ``query_id``."""
    qv = embed_questions(questions.select(key, "question", *([per_query_k] if per_query_k else [])), cfg, embedder)
    return knn(qv, chunks, k or cfg.top_k, query_key=key, corpus_keys=keys,
               payload=payload, per_query_k=per_query_k, cell_col="cell" if centroids is not None else None,
               centroids=centroids, nprobe=cfg.nprobe, broadcast_limit_bytes=cfg.broadcast_limit_bytes)


def answer_from_index(spark, questions: DataFrame, index_path: str, cfg: Config = DEFAULT, embedder=None,
                      generator=None) -> DataFrame:
    """C2 against a saved index (its newest version): a cell index is searched
    in ``cfg.nprobe`` cells per question, a flat one exactly."""
    from ..operators.index import load_index
    chunks, centroids = load_index(spark, index_path)
    return answer_questions(questions, chunks, cfg, embedder, generator, centroids=centroids)


def answer_questions(questions: DataFrame, chunks: DataFrame | None, cfg: Config = DEFAULT,
                     embedder=None, generator=None, hits: DataFrame | None = None,
                     centroids: DataFrame | None = None) -> DataFrame:
    """C2 for a whole table of questions (``query_id, question[, top_k]``).

    Every row is a question of its own: rows get a key here, and the caller's
    ``query_id`` (null or repeated or missing) is only passed through. Hits
    computed before (``hits``, by a unique ``query_id``) may be given.

    Output per question: ``query_id, question, error, answer, sources,
    scores, chunks_retrieved, chunks_used, chunks_in_context, model,
    llm_usage``. ``chunks_used`` counts threshold survivors including those
    cut by the budget (S17); ``chunks_in_context`` is the number actually in
    the prompt."""
    if "query_id" not in questions.columns:
        questions = questions.withColumn("query_id", F.lit(None).cast("bigint"))
    v = validate_questions(questions, cfg.top_k, cfg.max_top_k, cfg.max_question_chars)
    if hits is None:
        checkpoint_dir(questions.sparkSession)
        v = v.select("query_id", "question", "k", "error").withColumn(
            "__q", F.monotonically_increasing_id()).checkpoint()
        hits = retrieve(v.filter(F.col("error").isNull()), chunks, cfg, embedder, per_query_k="k", key="__q",
                        centroids=centroids)
    else:
        v = v.select("query_id", "question", "k", "error").withColumn("__q", F.col("query_id"))
    per_q = summarize_hits(hits, cfg).withColumnRenamed("query_id", "__q")
    joined = v.join(per_q, "__q", "left")
    no_hit = F.coalesce(F.col("chunks_used"), F.lit(0)) == 0
    has_ctx = F.coalesce(F.col("chunks_in_context"), F.lit(0)) > 0
    usage = F.lit(None).cast("map<string,int>")
    if generator is None:
        joined = joined.withColumn(
            "__answer", F.when(has_ctx, extractive_answer(F.col("context_texts"), F.col("question"))))
        joined = joined.withColumn("__model", F.when(has_ctx, F.lit(EXTRACTIVE_MODEL))) \
            .withColumn("__gen_error", F.lit(None).cast("string")).withColumn("__usage", usage)
    else:
        prompts = joined.filter(F.col("error").isNull() & ~no_hit) \
            .select("__q", P.messages(F.col("context"), F.col("question")).alias("messages"))
        gen = generate_with(prompts, generator).select(
            "__q", F.col("answer").alias("__answer"), F.col("model").alias("__model"),
            F.col("error").alias("__gen_error"), F.col("usage").alias("__usage"))
        joined = joined.join(gen, "__q", "left")
    sources_type = per_q.schema["sources"].dataType
    silent = no_hit | F.col("error").isNotNull()
    return joined.select(
        "query_id", "question",
        F.coalesce("error", "__gen_error").alias("error"),
        F.when(F.col("error").isNotNull(), F.lit(None))
         .when(no_hit, F.lit(P.NO_HIT_ANSWER))
         .otherwise(F.coalesce("__answer", F.lit(""))).alias("answer"),
        F.coalesce("sources", F.array().cast(sources_type)).alias("sources"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
        F.coalesce("chunks_retrieved", F.lit(0)).alias("chunks_retrieved"),
        F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"),
        F.coalesce("chunks_in_context", F.lit(0)).alias("chunks_in_context"),
        F.when(silent, F.lit(None)).otherwise(F.col("__model")).alias("model"),
        F.when(silent, F.lit(None)).otherwise(F.col("__usage")).alias("llm_usage"))


def answer_without_context(questions: DataFrame, generator=None) -> DataFrame:
    """The baseline of C8: the same generator asked without passages
    (``query_id, question, answer, model``). The built-in generator can only
    quote passages, so it says that it has none."""
    if generator is None:
        return questions.select("query_id", "question", F.lit(P.NO_CONTEXT_ANSWER).alias("answer"),
                                F.lit(EXTRACTIVE_MODEL).alias("model"))
    asked = questions.select("query_id", "question", P.no_context_messages(F.col("question")).alias("messages"))
    return generate_with(asked, generator).select("query_id", "question", "answer", "model")


def in_context(hits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The hits with ``passed`` (threshold), ``running_tokens`` and
    ``in_context`` (W2). Threshold survivors are a prefix of the rank order,
    so the running sum over them is a running sum over the ranked hits."""
    passed = F.col("score") >= F.lit(cfg.similarity_threshold)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = hits.withColumn("passed", passed).withColumn("running_tokens", F.sum(
        F.when(passed, F.coalesce(F.col("token_count"), F.lit(0))).otherwise(F.lit(0))).over(w))
    return h.withColumn("in_context", F.col("passed") & (F.col("running_tokens") <= F.lit(cfg.max_context_tokens)))


def context_texts(where: Column) -> Column:
    """Aggregate: the chunk texts of the rows that meet a condition, by rank."""
    part = F.when(where, F.struct(F.col("rank"), F.col("chunk_text").alias("t")))
    return F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])


def summarize_hits(hits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Everything C2 needs per question from its hits in one pass: a
    running-sum window and one aggregate, both partitioned by ``query_id``
    (the aggregate reuses the window's partitioning, so one shuffle; a group
    holds the question's k hits)."""
    from ..functions.text import preview
    h = in_context(hits, cfg)
    src = F.when(F.col("passed"), F.struct(
        F.col("rank"), F.coalesce(F.col("filename"), F.lit(P.MISSING_SOURCE)).alias("filename"),
        F.col("chunk_index"), F.round("score", 4).alias("score"),
        preview("chunk_text").alias("preview")))
    sec = F.when(F.col("in_context"), F.struct(F.col("rank"), P.section("filename", "chunk_index", "score",
                                                                       "chunk_text").alias("s")))
    agg = h.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunks_retrieved"),
        F.count_if("passed").cast("int").alias("chunks_used"),
        F.array_sort(F.collect_list(src)).alias("__src"),
        F.array_sort(F.collect_list(sec)).alias("__sec"),
        F.count_if("in_context").cast("int").alias("chunks_in_context"),
        F.max(F.when(F.col("in_context"), F.col("running_tokens"))).cast("int").alias("context_tokens"),
        context_texts(F.col("in_context")).alias("context_texts"))
    return agg.select(
        "query_id", "chunks_retrieved", "chunks_used", "chunks_in_context", "context_tokens",
        F.transform("__src", lambda x: x.dropFields("rank")).alias("sources"),
        F.transform("__src", lambda x: x["score"]).alias("scores"),
        F.array_join(F.transform("__sec", lambda x: x["s"]), P.SECTION_SEPARATOR).alias("context"),
        "context_texts")


def build_index(spark, source, save_path: str, cfg: Config = DEFAULT, embedder=None) -> dict:
    """C1 (``POST /index``): documents (a directory of files or a documents
    DataFrame) -> clean -> chunk -> embed -> [cells] -> Parquet index.

    Counters (A14) are collected with ``DataFrame.observe`` on the write
    itself, so they cost no extra pass: documents loaded, chunks created,
    vectors written. Raises on a missing directory and on an empty input
    (S9). Returns ``{chunks_indexed, documents, vectors, index_path,
    cells}``."""
    from pyspark.sql import Observation

    from ..operators.index import assign_cells, save_index, train_cells
    from ..sources.files import load_documents

    if isinstance(source, str):
        docs, _quarantine = load_documents(spark, source)
    else:
        docs = source
    if docs.isEmpty():
        raise ValueError("no documents to index")
    obs_docs, obs_chunks = Observation("documents"), Observation("chunks")
    docs = docs.observe(obs_docs, F.count(F.lit(1)).alias("documents"))
    chunks = prepare_chunks(docs, cfg, embedder).observe(
        obs_chunks, F.count(F.lit(1)).alias("chunks"),
        F.count("embedding").alias("vectors"))
    cells = None
    if cfg.index_type == "IVFFlat":
        # the vectors are needed twice (training, then assignment): staged as
        # Parquet, so that training reads the vector column only
        staged = scratch_path(spark, "chunks")
        chunks.write.parquet(staged)
        chunks = spark.read.parquet(staged)
        cents = train_cells(chunks, cfg.nlist, seed=cfg.kmeans_seed, max_iter=cfg.kmeans_max_iter)
        chunks = assign_cells(chunks, cents, broadcast_limit_bytes=cfg.broadcast_limit_bytes)
        save_index(chunks, save_path, cents)
        cells = cents.count()
        remove_path(spark, staged)
    else:
        save_index(chunks, save_path)
    c = obs_chunks.get
    return {"chunks_indexed": int(c.get("chunks", 0)), "documents": int(obs_docs.get.get("documents", 0)),
            "vectors": int(c.get("vectors", 0)), "index_path": save_path, "cells": cells}


def update_index(spark, docs: DataFrame, save_path: str, cfg: Config = DEFAULT, embedder=None) -> dict:
    """C1 + A14 step by step: brings an index to the state of ``docs`` (whole
    table, ``doc_id`` unique and not null), doing only what changed since the
    last call.

    A table of documents (id, digest of all columns) stands beside the index
    rows. Joined with ``docs`` it tells which documents are new, changed or
    deleted; only new and changed ones are cleaned and chunked. Chunks carry a
    digest of their text: a vector that the index holds is taken from it (only
    digest and vector columns are read), and of the others each different text
    is embedded once: in its row while it is written, if no other chunk has it,
    so that it is not shuffled to its vector. The result goes to the index as a delta; the first call
    builds the base, and compares with nothing. Ids and digests that are few
    (``cfg.broadcast_limit_bytes``) are broadcast, so that neither the documents'
    texts nor the index's vectors are shuffled to meet them. Returns the counters
    of the call."""
    from ..operators.index import KEY_BYTES, append_delta, load_index, load_table, manifest, save_index
    embedder = embedder or default_embedder(cfg)
    cfg.validate()
    m = manifest(spark, save_path)
    digest = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    state = docs.select("doc_id", digest.alias("digest"))
    if m:
        had = load_table(spark, save_path, m, "documents").select("doc_id", F.col("digest").alias("old"))
        state = state.join(had, "doc_id", "full_outer").select(
            "doc_id", "digest", F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "deleted")
            .when(F.col("digest") != F.col("old"), "changed").otherwise("same").alias("state"))
    else:
        state = state.withColumn("state", F.lit("new"))
    checkpoint_dir(spark)
    state = state.checkpoint()
    seen = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    todo = state.where("state IN ('new', 'changed')").select("doc_id", "digest")

    def few(keys: DataFrame, n: int) -> DataFrame:
        return F.broadcast(keys) if n * KEY_BYTES <= cfg.broadcast_limit_bytes else keys

    if m:
        picked = docs.join(few(todo.select("doc_id"), seen.get("new", 0) + seen.get("changed", 0)), "doc_id", "left_semi")
    else:
        picked = docs.where(F.col("doc_id").isNotNull())
    made = chunk_documents(clean_documents(picked), cfg.chunk_size, cfg.chunk_overlap)
    staged, vectors, shared = (scratch_path(spark, f"update-{name}") for name in ("chunks", "vectors", "shared"))
    made.withColumn("chunk_hash", F.md5("chunk_text")).write.parquet(staged)
    chunks = spark.read.parquet(staged)
    n_chunks = chunks.count()
    # texts that several chunks have, or that the index knows, take their vector from a table
    chunks.groupBy("chunk_hash").count().where("count > 1").select("chunk_hash").write.parquet(shared)
    if m:
        index = load_index(spark, save_path)[0].select("chunk_hash", "embedding")
        wanted = few(chunks.select("chunk_hash").distinct(), n_chunks)
        known = index.join(wanted, "chunk_hash", "left_semi").groupBy("chunk_hash").agg(F.first("embedding").alias("embedding"))
        known.withColumn("embedded", F.lit(False)).write.parquet(vectors)
        spark.read.parquet(vectors).select("chunk_hash").write.mode("append").parquet(shared)
    hashes = spark.read.parquet(shared)
    n_shared, common, alone = hashes.count(), chunks, None
    # a cell index is written by ranges, which computes its rows twice
    if n_shared * KEY_BYTES <= cfg.broadcast_limit_bytes and not (m and m["type"] == "IVFFlat"):
        common = chunks.join(F.broadcast(hashes), "chunk_hash", "left_semi")
        alone = chunks.join(F.broadcast(hashes), "chunk_hash", "left_anti")
    texts = common.groupBy("chunk_hash").agg(F.first("chunk_text").alias("chunk_text"))
    if m:
        texts = texts.join(spark.read.parquet(vectors).select("chunk_hash"), "chunk_hash", "left_anti")
    embedder.embed(texts, "chunk_text", "embedding").select("chunk_hash", "embedding", F.lit(True).alias("embedded")).write.mode("append").parquet(vectors)
    vecs = spark.read.parquet(vectors)
    rows = common.join(vecs.drop("embedded"), "chunk_hash")
    embedded = vecs.where("embedded").count()
    if alone is not None:
        rows = rows.unionByName(embedder.embed(alone, "chunk_text", "embedding"))
        embedded += alone.count()
    if m is None:
        save_index(rows, save_path, extra={"documents": todo})
    elif seen.get("new", 0) + seen.get("changed", 0) + seen.get("deleted", 0):
        append_delta(spark, save_path, rows, state.where("state IN ('changed', 'deleted')").select("doc_id"), {"documents": todo})
    out = {"new": seen.get("new", 0), "changed": seen.get("changed", 0), "deleted": seen.get("deleted", 0), "unchanged": seen.get("same", 0),
           "chunks_made": n_chunks, "chunks_embedded": embedded, "version": manifest(spark, save_path)["version"]}
    for path in (staged, vectors, shared):
        remove_path(spark, path)
    return out
