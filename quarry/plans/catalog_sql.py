"""DuckDB oracle SQL for the registered queries (see ``catalog``)."""
from __future__ import annotations

from . import oracle as O
from .catalog import CFG, inject_sql

STEP = CFG.chunk_size - CFG.chunk_overlap
DIM = CFG.embedding_dim


def _injected() -> str:
    return f"inj AS (SELECT doc_id, {inject_sql()} AS raw FROM documents)"


def _corpus_ctes() -> str:
    return ",\n".join([
        O.docs_cte(True),
        O.chunks_cte(CFG),
        O.weights_cte("cw", "chunks", "doc_id, chunk_index", "chunk_text", DIM),
        "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)",
        O.weights_cte("qw", "questions", "query_id", "question", DIM),
    ])


SQL: dict[str, str] = {}

SQL["clean_whitespace"] = f"WITH {_injected()} SELECT doc_id, {O.normalize_ws('raw')} AS text FROM inj"
SQL["clean_lines"] = f"WITH {_injected()} SELECT doc_id, {O.drop_lines('raw')} AS text FROM inj"
SQL["clean_typography"] = f"WITH {_injected()} SELECT doc_id, {O.fix_chars('raw')} AS text FROM inj"
SQL["clean_full"] = f"WITH {_injected()} SELECT doc_id, {O.clean('raw')} AS text FROM inj"

SQL["chunk_windows"] = f"""WITH {O.docs_cte(True)}, {O.chunks_cte(CFG)}
SELECT doc_id, chunk_index, token_count, chunk_text FROM chunks"""

SQL["chunk_windows_long"] = SQL["chunk_table"] = SQL["chunk_windows"]

def _tokenizer_sql() -> str:
    from .catalog import CharRuns
    chunks = O.chunks_cte(CFG).replace("'\\s*\\S+'", f"'{CharRuns.PATTERN}'")
    return f"WITH {O.docs_cte(True)}, {chunks} SELECT doc_id, chunk_index, token_count, chunk_text FROM chunks"


SQL["chunk_tokenizer"] = _tokenizer_sql()

SQL["chunk_counts"] = f"""WITH {O.docs_cte(True)}, {O.chunks_cte(CFG)},
made AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id)
SELECT d.doc_id, CAST(len(regexp_extract_all(d.text, '\\s*\\S+')) AS BIGINT) AS n_tokens,
       CAST(ceil(len(regexp_extract_all(d.text, '\\s*\\S+')) / {STEP}) AS BIGINT) AS expected,
       CAST(coalesce(m.n_chunks, 0) AS BIGINT) AS n_chunks
FROM docs d LEFT JOIN made m USING (doc_id)"""

SQL["embed_hashed"] = f"""WITH {_corpus_ctes()}
SELECT doc_id, chunk_index, bucket, weight FROM cw"""


def _letters_sql() -> str:
    from .catalog import LetterModel
    return f"""WITH {O.docs_cte(True)}, {O.chunks_cte(CFG)},
l AS (SELECT unnest(range({len(LetterModel.LETTERS)})) AS bucket, unnest(string_split('{LetterModel.LETTERS}', '')) AS c),
n AS (SELECT doc_id, chunk_index, CAST(bucket AS INTEGER) AS bucket, length(chunk_text) - length(replace(chunk_text, c, '')) AS n FROM chunks, l)
SELECT doc_id, chunk_index, bucket, CAST(CAST(n / sqrt(s) AS FLOAT) AS DOUBLE) AS weight
FROM (SELECT *, sum(n * n) OVER (PARTITION BY doc_id, chunk_index) AS s FROM n) WHERE n > 0"""


SQL["embed_model"] = _letters_sql()

SQL["index_update"] = SQL["chunk_windows"]
SQL["index_compacted"] = SQL["embed_hashed"]
SQL["index_update_counts"] = f"""WITH {O.docs_cte(True)}, {O.chunks_cte(CFG)},
earlier AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN text || ' As it was.' ELSE text END AS text FROM documents),
docs1 AS (SELECT doc_id, {O.clean('text')} AS text, '' AS filename FROM earlier), {O.chunks_cte(CFG, 'docs1').replace('chunks AS', 'chunks1 AS', 1)},
made AS (SELECT c.chunk_text FROM chunks c JOIN documents d USING (doc_id) WHERE d.doc_id % 100 = 1 OR d.doc_id % 100 = 0 AND d.text IS NOT NULL)
SELECT count(*) FILTER (doc_id % 100 = 1) AS new, count(*) FILTER (doc_id % 100 = 0 AND text IS NOT NULL) AS changed,
       count(*) FILTER (doc_id % 100 = 1) AS deleted,
       count(*) FILTER (doc_id % 100 > 1 OR doc_id % 100 = 0 AND text IS NULL) AS unchanged,
       (SELECT count(*) FROM made) AS chunks_made,
       (SELECT count(DISTINCT chunk_text) FROM made WHERE chunk_text NOT IN (SELECT chunk_text FROM chunks1)) AS chunks_embedded
FROM documents"""

SQL["knn_documents"] = f"""WITH {_corpus_ctes()}, {O.knn_cte(CFG, str(CFG.top_k))}
SELECT query_id, rank, doc_id, chunk_index, round(score, 6) AS score FROM hits"""

SQL["hit_sources"] = f"""WITH {_corpus_ctes()}, {O.knn_cte(CFG, str(CFG.top_k))}
SELECT h.query_id, h.rank, c.filename, h.chunk_index, round(h.score, 4) AS score,
       substring(c.chunk_text, 1, 150) || '...' AS preview
FROM hits h JOIN chunks c USING (doc_id, chunk_index)
WHERE h.score >= {CFG.similarity_threshold}"""


def _hits_ctes() -> str:
    return f"""{_corpus_ctes()}, {O.knn_cte(CFG, str(CFG.top_k))},
hx AS (
  SELECT h.query_id, h.rank, h.doc_id, h.chunk_index, h.score, c.filename, c.token_count, c.chunk_text
  FROM hits h JOIN chunks c USING (doc_id, chunk_index)),
passed AS (
  SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_tokens
  FROM hx WHERE score >= {CFG.similarity_threshold})"""


def _rag_ctes() -> str:
    from ..functions import prompt as P
    b = CFG.max_context_tokens
    return f"""{_hits_ctes()},
cnt AS (
  SELECT query_id, CAST(count(*) AS INTEGER) AS chunks_retrieved,
         CAST(count(*) FILTER (WHERE score >= {CFG.similarity_threshold}) AS INTEGER) AS chunks_used
  FROM hx GROUP BY query_id),
ctx AS (
  SELECT query_id, CAST(count(*) AS INTEGER) AS chunks_in_context, list(chunk_text ORDER BY rank) AS texts
  FROM passed WHERE running_tokens <= {b} GROUP BY query_id),
ctxq AS (SELECT query_id, question, texts FROM ctx JOIN questions USING (query_id)),
{O.answers_cte("ext", "ctxq", "query_id")},
src AS (
  SELECT query_id, CAST(count(*) AS INTEGER) AS n_sources, arg_min(round(score, 4), rank) AS top_score
  FROM passed GROUP BY query_id),
rag AS (
  SELECT q.query_id, q.question,
         CASE WHEN coalesce(cnt.chunks_used, 0) = 0 THEN {O.lit(P.NO_HIT_ANSWER)}
              ELSE coalesce(ext.answer, '') END AS answer,
         CAST(NULL AS VARCHAR) AS error,
         CASE WHEN coalesce(cnt.chunks_used, 0) = 0 OR ctx.query_id IS NULL THEN NULL
              ELSE 'extractive' END AS model,
         coalesce(src.n_sources, 0) AS n_sources, src.top_score,
         coalesce(cnt.chunks_retrieved, 0) AS chunks_retrieved,
         coalesce(cnt.chunks_used, 0) AS chunks_used,
         coalesce(ctx.chunks_in_context, 0) AS chunks_in_context
  FROM questions q LEFT JOIN cnt USING (query_id) LEFT JOIN src USING (query_id)
       LEFT JOIN ctx USING (query_id) LEFT JOIN ext USING (query_id))"""


SQL["rag_answers"] = f"""WITH {_rag_ctes()}
SELECT query_id, answer, error, model, n_sources, top_score, chunks_retrieved, chunks_used,
       chunks_in_context FROM rag"""

SQL["context_budget"] = f"""WITH {_hits_ctes()}
SELECT query_id, rank, token_count, CAST(running_tokens AS BIGINT) AS running_tokens,
       running_tokens <= {CFG.max_context_tokens} AS in_context FROM passed"""


def _prompt_sql() -> str:
    from ..functions import prompt as P
    sec = O.section("filename", "chunk_index", "score", "chunk_text")
    return f"""WITH {_hits_ctes()},
ctxb AS (
  SELECT query_id, string_agg({sec}, chr(10) || chr(10) ORDER BY rank) AS context,
         CAST(count(*) AS INTEGER) AS chunks_in_context, CAST(max(running_tokens) AS INTEGER) AS context_tokens
  FROM passed WHERE running_tokens <= {CFG.max_context_tokens} GROUP BY query_id)
SELECT query_id, {O.lit(P.SYSTEM_PROMPT)} AS system_message,
       {O.lit(P.QUESTION_HEAD)} || question || {O.lit(P.PASSAGES_HEAD)} || context AS user_message,
       chunks_in_context, context_tokens
FROM questions JOIN ctxb USING (query_id)"""


SQL["prompt_messages"] = _prompt_sql()

SQL["chat_render"] = """SELECT conv_id,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '</s>', chr(10) ORDER BY turn)
           FILTER (WHERE role IN ('system', 'user', 'assistant')) || chr(10), '') || '<|assistant|>' AS prompt
FROM conversations GROUP BY conv_id"""

SQL["chat_segments"] = """SELECT conv_id, turn, '<|' || role || '|>' || chr(10) || coalesce(text, '') || '</s>' AS seg
FROM conversations WHERE role IN ('system', 'user', 'assistant')"""

SQL["callable_runs"] = f"""SELECT query_id, CAST(run AS INTEGER) AS run, substring(user_message, 1, 120) AS answer
FROM ({SQL["prompt_messages"]}), range({CFG.reliability_runs}) t(run)"""

#: equal answers agree wholly
SQL["reliability_callable"] = f"""SELECT query_id, 1.0::DOUBLE AS mean_consistency, 1.0::DOUBLE AS min_consistency, 0.0::DOUBLE AS std_consistency,
  0.0::DOUBLE AS length_coefficient_of_variation, count(*) AS num_runs, true AS is_reliable
FROM ({SQL["callable_runs"]}) GROUP BY query_id"""

SQL["answer_postprocess"] = f"""WITH g AS (
  SELECT conv_id, turn, '<|' || role || '|>' || chr(10) AS p,
         CASE WHEN turn % 2 = 0 THEN '<|' || role || '|>' || chr(10) ELSE '' END || text
         || chr(10) || chr(10) || '---' || chr(10) || 'notes for turn ' || CAST(turn AS VARCHAR) AS g
  FROM conversations)
SELECT conv_id, turn,
       {O.strip("split_part(" + O.strip("CASE WHEN starts_with(g, p) THEN substring(g, length(p) + 1) ELSE g END") + ", chr(10) || chr(10) || '---', 1)")} AS answer
FROM g"""

SQL["prompt_defaults"] = f"""SELECT doc_id, {O.section(
    "CASE WHEN doc_id % 3 <> 0 THEN 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' END", "CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END",
    "doc_id % 1000 / 1000", "text")} AS section FROM documents"""

SQL["text_previews"] = """SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS ellipsized,
       substring(text, 1, 150) || '...' AS preview, substring(text, 1, 200) AS truncated FROM documents"""

SQL["generate_batch"] = """SELECT conv_id, turn, array_to_string(list_reverse(w), ' ') AS answer, CAST(len(w) AS INTEGER) AS words,
       'reverse' AS model, CAST(NULL AS VARCHAR) AS error
FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations)"""

SQL["generate_errors"] = """SELECT conv_id, turn, CASE WHEN bad THEN 'Error: refused: ' || substring(t, 1, 20) ELSE substring(t, 1, 40) END AS answer,
       CASE WHEN bad THEN 0 ELSE 1 END AS n_usage, 'picky' AS model, CASE WHEN bad THEN 'refused: ' || substring(t, 1, 20) END AS error
FROM (SELECT conv_id, turn, coalesce(text, '') AS t, contains(coalesce(text, ''), '?') OR coalesce(text, '') = '' AS bad FROM conversations)"""

SQL["request_validation"] = f"""WITH r AS (
  SELECT conv_id, turn, text AS question,
         CAST(coalesce(CASE WHEN role = 'system' THEN NULL ELSE turn * 4 - 1 END, {CFG.top_k}) AS INTEGER) AS k
  FROM conversations)
SELECT conv_id, turn, k,
  CASE WHEN question IS NULL OR length(question) < 1 THEN 'question must not be empty'
       WHEN length(question) > {CFG.max_question_chars} THEN 'question longer than {CFG.max_question_chars} characters'
       WHEN k < 1 OR k > {CFG.max_top_k} THEN 'top_k must be between 1 and {CFG.max_top_k}' END AS error
FROM r"""

SQL["safety_flags"] = f"""WITH {O.safety_cte("s", "documents", "doc_id", "text")}
SELECT doc_id, risk_level IN ('none', 'low') AS is_safe, risk_level, total_flags, categories FROM s"""


def _verdict_sql() -> str:
    from .catalog import SAFETY_SUFFIX
    case = "CASE " + " ".join(f"WHEN role = '{r}' THEN {O.lit(v)}" for r, v in SAFETY_SUFFIX.items()) + " ELSE '' END"
    return f"""WITH c AS (SELECT conv_id, turn, text || {case} AS answer FROM conversations),
{O.safety_cte("s", "c", "conv_id, turn", "answer")}
SELECT conv_id, turn, risk_level IN ('none', 'low') AS is_safe, risk_level, total_flags, categories FROM s"""


SQL["safety_verdict"] = _verdict_sql()

SQL["sentence_split"] = f"""WITH s AS (SELECT doc_id, {O.split_sentences('text')} AS s FROM documents)
SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_idx, unnest(s) AS sentence FROM s"""

SQL["relevance_scores"] = f"""WITH {_hits_ctes()}
SELECT query_id, coalesce(round(avg(score), 4), 0.0) AS mean_score,
       CAST(count(*) FILTER (WHERE score >= {CFG.relevance_threshold}) AS INTEGER) AS above_threshold,
       CASE WHEN count(score) = 0 THEN 0.0
            ELSE round(count(*) FILTER (WHERE score >= {CFG.relevance_threshold}) / count(score), 4) END AS precision_at_k
FROM questions LEFT JOIN hx USING (query_id) GROUP BY query_id"""

SQL["chunk_scores"] = f"""WITH {_hits_ctes()}
SELECT query_id, rank, chunk_index, filename, round(score, 4) AS search_score, round(score, 4) AS cosine_similarity,
       score >= {CFG.relevance_threshold} AS is_relevant FROM hx"""

SQL["sources_long"] = f"""WITH {_hits_ctes()}
SELECT query_id, CAST(rank - 1 AS INTEGER) AS pos, filename, chunk_index, round(score, 4) AS source_score,
       round(score, 4) AS score, substring(chunk_text, 1, 150) || '...' AS preview FROM passed"""


def _ground_ctes(answers: str, name: str = "gr") -> str:
    """Groundedness of ``answers(query_id, answer)`` against ``hits``."""
    t = CFG.groundedness_threshold
    return f"""{name}_s AS (
  SELECT query_id, unnest(range(len(s))) AS sentence_idx, unnest(s) AS sentence
  FROM (SELECT query_id, {O.split_sentences('answer')} AS s FROM {answers})),
{O.weights_cte(name + "_w", name + "_s", "query_id, sentence_idx", "sentence", DIM)},
{name}_sim AS (
  SELECT w.query_id, w.sentence_idx, h.rank, sum(w.weight * c.weight) AS sim
  FROM {name}_w w JOIN hits h USING (query_id)
       JOIN cw c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index AND c.bucket = w.bucket
  GROUP BY ALL),
{name}_ps AS (
  SELECT s.query_id, s.sentence_idx, any_value(s.sentence) AS sentence, max(coalesce(x.sim, 0)) AS max_sim,
         CAST(arg_max(h.rank, round(coalesce(x.sim, 0), 12) * 1e6 - h.rank * 1e-7) - 1 AS INTEGER) AS best
  FROM {name}_s s JOIN hits h USING (query_id)
       LEFT JOIN {name}_sim x ON x.query_id = s.query_id AND x.sentence_idx = s.sentence_idx AND x.rank = h.rank
  GROUP BY ALL),
{name}_agg AS (
  SELECT query_id, CAST(count(*) FILTER (WHERE max_sim >= {t}) AS INTEGER) AS g, CAST(count(*) AS INTEGER) AS n
  FROM {name}_ps GROUP BY query_id),
{name} AS (
  SELECT a.query_id,
         CASE WHEN hq.query_id IS NULL THEN 0.0 ELSE coalesce(round(g / n, 4), 0.0) END AS overall_score,
         hq.query_id IS NOT NULL AND n IS NOT NULL AND g / n >= {t} AS is_grounded,
         CASE WHEN hq.query_id IS NULL THEN 0 ELSE coalesce(g, 0) END AS grounded_sentences,
         CASE WHEN hq.query_id IS NULL THEN 0 ELSE coalesce(n, 0) END AS total_sentences
  FROM {answers} a LEFT JOIN {name}_agg USING (query_id)
       LEFT JOIN (SELECT DISTINCT query_id FROM hits) hq ON hq.query_id = a.query_id)"""


SQL["groundedness_scores"] = f"""WITH {_hits_ctes()},
ans AS (SELECT query_id, question AS answer FROM questions),
{_ground_ctes("ans")}
SELECT query_id, overall_score, is_grounded, grounded_sentences, total_sentences FROM gr"""


SQL["sentence_scores"] = f"""WITH {_hits_ctes()},
ans AS (SELECT query_id, question AS answer FROM questions),
{_ground_ctes("ans")}
SELECT query_id, CAST(sentence_idx AS INTEGER) AS sentence_idx, sentence, round(max_sim, 4) AS max_similarity,
       best AS best_matching_chunk, max_sim >= {CFG.groundedness_threshold} AS is_grounded FROM gr_ps"""


def _run_ctes() -> str:
    return f"""rsec AS (
  SELECT query_id, run, chunk_text, rank FROM passed, (SELECT unnest(range({CFG.reliability_runs})) AS run)
  WHERE running_tokens <= {CFG.max_context_tokens}),
rtext AS (
  SELECT query_id, CAST(run AS INTEGER) AS run, question,
         coalesce(list(chunk_text ORDER BY rank) FILTER (WHERE rank > run), []) AS texts
  FROM rsec JOIN questions USING (query_id) GROUP BY ALL),
{O.answers_cte("runs", "rtext", "query_id, run")}"""


def _reliability_ctes() -> str:
    return f"""{_run_ctes()},
{O.weights_cte("aw", "runs", "query_id, run", "answer", DIM)},
pr AS (SELECT a.query_id, a.run AS ra, b.run AS rb FROM runs a JOIN runs b
       ON a.query_id = b.query_id AND a.run < b.run),
ps AS (SELECT x.query_id, x.run AS ra, y.run AS rb, sum(x.weight * y.weight) AS sim
       FROM aw x JOIN aw y ON x.query_id = y.query_id AND x.run < y.run AND x.bucket = y.bucket
       GROUP BY ALL),
pp AS (SELECT pr.query_id, coalesce(ps.sim, 0) AS sim FROM pr LEFT JOIN ps USING (query_id, ra, rb)),
pst AS (SELECT query_id, avg(sim) AS m, min(sim) AS mn, stddev_pop(sim) AS sd FROM pp GROUP BY query_id),
lst AS (SELECT query_id, CAST(count(*) AS INTEGER) AS num_runs, stddev_pop(words) AS sw, avg(words) AS aw
        FROM (SELECT query_id, len(regexp_extract_all(answer, '\\S+')) AS words FROM runs) GROUP BY query_id),
rely AS (
SELECT l.query_id, round(coalesce(m, 0), 4) AS mean_consistency, round(coalesce(mn, 0), 4) AS min_consistency,
       round(coalesce(sd, 0), 4) AS std_consistency,
       round(CASE WHEN aw > 0 THEN sw / aw ELSE 0 END, 4) AS length_coefficient_of_variation,
       num_runs,
       coalesce(m, 0) >= 0.75 AND CASE WHEN aw > 0 THEN sw / aw ELSE 0 END <= 0.5 AS is_reliable
FROM lst l LEFT JOIN pst USING (query_id))"""



SQL["reliability_scores"] = f"WITH {_hits_ctes()}, {_reliability_ctes()} SELECT * FROM rely"
SQL["reliability_pairs"] = f"""WITH {_hits_ctes()}, {_reliability_ctes()}
SELECT pr.query_id, pr.ra, pr.rb, round(coalesce(sim, 0), 4) AS similarity FROM pr LEFT JOIN ps USING (query_id, ra, rb)"""

KW = "list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'))"


def _kacc(answer: str, kw: str = "kw") -> str:
    return (f"CASE WHEN len({kw}) > 0 THEN len(list_filter({kw}, lambda k: contains(lower({answer}), lower(k))))"
            f" / len({kw}) ELSE 0.0 END")


SQL["keyword_accuracy"] = f"""WITH {_rag_ctes()},
k AS (SELECT query_id, answer, {KW} AS kw FROM rag)
SELECT query_id, CAST(len(kw) AS INTEGER) AS n_keywords, round({_kacc('answer')}, 4) AS keyword_accuracy FROM k"""


def _quality_ctes(runs: bool = False) -> str:
    rely = "coalesce(rely.mean_consistency, 1.0)" if runs else "1"
    more = f"{_reliability_ctes()}," if runs else ""
    w = (CFG.w_relevance, CFG.w_groundedness, CFG.w_reliability, CFG.w_safety)
    return f"""{_rag_ctes()}, {more}
ans AS (SELECT query_id, answer FROM rag),
{_ground_ctes("ans")},
rel AS (SELECT query_id, round(avg(score), 4) AS mean_score FROM hx GROUP BY query_id),
{O.safety_cte("sf", "ans", "query_id", "answer")},
quality AS (
  SELECT a.query_id,
         CAST(round(CAST({w[0]} AS DECIMAL(6,4)) * CAST(coalesce(rel.mean_score, 0.0) AS DECIMAL(12,6))
               + CAST({w[1]} AS DECIMAL(6,4)) * CAST(coalesce(gr.overall_score, 0.0) AS DECIMAL(12,6))
               + CAST({w[2]} AS DECIMAL(6,4)) * CAST({rely} AS DECIMAL(12,6))
               + CAST({w[3]} AS DECIMAL(6,4)) * CAST(CASE WHEN sf.risk_level IN ('none', 'low') THEN 1 ELSE 0 END AS DECIMAL(12,6)), 4) AS DOUBLE) AS quality_score,
         coalesce(rel.mean_score, 0.0) AS relevance, coalesce(gr.overall_score, 0.0) AS groundedness,
         sf.risk_level IN ('none', 'low') AS safety
  FROM ans a LEFT JOIN rel USING (query_id) LEFT JOIN gr USING (query_id) LEFT JOIN sf USING (query_id)
       {"LEFT JOIN rely USING (query_id)" if runs else ""})"""


SQL["quality_with_runs"] = f"""WITH {_quality_ctes(True)}
SELECT query_id, quality_score, relevance, groundedness, safety,
       quality_score >= {CFG.pass_threshold} AND safety AS pass FROM quality"""

SQL["quality_scores"] = f"""WITH {_quality_ctes()}
SELECT query_id, quality_score, relevance, groundedness, safety,
       quality_score >= {CFG.pass_threshold} AND safety AS pass FROM quality"""


SQL["question_report"] = f"""SELECT s.query_id, substring(b.text, 1, 60) AS question, quality_score, relevance, groundedness, safety, pass
FROM ({SQL["quality_scores"]}) s JOIN benchmark b ON b.item_id = s.query_id"""


def _compare_sql() -> str:
    from ..functions.prompt import NO_CONTEXT_ANSWER
    return f"""WITH {_quality_ctes()},
k AS (SELECT query_id, answer, {KW} AS kw FROM rag),
acc AS (SELECT avg({_kacc('answer')}) AS r, avg({_kacc(O.lit(NO_CONTEXT_ANSWER))}) AS b FROM k),
q AS (SELECT avg(quality_score) AS avg_q FROM quality)
SELECT round(b, 4) AS baseline_avg_accuracy, round(r, 4) AS rag_avg_accuracy,
       round(r - b, 4) AS improvement_absolute,
       round(CASE WHEN b > 0 THEN (r - b) / b * 100 ELSE 0.0 END, 1) AS improvement_relative_pct,
       round(avg_q, 4) AS rag_avg_quality_score
FROM acc, q"""


SQL["benchmark_compare"] = _compare_sql()

SQL["demo_summary"] = f"""WITH {_quality_ctes()}
SELECT round(avg(quality_score), 4) AS average_quality,
       round(avg(CASE WHEN quality_score >= {CFG.pass_threshold} AND safety THEN 1.0 ELSE 0.0 END), 4) AS pass_rate,
       count(*) AS n_questions, (SELECT count(*) FROM chunks) AS total_chunks
FROM quality"""


def _emb_ctes() -> str:
    return """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
cs AS (SELECT label, i, sum(x) AS s FROM ex GROUP BY label, i),
cn AS (SELECT label, sqrt(sum(s * s)) AS n FROM cs GROUP BY label),
cent AS (SELECT CAST(cs.label AS BIGINT) AS query_id, cs.label + 1 AS top_k,
                list(cs.s / cn.n ORDER BY cs.i) AS c
         FROM cs JOIN cn USING (label) GROUP BY cs.label, cn.n),
sc AS (SELECT q.query_id, q.top_k, e.vec_id, list_inner_product(q.c, e.v) AS score FROM cent q, e),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)
                      AS INTEGER) AS rank FROM sc)"""


SQL["knn_exact"] = f"""WITH {_emb_ctes()}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM rk WHERE rank <= {CFG.top_k}"""
SQL["knn_exact_arrow"] = f"""WITH {_emb_ctes()}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM rk WHERE rank <= 30"""
SQL["ivf_full_probe"] = SQL["knn_exact"]


def _cell_ctes() -> str:
    from .catalog import NPROBE_CELLS
    return f"""{_emb_ctes()},
cell AS (
  SELECT vec_id, v, CAST(query_id AS INTEGER) AS cell FROM (
    SELECT e.vec_id, e.v, query_id, row_number() OVER (PARTITION BY e.vec_id
           ORDER BY round(list_inner_product(q.c, e.v), 12) DESC, query_id) AS n FROM cent q, e) WHERE n = 1),
ask AS (SELECT vec_id AS query_id, v FROM e WHERE vec_id % 100 = 0),
probe AS (
  SELECT query_id, cell FROM (
    SELECT a.query_id, CAST(q.query_id AS INTEGER) AS cell, row_number() OVER (PARTITION BY a.query_id
           ORDER BY round(list_inner_product(q.c, a.v), 12) DESC, q.query_id) AS n FROM ask a, cent q) WHERE n <= {NPROBE_CELLS}),
hit AS (
  SELECT * FROM (
    SELECT a.query_id, c.vec_id, list_inner_product(a.v, c.v) AS score, CAST(row_number() OVER (PARTITION BY a.query_id
           ORDER BY round(list_inner_product(a.v, c.v), 12) DESC, c.vec_id) AS INTEGER) AS rank
    FROM ask a JOIN probe p USING (query_id) JOIN cell c USING (cell)) WHERE rank <= {CFG.top_k}),
full_hit AS (
  SELECT * FROM (
    SELECT a.query_id, c.vec_id, list_inner_product(a.v, c.v) AS score, row_number() OVER (PARTITION BY a.query_id
           ORDER BY round(list_inner_product(a.v, c.v), 12) DESC, c.vec_id) AS rank
    FROM ask a, e c) WHERE rank <= {CFG.top_k})"""


SQL["ivf_assign"] = f"WITH {_cell_ctes()} SELECT vec_id, cell FROM cell"
SQL["ivf_probe"] = f"WITH {_cell_ctes()} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM hit"
SQL["ivf_recall"] = f"""WITH {_cell_ctes()}
SELECT f.query_id, round(count(h.vec_id) / count(*), 6) AS recall_at_k, count(*) AS k
FROM full_hit f LEFT JOIN hit h ON h.query_id = f.query_id AND h.vec_id = f.vec_id GROUP BY f.query_id"""

SQL["cell_search"] = f"WITH {_cell_ctes()} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM full_hit"
SQL["cell_search_nprobe"] = SQL["ivf_probe"]
SQL["cell_search_all"] = f"""SELECT * FROM (
  SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id
           ORDER BY round(list_inner_product(a.v, c.v), 12) DESC, c.vec_id) AS INTEGER) AS rank,
         c.vec_id, round(list_inner_product(a.v, c.v), 6) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) c)
WHERE rank <= {CFG.top_k}"""

SQL["knn_per_query_k"] = f"""WITH {_emb_ctes()}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM rk WHERE rank <= top_k"""


def _knn_threshold_sql() -> str:
    from ..functions.prompt import NO_HIT_ANSWER
    from .catalog import THRESHOLD_EMB as T
    return f"""WITH {_emb_ctes()},
h AS (SELECT * FROM rk WHERE rank <= {CFG.top_k}),
per AS (SELECT query_id, CAST(count(*) AS INTEGER) AS chunks_retrieved,
               CAST(count(*) FILTER (WHERE score >= {T}) AS INTEGER) AS chunks_used,
               arg_min(vec_id, rank) FILTER (WHERE score >= {T}) AS best_vec_id
        FROM h GROUP BY query_id)
SELECT c.query_id, coalesce(chunks_retrieved, 0) AS chunks_retrieved, coalesce(chunks_used, 0) AS chunks_used,
       best_vec_id,
       CASE WHEN coalesce(chunks_used, 0) = 0 THEN {O.lit(NO_HIT_ANSWER)} END AS fallback_answer
FROM cent c LEFT JOIN per USING (query_id)"""


SQL["knn_threshold"] = _knn_threshold_sql()

SQL["index_stats"] = """SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END AS status,
       count(*) > 0 AS index_loaded, count(*) AS total_chunks, CAST(max(len(embedding)) AS INTEGER) AS dim
FROM embeddings"""

SQL["index_roundtrip"] = """SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
       CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""


SQL["stream_questions"] = SQL["rag_answers"]
SQL["stream_once"] = SQL["rag_answers"]
SQL["result_json"] = SQL["rag_answers"]
SQL["rag_answers_ivf"] = SQL["rag_answers"]
SQL["rag_answers_cells"] = SQL["rag_answers"]
SQL["hit_sources_late"] = SQL["hit_sources"]


def _refresh_sql() -> str:
    """Two batches of the same questions against two chunkings."""
    from ..config import DEFAULT
    part = []
    for version, cfg in ((1, CFG), (2, CFG.with_(chunk_size=DEFAULT.chunk_size, chunk_overlap=DEFAULT.chunk_overlap))):
        ctes = ",\n".join([
            O.docs_cte(True), O.chunks_cte(cfg), O.weights_cte("cw", "chunks", "doc_id, chunk_index", "chunk_text", DIM),
            "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)",
            O.weights_cte("qw", "questions", "query_id", "question", DIM), O.knn_cte(cfg, str(cfg.top_k))])
        part.append(f"""SELECT * FROM (WITH {ctes}
SELECT {version - 1} AS batch_id, {version} AS index_version, q.query_id, CAST(count(h.score) AS INTEGER) AS chunks_retrieved,
       CAST(count(*) FILTER (WHERE h.score >= {cfg.similarity_threshold}) AS INTEGER) AS chunks_used,
       max(round(h.score, 4)) FILTER (WHERE h.score >= {cfg.similarity_threshold}) AS top_score
FROM questions q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id)""")
    return "\nUNION ALL\n".join(part)


SQL["stream_index_refresh"] = _refresh_sql()

def _files_sql() -> str:
    from .catalog import FILE_BYTES
    return f"""WITH p AS (
  SELECT source, doc_id, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {FILE_BYTES} AS part FROM documents),
f AS (SELECT source, part, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM p GROUP BY ALL)
"""


def _ranges_sql() -> str:
    from .catalog import RANGE_BYTES
    return f"""{_files_sql()}SELECT source, part, '.txt' AS format, CAST(strlen(t) + 1 AS BIGINT) AS size_bytes,
       CAST((strlen(t) + {RANGE_BYTES}) // {RANGE_BYTES} AS BIGINT) AS n_ranges, CAST(strlen(t) + 1 AS BIGINT) AS range_bytes,
       CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS n_lines, md5({O.strip('t')}) AS text_md5 FROM f"""


SQL["doc_scan"] = f"""{_files_sql()}SELECT source, part, '.txt' AS suffix, '.txt' AS format,
       CAST(strlen(t) + 1 AS BIGINT) AS size_bytes, md5({O.strip('t')}) AS text_md5 FROM f"""
SQL["doc_ranges"] = _ranges_sql()

SQL["docx_text"] = f"""SELECT doc_id,
  {O.strip("array_to_string(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) > 0), chr(10) || chr(10))")} AS text
FROM documents"""

SQL["quarantine"] = """SELECT doc_id,
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'quarantined' ELSE 'ok' END AS status,
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'invalid UTF-8' END AS error
FROM documents"""


SQL["event_lines"] = """WITH l AS (
  SELECT event_id, ts, strftime(ts, '%Y%m%d') AS day, coalesce(event_type, 'event') AS kind,
         'user_id=' || coalesce(CAST(user_id AS VARCHAR), '-') || ' | value=' || coalesce(printf('%.2f', value), '-')
         || ' | k=' || coalesce(json_extract_string(props, '$.k'), '-') AS message FROM events)
SELECT event_id, day, CASE WHEN kind = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || rpad(CASE WHEN kind = 'error' THEN 'ERROR' ELSE 'INFO' END, 5, ' ')
       || ' | ' || kind || ' | ' || message AS line FROM l"""
SQL["event_files"] = f"SELECT day, line FROM ({SQL['event_lines']})"
SQL["event_running_total"] = """SELECT event_id, CAST(sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) OVER (
  ORDER BY CASE WHEN event_id % 97 <> 0 THEN ts END NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM events"""

SQL["pipeline_counters"] = f"""WITH {_corpus_ctes()}
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks_indexed,
       (SELECT count(*) FROM chunks) AS vectors, (SELECT count(*) FROM chunks) AS chunks_written,
       (SELECT count(*) FROM chunks) AS vectors_written"""

SQL["knn_single"] = f"""WITH {_emb_ctes()},
g AS (SELECT i, sum(x) AS s FROM ex GROUP BY i),
gn AS (SELECT sqrt(sum(s * s)) AS n FROM g),
q AS (SELECT list(s / n ORDER BY i) AS c FROM g, gn)
SELECT vec_id, round(list_inner_product(q.c, e.v), 6) AS score FROM e, q
ORDER BY round(list_inner_product(q.c, e.v), 12) DESC, vec_id LIMIT {CFG.top_k}"""


def _bench_results_sql() -> str:
    from ..functions.prompt import NO_CONTEXT_ANSWER
    nc = O.lit(NO_CONTEXT_ANSWER)
    return f"""WITH {_rag_ctes()},
k AS (SELECT query_id, question, answer, chunks_used, {KW} AS kw FROM rag),
both_v AS (
  SELECT query_id, 'rag' AS variant, answer, kw, chunks_used FROM k
  UNION ALL
  SELECT query_id, 'baseline' AS variant, {nc} AS answer, kw, CAST(NULL AS INTEGER) AS chunks_used FROM k)
SELECT q.query_id, q.question, b.variant, substring(b.answer, 1, 200) AS answer,
       round({_kacc('b.answer', 'b.kw')}, 4) AS keyword_accuracy, b.chunks_used
FROM questions q JOIN both_v b USING (query_id)"""


SQL["benchmark_results"] = _bench_results_sql()
