"""DuckDB SQL twins of the registered queries (the correctness oracle).

Built from the same constants as the Spark code, as plain SQL text with CTE
fragments. RE2 has no look-behind, so the sentence splitter is rewritten as
"mark, then split"; everything else is a direct transcription of the Spark
expressions' semantics.
"""
from __future__ import annotations

from ..config import Config
from ..functions import prompt as P
from ..functions import text as TX


def lit(s: str) -> str:
    """A Python string as a DuckDB expression (control and non-ASCII
    characters through ``chr``)."""
    parts, buf = [], []
    for ch in s:
        if 32 <= ord(ch) < 127:
            buf.append("''" if ch == "'" else ch)
        else:
            if buf:
                parts.append("'" + "".join(buf) + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(parts) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize_ws(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '{TX.BLANK_RUN}', chr(10) || chr(10), 'g'), "
            f"'{TX.HSPACE_RUN}', ' ', 'g')")


def drop_lines(x: str) -> str:
    s = strip("l")
    return (f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT ("
            f"regexp_matches({s}, '(?i){TX.PAGE_LINE}') OR regexp_matches({s}, '{TX.SEPARATOR_LINE}'))), chr(10))")


def fix_chars(x: str) -> str:
    out = x
    for k, v in TX.CHAR_MAP.items():
        out = f"replace({out}, {lit(k)}, {lit(v)})"
    return out


def clean(x: str) -> str:
    return strip(fix_chars(drop_lines(normalize_ws(x))))


def split_sentences(x: str) -> str:
    """F6 without look-behind: mark each boundary with chr(1), then split."""
    return (f"list_filter(list_transform(string_split(regexp_replace({strip(x)}, "
            f"'([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: length(s) > 10)")


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def docs_cte(clean_text: bool = True) -> str:
    t = clean("text") if clean_text else "text"
    return (f"docs AS (SELECT doc_id, {t} AS text, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS filename "
            f"FROM documents)")


def chunks_cte(cfg: Config, src: str = "docs") -> str:
    step = cfg.chunk_size - cfg.chunk_overlap
    return f"""chunks AS (
  SELECT doc_id, filename, CAST(s // {step} AS INTEGER) AS chunk_index,
         CAST(len(p[s + 1 : s + {cfg.chunk_size}]) AS INTEGER) AS token_count,
         array_to_string(p[s + 1 : s + {cfg.chunk_size}], '') AS chunk_text
  FROM (SELECT doc_id, filename, p, unnest(range(0, len(p), {step})) AS s
        FROM (SELECT doc_id, filename, regexp_extract_all(text, '\\s*\\S+') AS p FROM {src})))"""


def weights_cte(name: str, src: str, keys: str, text: str, dim: int) -> str:
    """Hashed embedding in long form: ``keys, bucket, weight`` (float32
    rounding applied exactly as the Spark embedder stores it)."""
    return f"""{name}_terms AS (
  SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {src}),
{name}_tf AS (
  SELECT {keys}, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {dim} AS INTEGER) AS bucket,
         count(*) AS tf
  FROM {name}_terms GROUP BY ALL),
{name} AS (
  SELECT {keys}, bucket,
         CAST(CAST(tf / sqrt(sum(tf * tf) OVER (PARTITION BY {keys})) AS FLOAT) AS DOUBLE) AS weight
  FROM {name}_tf)"""


def knn_cte(cfg: Config, k_expr: str = "5", name: str = "hits", qsrc: str = "qw",
            csrc: str = "cw") -> str:
    """Exact top-k by sparse dot product over shared buckets."""
    return f"""{name}_scores AS (
  SELECT q.query_id, c.doc_id, c.chunk_index, sum(q.weight * c.weight) AS score
  FROM {qsrc} q JOIN {csrc} c USING (bucket) GROUP BY ALL),
{name} AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY round(score, 12) DESC, doc_id, chunk_index) AS INTEGER) AS rank
    FROM {name}_scores) WHERE rank <= {k_expr})"""


def section(filename: str, chunk_index: str, score: str, text: str) -> str:
    return (f"'[Source: ' || coalesce({filename}, '{P.MISSING_SOURCE}') || ' | Chunk ' || "
            f"coalesce(CAST({chunk_index} AS VARCHAR), '{P.MISSING_CHUNK}') || ' | Relevance: ' || "
            f"printf('%.3f', round({score}, 3)) || ']' || chr(10) || coalesce({text}, '')")


def answers_cte(name: str, src: str, keys: str) -> str:
    """The built-in generator over ``src(keys, question, texts)``: the distinct
    sentences of all texts that share at least half as many question terms as
    the best one -> ``name(keys, answer)``."""
    terms = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'))"
    return f"""{name}_l AS (
  SELECT {keys}, question, flatten(list_transform(texts, lambda t: {split_sentences('t')})) AS l FROM {src}),
{name}_d AS (
  SELECT {keys}, {terms('question')} AS q, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM {name}_l),
{name}_n AS (
  SELECT {keys}, l, list_transform(l, lambda x: len(list_intersect({terms('x')}, q))) AS n FROM {name}_d),
{name} AS (
  SELECT {keys}, coalesce(array_to_string(list_filter(l, lambda x, i: n[i] > 0 AND n[i] * 2 >= list_max(n)), ' '), '') AS answer
  FROM {name}_n)"""


def safety_cte(name: str, src: str, keys: str, answer: str) -> str:
    """C3 flattened: keys, is_safe, risk_level, total_flags, categories."""
    from ..functions import safety as S
    pii = [f"CASE WHEN regexp_matches(a, {lit(p)}) THEN '{S.PII_FLAG[0]}:{S.PII_FLAG[1]}' END"
           for p in S.PII_PATTERNS]
    hedges = " + ".join(f"len(regexp_extract_all(a, {lit('(?i)' + p)}))" for p in S.HEDGING_PATTERNS)
    refusal = " OR ".join(f"regexp_matches(a, {lit('(?i)' + p)})" for p in S.REFUSAL_PATTERNS)
    flags = pii + [
        f"CASE WHEN hedges >= {S.HEDGING_MIN} THEN '{S.HEDGING_FLAG[0]}:{S.HEDGING_FLAG[1]}' END",
        f"CASE WHEN refusal THEN '{S.REFUSAL_FLAG[0]}:{S.REFUSAL_FLAG[1]}' END",
        f"CASE WHEN words < {S.TOO_SHORT_WORDS} THEN '{S.SHORT_FLAG[0]}:{S.SHORT_FLAG[1]}' "
        f"WHEN words > {S.TOO_LONG_WORDS} THEN '{S.LONG_FLAG[0]}:{S.LONG_FLAG[1]}' END",
    ]
    return f"""{name}_a AS (
  SELECT {keys}, a, {hedges} AS hedges, ({refusal}) AS refusal,
         len(regexp_extract_all(a, '\\S+')) AS words
  FROM (SELECT {keys}, coalesce({answer}, '') AS a FROM {src})),
{name}_f AS (
  SELECT {keys}, list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL) AS fl FROM {name}_a),
{name} AS (
  SELECT {keys},
         CASE WHEN list_contains(list_transform(fl, lambda x: split_part(x, ':', 2)), 'high') THEN 'high'
              WHEN list_contains(list_transform(fl, lambda x: split_part(x, ':', 2)), 'medium') THEN 'medium'
              WHEN len(fl) > 0 THEN 'low' ELSE 'none' END AS risk_level,
         CAST(len(fl) AS INTEGER) AS total_flags,
         array_to_string(list_transform(fl, lambda x: split_part(x, ':', 1)), ',') AS categories
  FROM {name}_f)"""
