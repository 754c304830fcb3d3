"""DuckDB oracles of the queries that SQL can express."""
from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n_full, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][rnk % 3 + 1] AS weight, [3.0, 1.0, 1.0][rnk % 3 + 1]::DOUBLE AS a,
         [1.0, 3.0, 1.0][rnk % 3 + 1]::DOUBLE AS b, (200 * source_size)::HUGEINT AS cap,
         sum(150 * source_size) OVER ()::HUGEINT AS total FROM s),
o AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w),
f AS (SELECT *, cap * weight_left <= left_before * weight AS is_full FROM o),
g AS (
  SELECT *, total - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS num, sum(weight) FILTER (NOT is_full) OVER () AS den FROM f),
t AS (
  SELECT source, source_size, n_full, a, b,
         CASE WHEN is_full THEN 2.0 * source_size ELSE num::DOUBLE * weight / (100.0 * den) END::DOUBLE AS target FROM g),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.n_full, t.target, t.a, t.b, round(t.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM p),
r0 AS (SELECT *, words - passes * source_size - before AS rest FROM q),
r AS (SELECT *, CASE WHEN n_full = 1 THEN least(greatest(rest, 0), size) WHEN rest > 0 AND 2 * rest >= size THEN size ELSE 0 END AS cut FROM r0),
x AS (
  SELECT *, CASE WHEN size > 0 THEN passes + (cut > 0)::BIGINT ELSE 0 END AS copies, before / words::DOUBLE AS share FROM r)
SELECT doc_id, size, source_size, target, (passes * size + cut)::BIGINT AS taken, copies::BIGINT AS copies,
       CASE WHEN copies > 0 THEN CASE WHEN share <= 0 THEN 0.0
            ELSE share * (a + b) / (a + sqrt(a * a + (b - a) * (share * (a + b)))) END END::DOUBLE AS position
FROM x
"""

LINES = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
l AS (
  SELECT *, len(regexp_extract_all(line, {_WORD})) AS w,
         sum(len(regexp_extract_all(line, {_WORD}))) OVER (PARTITION BY doc_id ORDER BY ln) AS cum FROM raw),
runs AS (
  SELECT s.doc_id, s.ln AS a, min(e.ln) AS b FROM l s JOIN l e
    ON s.doc_id = e.doc_id AND e.ln >= s.ln AND e.cum - (s.cum - s.w) >= 50 GROUP BY ALL
  UNION
  SELECT e.doc_id, max(s.ln) AS a, e.ln AS b FROM l s JOIN l e
    ON s.doc_id = e.doc_id AND e.ln >= s.ln AND e.cum - (s.cum - s.w) >= 50 GROUP BY e.doc_id, e.ln),
texts AS (
  SELECT r.doc_id, r.a, r.b, string_agg(l.line, chr(10) ORDER BY l.ln) AS run
  FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.ln BETWEEN r.a AND r.b GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS n FROM texts),
gone AS (
  SELECT DISTINCT l.doc_id, l.ln FROM nth JOIN l ON l.doc_id = nth.doc_id AND l.ln BETWEEN nth.a AND nth.b WHERE nth.n > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) AS text
  FROM l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.ln = l.ln) GROUP BY l.doc_id),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(cnt.n, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""

def _centroids(k: int = 40, dim: int = 64, rounds: int = 5) -> str:
    """Every round measures every pair; centroids are rows (c, j, value)."""
    parts = [f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INTEGER AS c, x FROM v
  QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v.x, m.d AS distance, m.c AS cluster FROM (
    SELECT v.vec_id, v.x, (SELECT min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) FROM c{r} c) AS m
    FROM v) v)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
  SELECT cluster, j, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY cluster, j),
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(g.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list((CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT ORDER BY j) AS x FROM s{r} GROUP BY cluster) g
  ON g.cluster = c.c)""")
    return ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.c"""


JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}), []) AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sh),
-- equal sets count once
one AS MATERIALIZED (SELECT min(doc_id) AS rep, list(doc_id) AS docs, s FROM (SELECT doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0) GROUP BY s),
t AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM one),
pairs AS (SELECT a.rep AS u, b.rep AS v, a.n AS m, b.n AS k, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM pairs WHERE 100 * c >= 85 * (m + k - c)),
l AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(node, root) AS (
  SELECT rep, rep FROM one
  UNION
  SELECT l.v, reach.root FROM reach JOIN l ON l.u = reach.node WHERE reach.root < l.v),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
named AS (SELECT unnest(docs) AS doc_id, rep FROM one)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least.component_id, n.doc_id) AS component_id,
       n.doc_id = coalesce(least.component_id, n.doc_id) AS kept
FROM n LEFT JOIN named ON n.doc_id = named.doc_id LEFT JOIN least ON least.node = named.rep
"""

DIVERGENCE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT lang, source, k, unnest(w) AS term FROM d),
vocab AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS MATERIALIZED (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN vocab USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT s.lang, s.source, coalesce(v.v, 0)::HUGEINT AS v, coalesce(v.total, 0)::HUGEINT AS lang_total, coalesce(t.total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM vocab GROUP BY lang) v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, vocab.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p,
         1 + 1000000000 * (vocab.n + 5) // (g.lang_total + 5 * g.v) AS q
  FROM g JOIN vocab USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = vocab.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
"""

SQL: dict[str, str] = {
    "op4_mix_sources": MIX,
    "op9_line_dedup": LINES,
    "op11_centroids": _centroids(),
    "op12_minhash_near_dedup": JACCARD,
    "op13_divergence": DIVERGENCE,
}
