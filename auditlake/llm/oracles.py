"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from auditlake.llm.secrets import FAST, LEAST, PATTERNS


def _found(kind: str, rank: int) -> str:
    pattern = FAST.get(kind, PATTERNS[kind]).replace("'", "''")
    group = 1 if kind == "assign" else 0
    return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, {LEAST[kind]} AS least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap
      FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals, regexp_split_to_array(t, '{pattern}') AS gaps FROM d)"""


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS owner, coalesce('=' || source, '') || '/' || coalesce('=' || lang, '') AS repo FROM documents),
m AS ({" UNION ALL ".join(_found(k, i) for i, k in enumerate(PATTERNS))}),
s AS (
  SELECT rid, kind, rank, val, length(val) >= least AS long_enough,
    sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY rid, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
    sum(length(gap)) OVER w + sum(length(hit)) OVER w AS b
  FROM m WINDOW w AS (PARTITION BY rid, kind ORDER BY i)
),
base AS (SELECT * FROM s WHERE kind <> 'token' AND long_enough),
tok AS (
  SELECT * FROM s WHERE kind = 'token' AND long_enough AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9].*[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = s.rid AND x.a < s.b AND s.a < x.b)
),
c AS (SELECT rid, kind, rank, val, a, b FROM base UNION ALL SELECT rid, kind, rank, val, a, b FROM tok),
wide AS (SELECT val FROM c JOIN d USING (rid) GROUP BY val HAVING count(DISTINCT owner) >= 3 OR count(DISTINCT owner || '|' || repo) >= 4),
j AS (SELECT c.*, kind || ':' || a::BIGINT || ':' || b::BIGINT AS span, val NOT IN (SELECT val FROM wide) AS live FROM c),
g AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n1, count(*) FILTER (WHERE kind = 'access') AS n2, count(*) FILTER (WHERE kind = 'hex') AS n3,
    string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE kind <> 'token') AS base, string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE kind <> 'token' OR live) AS spans,
    string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE live) AS live_spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_assign, coalesce(n2, 0)::BIGINT AS n_access, coalesce(n3, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN g USING (rid)
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(id, c) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON id = doc_id
"""

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON id = vec_id LEFT JOIN n ON a = vec_id
"""


def op11(rounds: int = 5) -> str:
    """k-means with integer components, a few common table expressions for each round."""
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS c, v FROM v QUALIFY c < 40)"""
    ]
    for k in range(rounds + 1):
        parts.append(f"""d{k} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (
    SELECT vec_id, v.v, c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c{k}.v[i]) * (v.v[i] - c{k}.v[i])))::BIGINT AS d FROM v CROSS JOIN c{k}) GROUP BY vec_id)""")
        if k < rounds:
            parts.append(f"""s{k} AS (SELECT m.c AS c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM d{k}, range(1, 65) t(i) GROUP BY 1, 2),
m{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM d{rounds} JOIN c{rounds} ON c = m.c"""


OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN range(1, 6) t(k) WHERE len(ws) >= k)
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT cuts.lang, cuts.phrase, a, n, j, x.f AS l, y.f AS r, 1000 * a * n // (x.f * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp JOIN n ON n.lang = cuts.lang
), low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + z - 1], ' ') AS phrase, a FROM (
    SELECT lang, ws, a, z, unnest(range(1, k - z + 2)) AS i FROM c CROSS JOIN range(2, 5) t(z) WHERE z < k)
), top AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.a >= 100 * low.a)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM top WHERE rank <= 2000
"""
