"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
kept AS (SELECT html, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN kept IS NULL OR kept = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> p.page_id THEN kept END AS refers_to
FROM p LEFT JOIN kept ON kept.html = p.html
""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op6_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = w.doc_id
""",
    "op11_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS p(piece)),
grams AS (
  SELECT lang, s, i, list_slice(w, i, i + s - 1) AS p
  FROM pieces, unnest(generate_series(1, 5)) AS z(s), unnest(generate_series(1, len(w) - s + 1)) AS g(i) WHERE len(w) >= s),
f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p),
total AS (SELECT lang, sum(f) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
cand AS (SELECT lang, p, f AS a FROM f WHERE f >= 100 AND len(p) > 1),
cuts AS (
  SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, CAST(total.n AS HUGEINT) AS n,
    (CAST(1000 AS HUGEINT) * c.a * CAST(total.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cand c, unnest(generate_series(1, len(c.p) - 1)) AS g(k)
  JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, k)
  JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, k + 1, len(c.p))
  JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_part AS (
  SELECT c.lang, list_slice(c.p, i, i + s - 1) AS p, max(c.a) AS longer
  FROM cand c, unnest(generate_series(2, 4)) AS z(s), unnest(generate_series(1, len(c.p) - s + 1)) AS g(i)
  WHERE len(c.p) > s GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_part i ON i.lang = b.lang AND i.p = b.p WHERE longer IS NULL OR 100 * longer < 100 * b.a)
SELECT lang, row_number() OVER w AS rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' '))
QUALIFY row_number() OVER w <= 2000
""",
}
