"""DuckDB SQL for the rows of the queries that SQL can express."""

OP1 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, first(r.h || r.p ORDER BY length(r.h || r.p) DESC) FILTER (r.h IS NOT NULL) AS rule,
      first(r.verdict ORDER BY length(r.h || r.p) DESC) FILTER (r.h IS NOT NULL) AS verdict
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""

_MIX = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, 'domain' || coalesce(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0) AS domain,
    coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM {documents}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM t GROUP BY ALL),
weights(a, b, w) AS (VALUES ('domain0', NULL, 4.0::DOUBLE), ('domain1', NULL, 2.0), ('domain2', NULL, 1.0), ('domain3', NULL, 1.0), ('domain0', 'en', 3.0)),
c1 AS (SELECT domain, sum(tokens) * {epochs}::DOUBLE AS cap, any_value(coalesce(w, 1.0)) AS w FROM leaf LEFT JOIN weights ON a = domain AND b IS NULL GROUP BY ALL),
g1 AS (SELECT *, (SELECT floor(sum(tokens) * {share}) FROM leaf)::DOUBLE AS given FROM c1),
l1 AS (SELECT *, (given - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM g1),
a1 AS (SELECT domain, least(cap, w * max(lev) OVER ()) AS alloc FROM l1),
c2 AS (SELECT domain, lang, sum(tokens) * {epochs}::DOUBLE AS cap, any_value(coalesce(w, 1.0)) AS w FROM leaf LEFT JOIN weights ON a = domain AND b = lang GROUP BY ALL),
l2 AS (SELECT c2.*, (alloc - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c2 JOIN a1 USING (domain)),
a2 AS (SELECT domain, lang, least(cap, w * max(lev) OVER (PARTITION BY domain)) AS alloc FROM l2),
c3 AS (SELECT domain, lang, source, tokens * {epochs}::DOUBLE AS cap, 1.0::DOUBLE AS w FROM leaf),
l3 AS (SELECT c3.*, (alloc - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c3 JOIN a2 USING (domain, lang)),
a3 AS (SELECT domain, lang, source, floor(least(cap, w * max(lev) OVER (PARTITION BY domain, lang)) + 1e-6)::BIGINT AS leaf_budget FROM l3),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN least(leaf_budget // tokens, {epochs}) ELSE 0 END AS n_full FROM leaf JOIN a3 USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || n_full || ':' || coalesce(doc_id::VARCHAR, 'null')), n_tokens, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM t JOIN plan USING (domain, lang, source)),
e AS (SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, unnest(range(CAST(n_full + CASE WHEN n_full < {epochs} AND running <= leaf_budget - n_full * tokens THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM o)
"""

OP10 = _MIX.format(documents="documents", epochs=2, share=0.5) + "SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens, leaf_budget FROM e"

OP3 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM g JOIN c USING (doc_id)
"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op3_exact_top_k": OP3, "op5_jaccard_join": OP5, "op10_source_mixing": OP10}
