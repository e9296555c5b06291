"""DuckDB SQL that must give the same rows as the queries."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS hs FROM w
), x AS (SELECT doc_id, len(hs) AS n, unnest(hs) AS h FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(node, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(hs) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.node
"""

URL_FILTERS = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC, len(p) DESC, verdict DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""

SOURCE_MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
t AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS cap,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight FROM t
), f AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, (sum(source_size) OVER () * 150)::DOUBLE / 100.0::DOUBLE AS share, sum(weight) OVER () AS all_weights, row_number() OVER o AS rn
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source) ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT *, (share::DOUBLE - (caps - cap)::DOUBLE) / (all_weights - (weights - weight))::DOUBLE AS level FROM f
), g AS (SELECT arg_min(level, rn) FILTER (level < cap::DOUBLE / weight) AS reached FROM l),
target AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN reached IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * reached) END AS target FROM l, g
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id IS NULL, doc_id) - 1 AS r FROM d
), m AS (
  SELECT doc_id, size, source_size, target, r, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(k.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM k JOIN target ON k.source IS NOT DISTINCT FROM target.source
)
SELECT doc_id, size, source_size, target, CAST((floor((r + 1) * rate + u) - floor(r * rate + u)) * size AS BIGINT) AS taken FROM m
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  w AS (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
  l AS (SELECT lang, sum(total) AS n, count(*) AS v FROM k GROUP BY ALL),
  c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d),
  s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
  p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
      1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
    FROM s JOIN k ON k.lang = s.lang JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
  SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""

SQL = {
    "op1_near_duplicates": NEAR_DUPLICATES, "op4_url_filters": URL_FILTERS, "op5_source_mix": SOURCE_MIX, "op12_source_divergence": SOURCE_DIVERGENCE,
}
