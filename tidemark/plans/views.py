"""SQL fragments: the tables of the queries, written as common table expressions."""

from __future__ import annotations


def quoted(text: str) -> str:
    return text.replace("'", "''")


FILES = "files AS (SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
LINES = (
    "lines AS (SELECT project, path, unnest(string_split(content, chr(10))) AS line, "
    "generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"
)
PAGE_FILES = (
    "files AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, page_id || '.html' AS path, "
    "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS url_path, html AS content FROM pages)"
)
SCANS = (
    "scans AS (SELECT event_id AS scan_id, user_id AS project, event_type AS \"check\", ts AS scan_ts, "
    "CAST(floor(greatest(0, least(100, value)) + 0.5) AS BIGINT) AS score FROM events)"
)
FACTS = "facts AS (SELECT DISTINCT user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
_TARGET = "'../pkg' || (k % 10) || '/mod' || k"
MODULES = (
    FACTS + ", files AS (SELECT 'app' AS project, 'pkg' || (user_id % 10) || '/mod' || user_id || '.ts' AS path, string_agg(CASE event_type "
    f"WHEN 'click' THEN 'import {{ m' || k || ' }} from ''' || {_TARGET} || ''';' "
    f"WHEN 'view' THEN 'import type {{ T' || k || ' }} from ''' || {_TARGET} || ''';' "
    f"WHEN 'purchase' THEN 'const lazy' || k || ' = () => import(''' || {_TARGET} || '''); if (!lazy' || k || ') throw new Error(''gone'');' "
    "WHEN 'error' THEN 'try { run' || k || '(); } catch (e) {}' "
    "ELSE CASE WHEN k % 2 = 0 THEN '// step ' || k || chr(10) ELSE '' END || 'export function step' || k || "
    "'(el) { el.innerHTML = JSON.parse(body); return null; } // TODO check as any' END, chr(10) ORDER BY event_type, k) AS content "
    "FROM facts GROUP BY user_id)"
)
TESTS = (
    "tests AS (SELECT 'app' AS project, 'pkg' || (user_id % 10) || '/mod' || user_id || '.test.ts' AS path, string_agg(CASE event_type "
    "WHEN 'click' THEN 'it(''m' || k || ''', () => { expect(m' || k || '()).toBe(1); });' "
    "WHEN 'view' THEN 'vi.mock(''../pkg' || (k % 10) || '/mod' || k || ''');' "
    "WHEN 'purchase' THEN 'it(''p' || k || ''', () => { assert.ok(p' || k || '()); });' "
    "WHEN 'error' THEN 'it.skip(''e' || k || ''', () => {});' "
    "ELSE 'it(''s' || k || ''', () => { expect(s' || k || '()).toMatchSnapshot(); });' END, chr(10) ORDER BY event_type, k) AS content "
    "FROM facts WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150) GROUP BY user_id)"
)
EDGES = (
    "edges AS (SELECT DISTINCT user_id AS src, CAST(props->>'$.k' AS BIGINT) AS dst, CASE event_type WHEN 'view' THEN 'type' "
    "WHEN 'purchase' THEN 'dynamic' ELSE 'static' END AS kind FROM events WHERE user_id <> CAST(props->>'$.k' AS BIGINT))"
)


def with_views(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
