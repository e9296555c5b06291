"""Queries on source code written from the events: rules, exports, imports, tests, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.rules import ERROR_HANDLING, SECURITY, TYPE_ESCAPES_TS
from tidemark.functions import scoring as S
from tidemark.operators import block_rules as B
from tidemark.operators import code as C
from tidemark.operators import findings as W
from tidemark.operators import imports as I
from tidemark.operators import naming as N
from tidemark.operators import rules as E
from tidemark.operators import textmetrics as M
from tidemark.plans.registry import named
from tidemark.plans.views import FACTS, LINES, MODULES, TESTS, quoted, with_views
from tidemark.session import spread, written
from tidemark.sources import policy as L
from tidemark.sources.corpus import event_modules, event_number, event_tests, policy_files, table

CODE = with_views(MODULES, LINES)

# RE2 has no look-around: four security patterns are written as two tests in SQL.
_LOOKAROUND = {
    r"document\.cookie\s*=(?!.*[Hh]ttp[Oo]nly)": r"regexp_matches(line, 'document\.cookie\s*=') AND NOT regexp_matches(line, 'document\.cookie\s*=.*[Hh]ttp[Oo]nly')",
    r"""(?:Set-Cookie|setCookie)['"]\s*[,:].*(?!.*[Ss]ecure)""": r"""regexp_matches(line, '(?:Set-Cookie|setCookie)[''"]\s*[,:]')""",
    r"""fetch\s*\(\s*["'`]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)""": r"""regexp_matches(line, 'fetch\s*\(\s*["''`]http://') AND NOT regexp_matches(line, 'fetch\s*\(\s*["''`]http://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)')""",
}


def _fires(rule) -> str:
    if rule.pattern in _LOOKAROUND:
        return _LOOKAROUND[rule.pattern]
    if "(?!origin)" in rule.pattern:
        return r"""regexp_matches(line, '(?i)addEventListener\s*\(\s*["'']message["''][^)]*\)\s*(?:=>|\{).{0,200}(?:token|secret|password|auth)')"""
    return f"regexp_matches(line, '{'(?i)' if rule.flags else ''}{quoted(rule.pattern)}')"


_SECURITY_SKIP = " AND ".join(f"NOT regexp_matches(line, '{quoted(p)}')" for p in SECURITY.skip)
_STORAGE_LINES = (
    "lines AS (SELECT 'u' || user_id AS project, event_type || '.ts' AS path, event_id AS line_no, CASE event_type "
    "WHEN 'click' THEN 'localStorage.setItem(''auth.token'', value' || user_id || ')' "
    "WHEN 'view' THEN 'localStorage.setItem(''session.theme'', theme)' "
    "WHEN 'error' THEN 'sessionStorage.setItem(''session.key'', v)' "
    "WHEN 'purchase' THEN 'const db = ''postgres://app:pw' || user_id || '@host/db''' "
    "ELSE 'document.cookie = ''a=' || user_id || '''' END AS line FROM events)"
)


def storage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of browser-storage or connection code per event."""
    user = F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("localStorage.setItem('auth.token', value"), user, F.lit(")")))
        .when(F.col("event_type") == "view", F.lit("localStorage.setItem('session.theme', theme)"))
        .when(F.col("event_type") == "error", F.lit("sessionStorage.setItem('session.key', v)"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("const db = 'postgres://app:pw"), user, F.lit("@host/db'")))
        .otherwise(F.concat(F.lit("document.cookie = 'a="), user, F.lit("'")))
    )
    return spread(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")).select(
        F.concat(F.lit("u"), user).alias("project"), F.concat("event_type", F.lit(".ts")).alias("path"), F.col("event_id").alias("line_no"), text.alias("line")
    )


def _security_sql(views: str) -> str:
    return views + " UNION ALL ".join(
        f"SELECT project, path, line_no, '{r.rule}' AS rule, '{r.severity}' AS severity, '{quoted(r.message)}' AS message FROM lines WHERE {_SECURITY_SKIP} AND {_fires(r)}"
        for r in SECURITY.rules
    )


@named("security_findings", _security_sql(CODE))
def security_findings(spark, sf_dir):
    found = E.scan_lines(E.to_lines(event_modules(spark, sf_dir)), SECURITY)
    return found.select("project", "path", "line_no", "rule", "severity", "message")


@named("storage_findings", _security_sql(with_views(_STORAGE_LINES)))
def storage_findings(spark, sf_dir):
    return E.scan_lines(storage_lines(spark, sf_dir), SECURITY).select("project", "path", "line_no", "rule", "severity", "message")


@named(
    "storage_findings_regraded",
    "WITH found AS (" + _security_sql(with_views(_STORAGE_LINES)) + """)
    SELECT project, path, line_no, rule, CASE WHEN rule = 'CWE-922' AND path = 'click.ts' THEN 'error' WHEN rule = 'CWE-922' THEN 'warning' ELSE severity END AS severity,
      CASE WHEN rule = 'CWE-922' AND path = 'click.ts' THEN 'Auth/session-like key or value in localStorage (persistent browser storage) — accessible to XSS. Prefer HttpOnly cookies'
           WHEN rule = 'CWE-922' THEN 'Auth/session-like key or value in sessionStorage (browser session storage) — accessible to XSS. Prefer HttpOnly cookies' ELSE message END AS message
    FROM found WHERE NOT (rule = 'CWE-922' AND path = 'view.ts')""",
)
def storage_findings_regraded(spark, sf_dir):
    found = E.regrade_storage(E.scan_lines(storage_lines(spark, sf_dir), SECURITY))
    return found.select("project", "path", "line_no", "rule", "severity", "message")


@named(
    "storage_audit",
    """SELECT 'u' || user_id AS project, count(*) FILTER (event_type IN ('click', 'view')) AS local_storage, count(*) FILTER (event_type = 'error') AS session_storage,
    count(*) FILTER (event_type = 'purchase') AS hardcoded_credentials, count(*) FILTER (event_type = 'signup') AS insecure_cookies, count(*) AS total FROM events GROUP BY user_id""",
)
def storage_audit(spark, sf_dir):
    return W.cwe_audit(E.scan_lines(storage_lines(spark, sf_dir), SECURITY))


@named(
    "lines_after_skipping",
    CODE + f"SELECT path, count(*) AS lines FROM lines WHERE {_SECURITY_SKIP} GROUP BY path",
)
def lines_after_skipping(spark, sf_dir):
    kept = E.skip_lines(E.to_lines(event_modules(spark, sf_dir)), SECURITY.skip)
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@named(
    "type_escapes",
    CODE + """, n AS (SELECT path, line_no, line, len(regexp_extract_all(line, '\\bas any\\b')) AS n, 'as any' AS message, 2.0::DOUBLE AS weight FROM lines
      UNION ALL SELECT path, line_no, line, len(regexp_extract_all(line, ':\\s*any\\b')), ': any', 1.0 FROM lines)
    SELECT path, line_no, message, weight, unnest(generate_series(1, n)) AS nth FROM n WHERE n > 0 AND NOT starts_with(ltrim(line), '//') AND NOT starts_with(ltrim(line), '*')""",
)
def type_escapes(spark, sf_dir):
    return E.scan_occurrences(E.to_lines(event_modules(spark, sf_dir)), TYPE_ESCAPES_TS).select("path", "line_no", "message", "weight", "nth")


@named(
    "type_safety_score",
    CODE + """SELECT CAST(count(*) FILTER (contains(line, 'as any') AND NOT starts_with(line, '//')) AS BIGINT) AS escapes, count(*) AS lines,
    CAST(floor(greatest(0, least(100, 100 - 2.0::DOUBLE * count(*) FILTER (contains(line, 'as any') AND NOT starts_with(line, '//')) / greatest(100, count(*)) * 1000 * 3)) + 0.5) AS BIGINT) AS score FROM lines""",
)
def type_safety_score(spark, sf_dir):
    lines = E.to_lines(event_modules(spark, sf_dir))
    escapes = E.scan_occurrences(lines, TYPE_ESCAPES_TS).groupBy("project").agg(F.count(F.lit(1)).alias("escapes"), F.sum("weight").alias("weight"))
    sizes = lines.groupBy("project").agg(F.count(F.lit(1)).alias("lines"))
    joined = sizes.join(escapes, "project", "left").na.fill(0)
    return joined.select("escapes", "lines", S.type_safety_score(F.col("weight"), F.col("lines")).alias("score"))


@named(
    "error_handling_findings",
    CODE + r"""SELECT path, line_no, 'empty-catch' AS rule FROM lines WHERE regexp_matches(line, 'catch\s*\([^)]*\)\s*\{\s*\}|catch\s*\{\s*\}')
      AND NOT regexp_matches(line, 'try\s*\{.*(?:localStorage|sessionStorage|document\.).*\}\s*catch') AND NOT regexp_matches(line, '^\s*(?://|\*)')""",
)
def error_handling_findings(spark, sf_dir):
    return E.scan_lines(E.to_lines(event_modules(spark, sf_dir)), ERROR_HANDLING).select("path", "line_no", "rule")


_UNSAFE = CODE + r""", hits AS (SELECT path, line_no FROM lines WHERE regexp_matches(line, '\bJSON\.parse\s*\(') AND regexp_matches(line, '\bbody\b'))
  SELECT path, line_no FROM hits h WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = h.path AND l.line_no BETWEEN h.line_no - 20 AND h.line_no - 1 AND contains(l.line, 'try'))"""


@named("unsafe_json_parse", _UNSAFE)
def unsafe_json_parse(spark, sf_dir):
    return E.unsafe_json_parse(event_modules(spark, sf_dir)).select("path", "line_no")


@named(
    "fixable_findings",
    CODE + r""", e AS (SELECT path, line_no, 'empty-catch' AS rule, 'Add error logging: catch(e) { console.error(e); }' AS fix FROM lines WHERE regexp_matches(line, 'catch\s*\([^)]*\)\s*\{\s*\}')
      UNION ALL SELECT path, line_no, 'CWE-79', 'Use textContent or DOM APIs instead' FROM lines WHERE regexp_matches(line, '\.innerHTML\s*=') AND NOT starts_with(line, '//'))
    SELECT * FROM e""",
)
def fixable_findings(spark, sf_dir):
    lines = E.to_lines(event_modules(spark, sf_dir))
    found = W.all_findings(E.scan_lines(lines, ERROR_HANDLING), E.scan_lines(lines, SECURITY))
    return W.fixable(found).select("path", "line_no", "rule", "fix")


@named(
    "action_groups",
    CODE + r""", f AS (SELECT 'error-handling' AS "check", 'Add error logging: catch(e) { console.error(e); }' AS fix, count(*) AS items FROM lines WHERE regexp_matches(line, 'catch\s*\([^)]*\)\s*\{\s*\}')
      UNION ALL SELECT 'security', 'Use textContent or DOM APIs instead', count(*) FROM lines WHERE regexp_matches(line, '\.innerHTML\s*=') AND NOT starts_with(line, '//')),
      s AS (SELECT 'suggested' AS kind, "check", fix, items, CASE "check" WHEN 'security' THEN 95 ELSE 50 END::BIGINT AS score FROM f),
      t AS (SELECT 'manual' AS kind, 'type-safety' AS "check", NULL AS fix, count(*) AS items, 40::BIGINT AS score FROM lines WHERE contains(line, 'as any') AND NOT starts_with(line, '//'))
    SELECT * FROM s WHERE items > 0 UNION ALL SELECT * FROM t WHERE items > 0""",
)
def action_groups(spark, sf_dir):
    lines = E.to_lines(event_modules(spark, sf_dir))
    found = W.all_findings(E.scan_lines(lines, ERROR_HANDLING), E.scan_lines(lines, SECURITY), E.scan_occurrences(lines, TYPE_ESCAPES_TS))
    scores = spark.createDataFrame([("error-handling", 50), ("security", 95), ("type-safety", 40)], "check string, score bigint")
    return W.action_groups(found, scores)


@named(
    "rule_categories",
    """WITH f AS (SELECT CASE event_type WHEN 'click' THEN 'react-hooks/exhaustive-deps' WHEN 'view' THEN 'jsx-a11y/alt-text' WHEN 'error' THEN 'react-compiler/react-compiler'
        WHEN 'purchase' THEN 'index-key' ELSE 'react/prop-types' END AS rule, CASE event_type WHEN 'click' THEN 'effects' WHEN 'view' THEN 'accessibility' WHEN 'error' THEN 'compiler-readiness'
        WHEN 'purchase' THEN 'rendering' ELSE 'component-structure' END AS category, CASE WHEN value > 400 THEN 'error' WHEN value > 350 THEN 'warning' ELSE 'info' END AS severity, user_id FROM events)
    SELECT category, min(rule) || '=' || count(*) AS rule_counts, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
      count(DISTINCT rule) AS rules, count(DISTINCT user_id) AS files, CAST(greatest(0, 100 - 25 * count(*) FILTER (severity = 'error') - 10 * count(*) FILTER (severity = 'warning') - 3 * count(*) FILTER (severity = 'info')) AS BIGINT) AS score
    FROM f GROUP BY category""",
)
def rule_categories(spark, sf_dir):
    """Linter findings read from events, with the counts of each category's rules written out."""
    events = table(spark, sf_dir, "events")
    rule = (
        F.when(F.col("event_type") == "click", "react-hooks/exhaustive-deps").when(F.col("event_type") == "view", "jsx-a11y/alt-text")
        .when(F.col("event_type") == "error", "react-compiler/react-compiler").when(F.col("event_type") == "purchase", "index-key").otherwise("react/prop-types")
    )
    severity = F.when(F.col("value") > 400, "error").when(F.col("value") > 350, "warning").otherwise("info")
    found = events.select(F.lit("app").alias("project"), F.col("user_id").cast("string").alias("path"), rule.alias("rule"), severity.alias("severity"))
    counts = F.transform(F.array_sort(F.map_entries("rule_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return W.rule_categories(found).withColumn("rule_counts", F.array_join(counts, ","))


# --- exports, imports, tests -------------------------------------------------------------
_STEPS = "exports AS (SELECT project, path, unnest(regexp_extract_all(content, 'export\\s+(?:async\\s+)?function\\s+(\\w+)', 1)) AS name FROM files)"


@named(
    "export_collisions",
    with_views(MODULES, _STEPS) + "SELECT name, count(*) AS exports, min(path) AS first_path, max(path) AS last_path FROM exports GROUP BY name HAVING count(*) > 1",
)
def export_collisions(spark, sf_dir):
    return M.export_collisions(event_modules(spark, sf_dir)).select("name", "exports", "first_path", "last_path")


@named("duplicate_exports", with_views(MODULES, _STEPS) + "SELECT name, count(*) AS exports, min(path) AS first_path FROM exports GROUP BY name HAVING count(*) > 1")
def duplicate_exports(spark, sf_dir):
    return M.duplicate_exports(event_modules(spark, sf_dir)).drop("project")


@named(
    "mixed_error_patterns",
    with_views(MODULES) + "SELECT path FROM files WHERE contains(content, 'throw new Error') AND contains(content, 'return null')",
)
def mixed_error_patterns(spark, sf_dir):
    return M.mixed_patterns(event_modules(spark, sf_dir)).select("path")


@named(
    "documented_exports",
    with_views(FACTS) + """SELECT count(*) AS exports, count(*) FILTER (k % 2 = 0) AS documented, CAST(floor(count(*) FILTER (k % 2 = 0)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS percent
    FROM facts WHERE event_type = 'signup'""",
)
def documented_exports(spark, sf_dir):
    return M.doc_coverage(event_modules(spark, sf_dir)).drop("project")


@named(
    "export_documentation",
    CODE + """SELECT l.path, l.line_no, coalesce(starts_with(p.line, '// '), false) AS documented FROM lines l LEFT JOIN lines p ON p.path = l.path AND p.line_no = l.line_no - 1
    WHERE starts_with(l.line, 'export function ')""",
)
def export_documentation(spark, sf_dir):
    return M.export_docs(event_modules(spark, sf_dir)).drop("project")


@named(
    "import_load",
    with_views(FACTS) + """, n AS (SELECT user_id, count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view') AS imports, count(*) FILTER (event_type = 'signup') AS exports FROM facts GROUP BY user_id)
    SELECT 'pkg' || (user_id % 10) || '/mod' || user_id || '.ts' AS path, imports, exports, imports > 15 AS heavy, imports > 8 AND exports <= 1 AS sink FROM n""",
)
def import_load(spark, sf_dir):
    return M.import_load(event_modules(spark, sf_dir)).drop("project")


@named(
    "import_edges",
    with_views(FACTS) + """SELECT DISTINCT 'pkg' || (user_id % 10) || '/mod' || user_id || '.ts' AS src, 'pkg' || (k % 10) || '/mod' || k || '.ts' AS dst,
      CASE event_type WHEN 'click' THEN 'static' WHEN 'view' THEN 'type' ELSE 'dynamic' END AS kind FROM facts
    WHERE event_type IN ('click', 'view', 'purchase') AND k <> user_id AND k IN (SELECT user_id FROM events)""",
)
def import_edges(spark, sf_dir):
    return I.import_edges(event_modules(spark, sf_dir)).drop("project")


@named(
    "edge_layers",
    with_views(FACTS) + """, e AS (SELECT DISTINCT user_id AS s, k AS d, event_type AS t FROM facts WHERE event_type IN ('click', 'view', 'purchase') AND k <> user_id AND k IN (SELECT user_id FROM events)),
    l AS (SELECT DISTINCT s, d, unnest(CASE t WHEN 'click' THEN ['static', 'type', 'dynamic'] WHEN 'view' THEN ['type'] ELSE ['dynamic'] END) AS layer FROM e)
    SELECT layer, count(*) AS edges FROM l GROUP BY layer""",
)
def edge_layers(spark, sf_dir):
    layers = I.edge_layers(I.import_edges(event_modules(spark, sf_dir)))
    return layers.groupBy("layer").agg(F.count(F.lit(1)).alias("edges"))


@named(
    "orphan_modules",
    with_views(FACTS) + """SELECT DISTINCT 'pkg' || (user_id % 10) || '/mod' || user_id || '.ts' AS path FROM events WHERE user_id NOT IN
      (SELECT k FROM facts WHERE event_type IN ('click', 'view', 'purchase') AND k <> user_id)""",
)
def orphan_modules(spark, sf_dir):
    files = event_modules(spark, sf_dir)
    return I.orphans(files, I.import_edges(files)).select("path")


@named(
    "test_pairing",
    """SELECT 'pkg' || (user_id % 10) || '/mod' || user_id || '.ts' AS path, bool_or(event_type = 'purchase' AND value > 150) AS paired FROM events GROUP BY user_id""",
)
def test_pairing(spark, sf_dir):
    files = event_modules(spark, sf_dir).select("project", "path").unionByName(event_tests(spark, sf_dir).select("project", "path"))
    return M.test_pairing(files).select("path", "paired")


@named(
    "test_pairing_percent",
    """WITH p AS (SELECT bool_or(event_type = 'purchase' AND value > 150) AS paired FROM events GROUP BY user_id)
    SELECT count(*) AS sources, count(*) FILTER (paired) AS paired, CAST(floor(count(*) FILTER (paired)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM p""",
)
def test_pairing_percent(spark, sf_dir):
    files = event_modules(spark, sf_dir).select("project", "path").unionByName(event_tests(spark, sf_dir).select("project", "path"))
    return M.pairing_percent(M.test_pairing(files)).drop("project")


_TEST_COUNTS = """t AS (SELECT user_id, count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'signup') + count(*) FILTER (event_type = 'purchase') AS assertions,
  count(*) FILTER (event_type = 'view') AS mocks, count(*) FILTER (event_type = 'signup') AS snapshots,
  count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS tests FROM facts
  WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150) GROUP BY user_id)"""


@named("test_pyramid", with_views(FACTS, _TEST_COUNTS) + "SELECT 'unit' AS layer, count(*) AS files, CAST(sum(assertions) AS BIGINT) AS assertions FROM t HAVING count(*) > 0")
def test_pyramid(spark, sf_dir):
    return M.test_pyramid(event_tests(spark, sf_dir)).drop("project")


@named(
    "test_quality",
    with_views(FACTS, _TEST_COUNTS) + """, s AS (SELECT CAST(sum(assertions) AS BIGINT) AS assertions, CAST(sum(mocks) AS BIGINT) AS mocks, CAST(sum(snapshots) AS BIGINT) AS snapshots,
      CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(CASE WHEN assertions = 0 THEN tests ELSE 0 END) AS BIGINT) AS unasserted FROM t)
    SELECT *, floor(assertions::DOUBLE / tests * 10 + 0.5) / 10 AS per_test, floor(mocks::DOUBLE / assertions * 100 + 0.5) / 100 AS mock_ratio,
      floor(snapshots::DOUBLE / assertions * 100 + 0.5) / 100 AS snapshot_ratio FROM s""",
)
def test_quality(spark, sf_dir):
    return M.test_quality(event_tests(spark, sf_dir)).drop("project")


@named("functions")
def functions(spark, sf_dir):
    """Functions of every module with length and complexity (checked on fixtures)."""
    return C.functions(event_modules(spark, sf_dir))


@named(
    "generic_names",
    """SELECT event_id AS line_no, CASE event_type WHEN 'click' THEN 'handle' WHEN 'view' THEN 'data' END AS name FROM events WHERE event_type IN ('click', 'view')""",
)
def generic_names(spark, sf_dir):
    """Export lines written from events: generic functions and variables, and descriptive ones."""
    text = (
        F.when(F.col("event_type") == "click", "export function handle() {}").when(F.col("event_type") == "view", "export const data = 1")
        .when(F.col("event_type") == "error", "export const handleError = 1").otherwise(F.concat(F.lit("export function step"), "user_id", F.lit("() {}")))
    )
    lines = table(spark, sf_dir, "events").select(F.lit("app").alias("project"), F.lit("a.ts").alias("path"), F.col("event_id").alias("line_no"), text.alias("line"))
    return N.generic_names(lines).select("line_no", "name")


_NAMING = """words AS (SELECT source, lang, doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS word FROM documents),
  files AS (SELECT DISTINCT source AS project, lang || '/' || base || doc_id || '.tsx' AS path, base FROM (SELECT *, CASE WHEN source IN ('src1', 'src2', 'src3') OR len(word) < 4 THEN lower(word) ELSE upper(word[1]) || lower(word[2:]) END AS base FROM words))"""


def component_files(documents: DataFrame) -> DataFrame:
    """(project, path) of the component files, each once; a document without source, language or number has none.

    A path tells its document, so words are made distinct inside each text. Only texts of documents that
    come more than once are shuffled, a row per word.
    """
    key = ["source", "lang", "doc_id"]
    documents = documents.select(*key, "text").na.drop(subset=key)
    # Written, so that Spark knows its size and sends it to the texts where it is small.
    repeated = written(documents.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeated-documents")
    lower = F.col("source").isin("src1", "src2", "src3")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})")))
    bases = F.array_distinct(F.transform(words, lambda w: F.when(lower | (F.length(w) < 4), F.lower(w)).otherwise(F.initcap(w))))
    path = F.concat("lang", F.lit("/"), "base", "doc_id", F.lit(".tsx")).alias("path")
    paths = lambda rows: rows.select(*key, F.explode(bases).alias("base")).select(F.col("source").alias("project"), path)
    once, again = documents.join(repeated, key, "left_anti"), documents.join(repeated, key, "left_semi")
    return paths(once).unionByName(paths(again).distinct())


@named(
    "naming_convention",
    with_views(_NAMING) + """, s AS (SELECT project, count(*) AS n, count(*) FILTER (regexp_matches(base, '^[A-Z]')) AS p FROM files GROUP BY project)
    SELECT project, path FROM files WHERE regexp_matches(base, '^[a-z]') AND project IN (SELECT project FROM s WHERE NOT (n >= 3 AND p < n / 2.0))""",
)
def naming_convention(spark, sf_dir):
    """Component files named after the words of each document, in lower case for three sources and for short words."""
    files = component_files(table(spark, sf_dir, "documents"))
    return M.naming_convention(files.withColumn("content", F.lit("export function Card() {}")))


@named(
    "binding_reconciliation",
    """WITH d AS (SELECT DISTINCT user_id AS project, 'B' || CAST(props->>'$.k' AS INTEGER) AS name FROM events WHERE event_type = 'click'),
    u AS (SELECT DISTINCT user_id AS project, 'B' || CAST(props->>'$.k' AS INTEGER) AS name FROM events WHERE event_type = 'view'),
    k AS (SELECT DISTINCT user_id AS project, 'B' || CAST(props->>'$.k' AS INTEGER) AS name FROM events WHERE event_type = 'error')
    SELECT project, name, 'unused-binding' AS rule, 'warning' AS severity FROM d ANTI JOIN u USING (project, name)
    UNION ALL SELECT project, name, CASE WHEN known THEN 'secret-binding' ELSE 'undeclared-binding' END, CASE WHEN known THEN 'info' ELSE 'error' END
    FROM (SELECT project, name, EXISTS (SELECT 1 FROM k WHERE k.project = x.project AND k.name = x.name) AS known FROM (SELECT * FROM u ANTI JOIN d USING (project, name)) x)""",
)
def binding_reconciliation(spark, sf_dir):
    """Bindings declared by clicks, used by views and known from errors."""
    names = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.concat(F.lit("B"), event_number().cast("string")).alias("name"), "event_type")
    side = lambda t: names.where(F.col("event_type") == t)
    return I.reconcile(side("click"), side("view"), side("error"))


@named(
    "key_drift",
    """WITH a AS (SELECT DISTINCT user_id AS project, 'K' || CAST(props->>'$.k' AS INTEGER) AS name FROM events WHERE event_type = 'purchase'),
    b AS (SELECT DISTINCT user_id AS project, 'K' || CAST(props->>'$.k' AS INTEGER) AS name FROM events WHERE event_type = 'signup')
    SELECT project, name, 'undocumented' AS drift, 'warning' AS severity FROM a ANTI JOIN b USING (project, name)
    UNION ALL SELECT project, name, 'missing', 'info' FROM b ANTI JOIN a USING (project, name)""",
)
def key_drift(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.concat(F.lit("K"), event_number().cast("string")).alias("name"), "event_type")
    return I.key_drift(names.where("event_type = 'purchase'"), names.where("event_type = 'signup'"))


_DEPS = """deps AS (SELECT DISTINCT user_id AS project, CASE CAST(props->>'$.k' AS INTEGER) % 12 WHEN 0 THEN 'moment' WHEN 1 THEN 'lodash' WHEN 2 THEN 'lodash-es' WHEN 3 THEN 'antd'
  WHEN 4 THEN 'tailwindcss' WHEN 5 THEN 'bootstrap' WHEN 6 THEN 'styled-components' WHEN 7 THEN 'vaul' WHEN 8 THEN 'rxjs' ELSE 'left-pad' END AS name FROM events WHERE event_type = 'purchase')"""


def event_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages bought: user = project."""
    names = ("moment", "lodash", "lodash-es", "antd", "tailwindcss", "bootstrap", "styled-components", "vaul", "rxjs")
    pick = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.pmod(event_number(), F.lit(12))), F.lit("left-pad"))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return bought.select(F.col("user_id").alias("project"), pick.alias("name")).distinct()


@named(
    "dependency_catalogue",
    with_views(_DEPS) + """SELECT project, name, CASE name WHEN 'styled-components' THEN 'runtime-css' ELSE 'heavy-dependency' END AS rule FROM deps WHERE name IN ('moment', 'lodash', 'rxjs', 'styled-components')
    UNION ALL SELECT project, name, 'non-esm-dep' FROM deps d WHERE name = 'lodash' AND NOT EXISTS (SELECT 1 FROM deps o WHERE o.project = d.project AND o.name = 'lodash-es')""",
)
def dependency_catalogue(spark, sf_dir):
    return I.dependency_catalogue(event_deps(spark, sf_dir)).select("project", "name", "rule")


@named(
    "framework_conflicts",
    with_views(_DEPS) + """SELECT project, string_agg(f, ' + ' ORDER BY f) AS frameworks FROM (SELECT project, CASE name WHEN 'antd' THEN 'Ant Design' WHEN 'tailwindcss' THEN 'Tailwind' ELSE 'Bootstrap' END AS f
      FROM deps WHERE name IN ('antd', 'tailwindcss', 'bootstrap')) GROUP BY project HAVING count(*) > 1""",
)
def framework_conflicts(spark, sf_dir):
    return I.framework_conflicts(event_deps(spark, sf_dir))


@named(
    "html_sink_grades",
    """WITH f AS (SELECT user_id AS project, event_type || '.tsx' AS path, event_id AS line_no FROM events WHERE event_type IN ('view', 'error')),
    s AS (SELECT DISTINCT user_id AS project, 'view.tsx' AS path FROM events WHERE event_type = 'click')
    SELECT f.project, f.path, line_no, CASE WHEN s.path IS NULL THEN 'error' ELSE 'info' END AS severity FROM f LEFT JOIN s ON s.project = f.project AND s.path = f.path""",
)
def html_sink_grades(spark, sf_dir):
    """Raw-HTML lines (views and errors) in files whose user also imported a sanitiser (clicks)."""
    events = table(spark, sf_dir, "events")
    lines = events.where("event_type IN ('view', 'error')").select(
        F.col("user_id").alias("project"), F.concat("event_type", F.lit(".tsx")).alias("path"), F.col("event_id").alias("line_no"),
        F.lit("<div dangerouslySetInnerHTML={{ __html: x }} />").alias("line"),
    )
    imports = events.where("event_type = 'click'").select(
        F.col("user_id").alias("project"), F.lit("view.tsx").alias("path"), F.lit("import p from 'dompurify';").alias("content")
    )
    return I.grade_html_sinks(E.scan_lines(lines, SECURITY), I.sanitizer_imports(imports)).select("project", "path", "line_no", "severity")


# --- style, commits, migrations ---------------------------------------------------------------
_STYLE = """lines AS (SELECT user_id AS project, 'a.tsx' AS path, event_id AS line_no, CASE event_type WHEN 'click' THEN '<div className="flex p-4 rounded border shadow">' WHEN 'view' THEN '<p style={{ margin: 0 }}>'
  WHEN 'error' THEN 'color: "#ff' || (10 + CAST(props->>'$.k' AS INTEGER) % 90) || '00"' WHEN 'purchase' THEN 'padding: ' || CAST(props->>'$.k' AS INTEGER) || 'px' ELSE 'import { X } from ''' || CASE CAST(props->>'$.k' AS INTEGER) % 3 WHEN 0 THEN 'lucide-react' WHEN 1 THEN 'react-icons/fi' ELSE 'vue' END || '''' END AS line,
  event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"""


def style_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component line per event: classes, inline styles, colours, spacing, icon imports."""
    k = event_number()
    library = F.when(F.pmod(k, F.lit(3)) == 0, "lucide-react").when(F.pmod(k, F.lit(3)) == 1, "react-icons/fi").otherwise("vue")
    text = (
        F.when(F.col("event_type") == "click", '<div className="flex p-4 rounded border shadow">')
        .when(F.col("event_type") == "view", "<p style={{ margin: 0 }}>")
        .when(F.col("event_type") == "error", F.concat(F.lit('color: "#ff'), (F.pmod(k, F.lit(90)) + 10).cast("string"), F.lit('00"')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("padding: "), k.cast("string"), F.lit("px")))
        .otherwise(F.concat(F.lit("import { X } from '"), library, F.lit("'")))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.lit("a.tsx").alias("path"), F.col("event_id").alias("line_no"), text.alias("line"))


@named(
    "style_consistency",
    with_views(_STYLE) + """SELECT project, count(*) FILTER (event_type = 'click') AS tailwind, count(*) FILTER (event_type = 'view') AS inline, count(*) FILTER (event_type = 'click') AS class_names,
    count(*) FILTER (event_type = 'error') AS colours, count(DISTINCT k) FILTER (event_type = 'purchase' AND k > 2 AND k % 4 <> 0) AS off_scale,
    count(*) FILTER (event_type = 'click') >= 3 AND count(*) FILTER (event_type = 'view') >= 3 AS mixed,
    CASE WHEN count(*) FILTER (event_type IN ('click', 'view')) > 0 THEN floor(count(*) FILTER (event_type = 'view')::DOUBLE / count(*) FILTER (event_type IN ('click', 'view')) * 100 + 0.5) / 100 ELSE 0.0 END AS inline_ratio
    FROM lines GROUP BY project""",
)
def style_consistency(spark, sf_dir):
    styles = M.style_consistency(style_lines(spark, sf_dir))
    return styles.select("project", "tailwind", "inline", "class_names", "colours", "off_scale", "mixed", "inline_ratio")


@named(
    "repeated_class_strings",
    with_views(_STYLE) + "SELECT project, 'flex p-4 rounded border shadow' AS classes, count(*) AS uses FROM lines WHERE event_type = 'click' GROUP BY project HAVING count(*) >= 3",
)
def repeated_class_strings(spark, sf_dir):
    return M.repeated_class_strings(style_lines(spark, sf_dir))


@named(
    "mixed_icon_libraries",
    with_views(_STYLE) + """SELECT project, 'lucide,react-icons' AS libraries, 2::BIGINT AS n FROM lines WHERE event_type = 'signup' AND k % 3 < 2 GROUP BY project HAVING count(DISTINCT k % 3) = 2""",
)
def mixed_icon_libraries(spark, sf_dir):
    return M.mixed_libraries(style_lines(spark, sf_dir))


@named(
    "commit_quality",
    """WITH c AS (SELECT user_id AS project, CASE event_type WHEN 'click' THEN 'fix' WHEN 'view' THEN 'WIP' WHEN 'error' THEN 'Repair the parser' WHEN 'purchase' THEN 'v1' ELSE 'Add a report page' END AS m,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT project, count(*) AS commits, count(*) FILTER (m IN ('fix', 'WIP', 'v1')) AS poor, count(*) FILTER (m IN ('fix', 'WIP', 'v1')) * 2 > count(*) AS flagged FROM c WHERE r <= 20 GROUP BY project""",
)
def commit_quality(spark, sf_dir):
    message = (
        F.when(F.col("event_type") == "click", "fix").when(F.col("event_type") == "view", "WIP").when(F.col("event_type") == "error", "Repair the parser")
        .when(F.col("event_type") == "purchase", "v1").otherwise("Add a report page")
    )
    commits = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project"), F.col("ts").alias("committed_at"), F.col("event_id").alias("sha"), message.alias("message")
    )
    return M.commit_quality(commits)


@named(
    "migration_audit",
    """WITH m AS (SELECT user_id AS project, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(props->>'$.k' AS INTEGER) END AS n, event_type = 'error' AS d FROM events),
    g AS (SELECT project, n, count(*) AS c, count(*) FILTER (d) AS drops FROM m GROUP BY ALL)
    SELECT project, CAST(sum(c) AS BIGINT) AS migrations, CAST(coalesce(sum(c) FILTER (n IS NULL), 0) AS BIGINT) AS unnumbered, count(*) FILTER (n IS NOT NULL AND c > 1) AS repeated_numbers,
      CAST(sum(drops) AS BIGINT) AS unsafe_drops FROM g GROUP BY project""",
)
def migration_audit(spark, sf_dir):
    """Migration files written from events: views unnumbered, errors dropping a table."""
    number = F.when(F.col("event_type") == "view", "x").otherwise(event_number().cast("string"))
    files = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project"), F.concat(F.lit("db/"), number, F.lit("_"), "event_id", F.lit(".sql")).alias("path"),
        F.when(F.col("event_type") == "error", "drop table t;").otherwise("create table t (a int);").alias("content"),
    )
    return M.migration_audit(files).drop("dir")


@named(
    "documentation_scores",
    """WITH n AS (SELECT source, lang, len(string_split(text, chr(10))) AS n FROM documents),
    p AS (SELECT source AS project, coalesce(max(CASE WHEN lang = 'en' THEN CASE WHEN n < 5 THEN 30 WHEN n < 20 THEN 60 ELSE 100 END END), 0) AS readme,
      coalesce(max(CASE WHEN lang = 'fr' THEN 100 END), 30) AS changelog FROM n GROUP BY source)
    SELECT project, CAST(readme AS BIGINT) AS readme, CAST(changelog AS BIGINT) AS changelog, 100::BIGINT AS exports, CAST(floor(readme * 0.4::DOUBLE + 100 * 0.4::DOUBLE + changelog * 0.2::DOUBLE + 0.5) AS BIGINT) AS score FROM p""",
)
def documentation_scores(spark, sf_dir):
    """English documents stand for the README of their source, French ones for its changelog."""
    path = F.when(F.col("lang") == "en", "README.md").when(F.col("lang") == "fr", "CHANGELOG.md").otherwise(F.concat(F.lit("src/"), "doc_id"))
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), path.alias("path"), F.col("text").alias("content"))
    return M.docs_scores(files)


# --- path policy ----------------------------------------------------------------------------------
_ENDINGS = "CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.min.js' WHEN 'de' THEN '.html' WHEN 'es' THEN '.md' ELSE '.txt' END"
_DIRS = {
    "src0": "src", "src1": "node_modules/pkg", "src2": "dist", "src3": "src/tests", "src4": "docs", "src5": ".yarn/cache", "src6": "vendor/lib",
    "src7": "packages/a/src", "src8": "packages/b/src", "src9": "coverage", "src10": "src/.cache", "src11": "legacy/old", "src12": "scripts",
    "src13": "packages/a", "src14": "assets", "src15": "public", "src16": "config", "src17": "build", "src18": "test", "src19": "lib",
}
_POLICY_FILES = (
    "files AS (SELECT lang AS project, CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DIRS.items()) + " ELSE 'misc' END AS dir, "
    "regexp_matches(text, 'token = \"') AS secretive, CASE WHEN regexp_matches(text, 'token = \"') THEN '.env.' || doc_id ELSE 'd' || doc_id || " + _ENDINGS + " END AS name, n_chars AS size FROM documents)"
)
POLICY = L.Policy(config_patterns=("legacy/**", "*9.md"), user_names=("scripts",), gitignore_names=("packages/b",))
_DECIDED = _POLICY_FILES + """, e AS (SELECT *, dir || '/' || name AS path, list_filter([
    CASE WHEN dir = 'node_modules/pkg' THEN 'dependency' END, CASE WHEN dir = 'dist' OR dir = 'build' THEN 'build-output' END,
    CASE WHEN dir = '.yarn/cache' THEN 'framework-cache' END, CASE WHEN dir = 'vendor/lib' THEN 'dependency' END, CASE WHEN dir = 'coverage' THEN 'test-output' END,
    CASE WHEN dir = 'src/.cache' THEN 'framework-cache' END, CASE WHEN dir = 'legacy/old' THEN 'config-ignore' END, CASE WHEN name LIKE '%9.md' THEN 'config-ignore' END,
    CASE WHEN dir = 'scripts' THEN 'user-ignore' END, CASE WHEN dir = 'packages/b/src' THEN 'gitignore-directory' END,
    CASE WHEN name LIKE '%.min.js' THEN 'generated-file' END], lambda r: r IS NOT NULL) AS why FROM files),
  decided AS (SELECT *, CASE WHEN len(why) = 0 THEN 'include' WHEN secretive AND len(list_filter(why, lambda r: r NOT IN ('config-ignore', 'user-ignore', 'gitignore-directory'))) = 0 THEN 'include-security-sensitive' ELSE 'exclude' END AS action,
    len(list_filter(why, lambda r: r IN ('build-output', 'framework-cache', 'test-output', 'generated-file'))) > 0 AS generated,
    array_to_string(list_sort(list_distinct(list_concat(why, CASE WHEN secretive THEN ['security-sensitive'] ELSE [] END))), ',') AS reasons,
    CASE WHEN dir IN ('src/tests', 'test') THEN 'test' WHEN name LIKE '%.html' THEN 'html' WHEN name LIKE '%.md' THEN 'doc' WHEN secretive THEN 'env' WHEN name LIKE '%.ts' OR name LIKE '%.js' THEN 'source' ELSE 'unknown' END AS kind FROM e)"""


def decided_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify_files(L.apply_path_policy(policy_files(spark, sf_dir), POLICY))


@named(
    "path_policy",
    with_views(_DECIDED) + """SELECT project, path, action, generated, reasons, CASE WHEN generated THEN 'generated' WHEN secretive THEN 'security-sensitive' ELSE 'normal' END AS classification FROM decided""",
)
def path_policy(spark, sf_dir):
    decided = L.apply_path_policy(policy_files(spark, sf_dir), POLICY)
    return decided.select("project", "path", "action", "generated", F.array_join("reasons", ",").alias("reasons"), "classification")


@named("file_kinds", with_views(_DECIDED) + "SELECT project, path, kind, kind = 'test' AS is_test FROM decided")
def file_kinds(spark, sf_dir):
    return decided_files(spark, sf_dir).select("project", "path", "kind", "is_test")


@named(
    "inventory_summary",
    with_views(_DECIDED) + """SELECT kind AS name, count(*) AS files, 'kind' AS facet FROM decided WHERE action = 'include' GROUP BY kind
    UNION ALL SELECT r, count(*), 'ignored' FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM decided WHERE action = 'exclude') WHERE r <> 'security-sensitive' GROUP BY r""",
)
def inventory_summary(spark, sf_dir):
    return L.inventory_summary(decided_files(spark, sf_dir))


@named(
    "selected_sources",
    with_views(_DECIDED) + "SELECT project, path FROM decided WHERE action <> 'exclude' AND kind = 'source' AND NOT generated AND size <= 1000000",
)
def selected_sources(spark, sf_dir):
    return L.select_files(decided_files(spark, sf_dir), "source").select("project", "path")


@named("selected_tests", with_views(_DECIDED) + "SELECT project, path FROM decided WHERE action <> 'exclude' AND kind = 'test' AND NOT generated")
def selected_tests(spark, sf_dir):
    return L.select_files(decided_files(spark, sf_dir), "test").select("project", "path")


@named(
    "policy_reasons",
    with_views(_POLICY_FILES) + """, e AS (
      SELECT unnest(CASE dir WHEN 'node_modules/pkg' THEN ['node_modules'] WHEN 'dist' THEN ['dist'] WHEN 'build' THEN ['build'] WHEN 'vendor/lib' THEN ['vendor'] WHEN 'coverage' THEN ['coverage'] WHEN 'src/.cache' THEN ['.cache'] ELSE [] END) AS v FROM files)
    SELECT 'default-directory' AS source, CASE WHEN v IN ('node_modules', 'vendor') THEN 'dependency' WHEN v IN ('dist', 'build') THEN 'build-output' WHEN v = 'coverage' THEN 'test-output' ELSE 'framework-cache' END AS reason, 40::BIGINT AS precedence, count(*) AS paths FROM e GROUP BY ALL
    UNION ALL SELECT 'generated-prefix', 'framework-cache', 41, count(*) FROM files WHERE dir = '.yarn/cache' HAVING count(*) > 0
    UNION ALL SELECT 'default-file-pattern', 'generated-file', 40, count(*) FROM files WHERE name LIKE '%.min.js' HAVING count(*) > 0
    UNION ALL SELECT 'config-ignore', 'config-ignore', 20, count(*) FILTER (dir = 'legacy/old') + count(*) FILTER (name LIKE '%9.md') FROM files HAVING count(*) FILTER (dir = 'legacy/old' OR name LIKE '%9.md') > 0
    UNION ALL SELECT 'user-ignore', 'user-ignore', 30, count(*) FROM files WHERE dir = 'scripts' HAVING count(*) > 0
    UNION ALL SELECT 'gitignore-directory', 'gitignore-directory', 50, count(*) FROM files WHERE dir = 'packages/b/src' HAVING count(*) > 0
    UNION ALL SELECT 'security-sensitive', 'security-sensitive', 10, count(*) FROM files WHERE secretive HAVING count(*) > 0""",
)
def policy_reasons(spark, sf_dir):
    return L.policy_reasons(L.apply_path_policy(policy_files(spark, sf_dir), POLICY))


_PROJECTS = (("root", "."), ("a", "packages/a"), ("a-src", "packages/a/src"), ("src", "src"), ("vendored", "vendor"))


@named(
    "assigned_projects",
    with_views(_POLICY_FILES) + """SELECT project, dir || '/' || name AS path, CASE WHEN dir = 'packages/a/src' THEN 'a-src' WHEN dir = 'packages/a' THEN 'a' WHEN dir IN ('src', 'src/tests', 'src/.cache') THEN 'src'
      WHEN dir = 'vendor/lib' THEN 'vendored' ELSE 'root' END AS project_id FROM files""",
)
def assigned_projects(spark, sf_dir):
    projects = spark.createDataFrame(list(_PROJECTS), "project_id string, project_path string")
    return L.assign_project(policy_files(spark, sf_dir), projects).select("project", "path", "project_id")


@named(
    "files_of_projects",
    with_views(_POLICY_FILES) + """SELECT project, dir || '/' || name AS path, CASE WHEN dir LIKE 'src%' THEN 'src' WHEN dir LIKE 'vendor%' THEN 'vendor' ELSE 'packages/a' END AS root
    FROM files WHERE dir IN ('packages/a', 'packages/a/src', 'src', 'src/tests', 'src/.cache', 'vendor/lib')""",
)
def files_of_projects(spark, sf_dir):
    projects = spark.createDataFrame([p for p in _PROJECTS if p[1] != "."], "project_id string, project_path string")
    return L.files_for_projects(policy_files(spark, sf_dir), projects).select("project", "path", "root")


@named(
    "directory_sizes",
    with_views(_POLICY_FILES) + """, up AS (SELECT project, size, unnest(list_distinct(['.', string_split(dir, '/')[1], array_to_string(string_split(dir, '/')[1:2], '/'), dir])) AS dir FROM files)
    SELECT project, dir, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM up GROUP BY ALL""",
)
def directory_sizes(spark, sf_dir):
    return M.directory_sizes(policy_files(spark, sf_dir))


@named(
    "test_block_audit",
    with_views(FACTS, TESTS) + """, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM tests)
    SELECT path, line_no, 'empty-test' AS rule, 'warning' AS severity FROM l WHERE starts_with(line, 'it(')""",
)
def test_block_audit(spark, sf_dir):
    """One-line tests have no body of their own, so each counts as empty."""
    return B.audit_tests(event_tests(spark, sf_dir)).select("path", "line_no", "rule", "severity")


@named(
    "tracked_files",
    with_views(_POLICY_FILES) + "SELECT project, dir || '/' || name AS path, 'large-file' AS rule FROM files WHERE size > 5000",
)
def tracked_files(spark, sf_dir):
    return B.tracked_files(policy_files(spark, sf_dir), large=5000).select("project", "path", "rule")
