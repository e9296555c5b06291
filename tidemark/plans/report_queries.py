"""Queries on CI artifacts. Each event is first written as one artifact text, which is then parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.plans.registry import named
from tidemark.sources import reports as R
from tidemark.sources.corpus import event_number, table


def artifacts(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), body.alias("body"))


def _id() -> Column:
    return F.col("event_id").cast("string")


@named(
    "eslint_findings",
    """SELECT user_id AS project, 'src/' || event_type || '.ts' AS path, CAST(props->>'$.k' AS BIGINT) AS line_no, 'rule-' || event_type AS rule,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, 'event ' || event_id AS message FROM events
    UNION ALL SELECT user_id, 'src/' || event_type || '.ts', 1, 'second', 'error', 'again' FROM events""",
)
def eslint_findings(spark, sf_dir):
    def message(severity: Column, text: Column, line: Column, rule: Column) -> Column:
        return F.struct(severity.alias("severity"), text.alias("message"), line.alias("line"), rule.alias("ruleId"))

    first = message(F.when(F.col("event_type") == "error", 2).otherwise(1), F.concat(F.lit("event "), _id()), event_number(), F.concat(F.lit("rule-"), "event_type"))
    second = message(F.lit(2), F.lit("again"), F.lit(1), F.lit("second"))
    body = F.to_json(F.array(F.struct(F.concat(F.lit("src/"), "event_type", F.lit(".ts")).alias("filePath"), F.array(first, second).alias("messages"))))
    return R.parse_lint_reports(artifacts(spark, sf_dir, body), "eslint").select("project", "path", "line_no", "rule", "severity", "message")


@named(
    "stylelint_findings",
    """SELECT user_id AS project, event_type || '.css' AS path, CAST(props->>'$.k' AS BIGINT) AS line_no, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity,
    'value ' || event_id || ' (no-' || event_type || ')' AS message FROM events""",
)
def stylelint_findings(spark, sf_dir):
    warning = F.struct(
        F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"), F.concat(F.lit("value "), _id()).alias("text"),
        event_number().alias("line"), F.concat(F.lit("no-"), "event_type").alias("rule"),
    )
    body = F.to_json(F.array(F.struct(F.concat("event_type", F.lit(".css")).alias("source"), F.array(warning).alias("warnings"))))
    return R.parse_lint_reports(artifacts(spark, sf_dir, body), "stylelint").select("project", "path", "line_no", "severity", "message")


@named(
    "biome_findings",
    """SELECT user_id AS project, event_type AS path, 'lint/style' AS rule, 'info' AS severity, 'd' || event_id AS message FROM events WHERE event_type <> 'error'
    UNION ALL SELECT user_id, 'error', 'parse', 'error', 'broken' FROM events WHERE event_type = 'error' GROUP BY user_id""",
)
def biome_findings(spark, sf_dir):
    """Parse errors of a file count once; every other diagnostic is kept."""
    bad = F.col("event_type") == "error"
    plain = F.concat(
        F.lit('{"diagnostics":[{"category":"'), F.when(bad, "parse").otherwise("lint/style"), F.lit('","severity":"'), F.when(bad, "error").otherwise("hint"),
        F.lit('","description":"'), F.when(bad, "broken").otherwise(F.concat(F.lit("d"), _id())), F.lit('","location":{"path":'),
        F.when(bad, F.lit('{"file":"error"}')).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))), F.lit("}}]}"),
    )
    return R.parse_lint_reports(artifacts(spark, sf_dir, plain), "biome").select("project", "path", "rule", "severity", "message")


@named(
    "tsc_findings",
    """SELECT user_id AS project, 'src/' || event_type || '.ts' AS path, CAST(props->>'$.k' AS BIGINT) AS line_no, 'TS' || (2000 + CAST(props->>'$.k' AS INTEGER)) AS rule, 'Type ' || event_id || ' is wrong.' AS message FROM events WHERE event_type <> 'view'""",
)
def tsc_findings(spark, sf_dir):
    k = event_number()
    line = F.concat(F.lit("src/"), "event_type", F.lit(".ts("), k.cast("string"), F.lit(",5): error TS"), (k + 2000).cast("string"), F.lit(": Type "), _id(), F.lit(" is wrong."))
    body = F.concat(F.lit("Starting compilation\n"), F.when(F.col("event_type") == "view", "No problem").otherwise(line), F.lit("\nDone"))
    return R.parse_compiler_log(artifacts(spark, sf_dir, body)).select("project", "path", "line_no", "rule", "message")


@named(
    "dart_findings",
    """SELECT user_id AS project, 'lib/' || event_type || '.dart' AS path, CAST(props->>'$.k' AS BIGINT) AS line_no, 'r' || event_id AS rule,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity, 'm' || event_id AS message FROM events""",
)
def dart_findings(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("INFO")
    row = F.concat_ws("|", level, F.lit("LINT"), F.concat(F.lit("r"), _id()), F.concat(F.lit("lib/"), "event_type", F.lit(".dart")), event_number().cast("string"), F.lit("1"), F.lit("2"), F.concat(F.lit("m"), _id()))
    return R.parse_compiler_log(artifacts(spark, sf_dir, F.concat(row, F.lit("\nshort|line"))), "dart").select("project", "path", "line_no", "rule", "severity", "message")


@named(
    "dead_code",
    """SELECT user_id AS project, 'export' AS kind, 'src/a.ts' AS path, 'e' || event_id AS name FROM events WHERE event_type IN ('click', 'view')
    UNION ALL SELECT user_id, 'dependency', 'src/a.ts', 'left-pad' FROM events WHERE event_type IN ('click', 'view')
    UNION ALL SELECT user_id, 'file', '', 'f' || event_id FROM events WHERE event_type NOT IN ('click', 'view')""",
)
def dead_code(spark, sf_dir):
    """Clicks and views use the per-file report shape, the others the flat one."""
    grouped = F.concat(F.lit('{"issues":[{"file":"src/a.ts","exports":[{"name":"e'), _id(), F.lit('","line":3}],"devDependencies":["left-pad"]}]}'))
    flat = F.concat(F.lit('{"files":["f'), _id(), F.lit('"],"exports":[]}'))
    body = F.when(F.col("event_type").isin("click", "view"), grouped).otherwise(flat)
    return R.parse_dead_code(artifacts(spark, sf_dir, body))


@named(
    "dead_code_scores",
    """WITH c AS (SELECT user_id AS project, count(*) FILTER (event_type NOT IN ('click', 'view')) AS f, count(*) FILTER (event_type IN ('click', 'view')) AS d FROM events GROUP BY user_id)
    SELECT project, CAST(floor(CASE WHEN f + d = 0 THEN 100 ELSE greatest(0, 100 - least(90, f * 10.0 + d * 8 + d * 2)) END + 0.5) AS BIGINT) AS score FROM c""",
)
def dead_code_scores(spark, sf_dir):
    c = dead_code(spark, sf_dir).groupBy("project").agg(
        F.count_if(F.col("kind") == "file").alias("f"), F.count_if(F.col("kind") == "dependency").alias("d"), F.count_if(F.col("kind") == "export").alias("e")
    )
    return c.select("project", S.dead_code_score(F.col("f"), F.col("d"), F.col("e"), F.lit(True)).alias("score"))


@named(
    "audit_totals",
    """SELECT user_id AS project, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(props->>'$.k' AS INTEGER) ELSE 0 END) + count(*) FILTER (event_type = 'error') AS BIGINT) AS critical,
    CAST(sum(CASE WHEN event_type = 'click' THEN 2 ELSE 0 END) AS BIGINT) AS high, count(*) FILTER (event_type = 'view') AS moderate, count(*) FILTER (event_type IN ('purchase', 'signup')) AS low FROM events GROUP BY user_id""",
)
def audit_totals(spark, sf_dir):
    """Clicks as npm totals, the other events as single advisories."""
    npm = F.concat(F.lit('{"metadata":{"vulnerabilities":{"critical":'), event_number().cast("string"), F.lit(',"high":2}}}'))
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "moderate").otherwise("odd")
    pnpm = F.concat(F.lit('{"advisories":{"'), _id(), F.lit('":{"severity":"'), level, F.lit('"}}}'))
    parsed = R.parse_audit(artifacts(spark, sf_dir, F.when(F.col("event_type") == "click", npm).otherwise(pnpm)))
    return parsed.groupBy("project").agg(*[F.sum(c).alias(c) for c in ("critical", "high", "moderate", "low")])


@named(
    "outdated_packages",
    """SELECT user_id AS project, count(*) AS outdated, count(*) FILTER (CAST(props->>'$.k' AS INTEGER) % 3 <> 2) AS major_behind FROM events GROUP BY user_id""",
)
def outdated_packages(spark, sf_dir):
    k = event_number()
    latest = F.when(k % 3 == 2, F.concat(k.cast("string"), F.lit(".9.1"))).otherwise(F.concat((k + 1).cast("string"), F.lit(".0.0")))
    body = F.concat(F.lit('{"p'), _id(), F.lit('":{"current":"'), k.cast("string"), F.lit('.0.3","latest":"'), latest, F.lit('"}}'))
    return R.outdated_summary(R.parse_outdated(artifacts(spark, sf_dir, body)))


def run_body() -> Column:
    """A JSON test run of three cases behind some log text; purchases print no report and signups ran nothing."""
    bad = F.col("event_type") == "error"
    case = F.concat(
        F.lit('{"title":"works","ancestorTitles":["a","b"],"status":"passed","duration":'), event_number().cast("string"),
        F.lit('},{"fullName":"full name","status":"'), F.when(bad, "failed").otherwise("passed"), F.lit('","duration":'), F.round("value", 0).cast("bigint").cast("string"),
        F.lit(',"failureMessages":["x","y"]},{"title":"later","status":"'), F.when(F.col("event_type") == "view", "pending").otherwise("passed"), F.lit('"}'),
    )
    passed = F.when(bad | (F.col("event_type") == "view"), 2).otherwise(3)
    report = F.concat(
        F.lit("log line\n"), F.lit('{"numPassedTests":'), passed.cast("string"), F.lit(',"numFailedTests":'), F.when(bad, "1").otherwise("0"),
        F.lit(',"numTotalTests":3,"testResults":[{"name":"t'), _id(), F.lit('.test.ts","assertionResults":['), case, F.lit("]}]} bye"),
    )
    empty = F.lit('{"numPassedTests":0,"numFailedTests":0,"numTotalTests":0,"testResults":[]}')
    return F.when(F.col("event_type") == "purchase", "no report").when(F.col("event_type") == "signup", empty).otherwise(report)


@named(
    "test_cases",
    """WITH e AS (SELECT user_id AS project, 't' || event_id || '.test.ts' AS file, event_type, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value, 0) AS BIGINT) AS v FROM events WHERE event_type NOT IN ('purchase', 'signup'))
    SELECT project, file, 'a b works' AS name, 'passed' AS status, k AS duration_ms, NULL::VARCHAR AS error FROM e
    UNION ALL SELECT project, file, 'full name', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END, v, CASE WHEN event_type = 'error' THEN 'x' || chr(10) || 'y' END FROM e
    UNION ALL SELECT project, file, 'later', CASE WHEN event_type = 'view' THEN 'skipped' ELSE 'passed' END, NULL, NULL FROM e""",
)
def test_cases(spark, sf_dir):
    return R.parse_test_cases(artifacts(spark, sf_dir, run_body()))


@named(
    "slowest_tests",
    """SELECT user_id AS project, 't' || event_id || '.test.ts' AS file, 'full name' AS name, 'failed' AS status, CAST(round(value, 0) AS BIGINT) AS duration_ms FROM events WHERE event_type = 'error'
    ORDER BY 5 DESC, user_id, file LIMIT 25""",
)
def slowest_tests(spark, sf_dir):
    return R.slowest_tests(R.parse_test_cases(artifacts(spark, sf_dir, run_body()))).select("project", "file", "name", "status", "duration_ms")


@named(
    "run_statuses",
    """SELECT CASE event_type WHEN 'click' THEN 'passed' WHEN 'view' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'no-tests-matched' ELSE 'parse-failed' END AS status, count(*) AS runs,
    CAST(sum(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 2 ELSE 0 END) AS BIGINT) AS passed FROM events GROUP BY event_type""",
)
def run_statuses(spark, sf_dir):
    runs = R.run_status(R.parse_test_runs(artifacts(spark, sf_dir, run_body())))
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.sum("passed").alias("passed"))


@named(
    "combined_test_status",
    """WITH s AS (SELECT user_id, date_trunc('day', ts) AS d, event_type AS e FROM events)
    SELECT user_id || '/' || strftime(d, '%Y-%m-%d') AS project, count(*) AS runs, CAST(sum(CASE e WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 2 ELSE 0 END) AS BIGINT) AS passed, count(*) FILTER (e = 'error') AS failed,
      CASE WHEN bool_or(e = 'error') THEN 'failed' WHEN bool_and(e = 'click') THEN 'passed' WHEN bool_or(e IN ('click', 'view')) THEN 'partial' WHEN bool_and(e = 'signup') THEN 'no-tests-matched' ELSE 'parse-failed' END AS status
    FROM s GROUP BY user_id, d""",
)
def combined_test_status(spark, sf_dir):
    """One project per user and day."""
    raw = table(spark, sf_dir, "events").select(F.concat("user_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("project"), run_body().alias("body"))
    return R.combined_status(R.run_status(R.parse_test_runs(raw)))


_LCOV = """l AS (SELECT user_id AS project, CAST(props->>'$.k' AS INTEGER) AS lh, 100 + CAST(props->>'$.k' AS INTEGER) % 7 AS lf, CAST(props->>'$.k' AS INTEGER) // 2 AS brh FROM events)"""


@named(
    "merged_coverage",
    "WITH " + _LCOV + """, s AS (SELECT project, sum(lh)::DOUBLE AS lh, sum(lf)::DOUBLE AS lf, sum(brh)::DOUBLE AS brh, count(*) * 60.0::DOUBLE AS brf FROM l GROUP BY project),
    p AS (SELECT project, floor(lh / lf * 10000 + 0.5) / 100 AS lines, floor(brh / brf * 10000 + 0.5) / 100 AS branches, 0.0::DOUBLE AS functions FROM s)
    SELECT *, branches < 50 AS low_branches, lines < 60 AS low_statements FROM p""",
)
def merged_coverage(spark, sf_dir):
    k = event_number()
    body = F.concat(
        F.lit("SF:src/a.ts\nLF:"), (F.lit(100) + k % 7).cast("string"), F.lit("\nLH:"), k.cast("string"), F.lit("\nBRF:60\nBRH:"),
        F.floor(k / 2).cast("string"), F.lit("\nFNF:oops\nend_of_record"),
    )
    return R.coverage(R.lcov_counters(artifacts(spark, sf_dir, body)))


@named(
    "coverage_summaries",
    """SELECT user_id AS project, least(100, value) AS statements, CAST(props->>'$.k' AS DOUBLE) AS lines, 0.0::DOUBLE AS branches, 100.0::DOUBLE AS functions FROM events""",
)
def coverage_summaries(spark, sf_dir):
    body = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.col("value").alias("pct")).alias("statements"), F.struct(event_number().alias("pct")).alias("lines"), F.struct(F.lit(250).alias("pct")).alias("functions")
            ).alias("total")
        )
    )
    return R.parse_coverage_summary(artifacts(spark, sf_dir, body))


@named(
    "manifest_dependencies",
    """SELECT user_id AS project, 'd' || CAST(props->>'$.k' AS INTEGER) AS name, '^1.0.0' AS version FROM events GROUP BY ALL
    UNION ALL SELECT user_id, 'dev-' || event_type, max('~' || CAST(props->>'$.k' AS INTEGER)) FROM events GROUP BY user_id, event_type""",
)
def manifest_dependencies(spark, sf_dir):
    k = event_number().cast("string")
    body = F.concat(F.lit('{"name":"x","dependencies":{"d'), k, F.lit('":"^1.0.0"},"devDependencies":{"dev-'), "event_type", F.lit('":"~'), k, F.lit('"}}'))
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.concat(F.lit("p"), _id(), F.lit("/package.json")).alias("path"), body.alias("content"))
    return R.parse_manifests(files)


@named(
    "tool_run_summary",
    """SELECT 'tool' || (CAST(props->>'$.k' AS INTEGER) % 4) AS tool, count(*) AS runs, count(*) FILTER (event_type IN ('click', 'view')) AS ok, count(*) FILTER (event_type = 'error') AS failed,
    count(*) FILTER (event_type = 'purchase') AS timeout, count(*) FILTER (event_type = 'signup') AS not_found, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS duration_ms FROM events GROUP BY 1""",
)
def tool_run_summary(spark, sf_dir):
    status = (
        F.when(F.col("event_type").isin("click", "view"), "ok").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "purchase", "timeout").otherwise("not-found")
    )
    runs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("tool"), (event_number() % 4).cast("string")).alias("tool"), F.col("user_id").alias("project"), F.lit("lint").alias("analyzer"),
        status.alias("status"), event_number().cast("bigint").alias("duration_ms"),
    )
    return R.tool_run_summary(runs)


@named(
    "dependency_scores",
    """WITH t AS (SELECT user_id AS project, count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'view') AS moderate FROM events GROUP BY user_id)
    SELECT project, CAST(floor(greatest(0, least(100, 100 - least(50, critical * 20) - least(15, moderate * 3))) + 0.5) AS BIGINT) AS score FROM t""",
)
def dependency_scores(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "moderate").otherwise("low")
    body = F.concat(F.lit('{"advisories":{"'), _id(), F.lit('":{"severity":"'), level, F.lit('"}}}'))
    raw = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), body.alias("body"))
    sums = R.parse_audit(raw).groupBy("project").agg(*[F.sum(c).alias(c) for c in ("critical", "high", "moderate", "low")])
    return sums.select("project", S.dependency_score(F.col("critical"), F.col("high"), F.col("moderate"), F.lit(0), F.lit(0)).alias("score"))
