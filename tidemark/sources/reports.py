"""CI artifacts as tables.

Input is always ``raw(project, body)``: one artifact text per row. Parsing is one
projection with ``from_json`` or regular expressions; malformed bodies give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions.regex import java
from tidemark.functions.text import first_json_object, major_version

ESLINT = "array<struct<filePath:string,messages:array<struct<severity:int,message:string,line:int,ruleId:string>>>>"
STYLELINT = "array<struct<source:string,warnings:array<struct<severity:string,text:string,line:int,rule:string>>>>"
BIOME = "struct<diagnostics:array<struct<category:string,severity:string,description:string,message:string,location:struct<path:string>>>>"
DEAD_CODE_ITEM = "array<string>"
DEAD_CODE = (
    "struct<issues:array<struct<file:string,files:array<string>,exports:array<string>,types:array<string>,"
    "dependencies:array<string>,devDependencies:array<string>>>,files:array<string>,exports:array<string>,dependencies:array<string>>"
)
AUDIT = (
    "struct<metadata:struct<vulnerabilities:struct<critical:bigint,high:bigint,moderate:bigint,low:bigint>>,"
    "advisories:map<string,struct<severity:string>>>"
)
OUTDATED = "map<string,struct<current:string,version:string,latest:string>>"
TEST_RUN = (
    "struct<numPassedTests:bigint,numFailedTests:bigint,numTotalTests:bigint,testResults:array<struct<name:string,status:string,"
    "startTime:double,endTime:double,assertionResults:array<struct<fullName:string,title:string,ancestorTitles:array<string>,"
    "status:string,duration:double,failureMessages:array<string>>>>>>"
)
COVERAGE = (
    "struct<total:struct<statements:struct<pct:double>,lines:struct<pct:double>,branches:struct<pct:double>,functions:struct<pct:double>>>"
)
MANIFEST = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"


def _json(body: Column, schema: str) -> Column:
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def _level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("info")


def parse_lint_reports(raw: DataFrame, tool: str) -> DataFrame:
    """Findings of ``eslint``, ``stylelint`` or ``biome`` JSON."""
    if tool == "eslint":
        files = raw.select("project", F.explode(_json(F.col("body"), ESLINT)).alias("f"))
        return files.select("project", F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m")).select(
            "project", "path", F.col("m.line").alias("line_no"), F.lit("lint").alias("check"), F.col("m.ruleId").alias("rule"),
            F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"), F.col("m.message").alias("message"),
        )
    if tool == "stylelint":
        files = raw.select("project", F.explode(_json(F.col("body"), STYLELINT)).alias("f"))
        return files.select("project", F.col("f.source").alias("path"), F.explode("f.warnings").alias("w")).select(
            "project", "path", F.col("w.line").alias("line_no"), F.lit("styling").alias("check"), F.col("w.rule").alias("rule"),
            F.when(F.col("w.severity") == "error", "error").otherwise("warning").alias("severity"),
            F.concat(F.col("w.text"), F.lit(" ("), F.col("w.rule"), F.lit(")")).alias("message"),
        )
    if tool == "biome":
        rows = raw.select("project", F.explode(_json(F.col("body"), BIOME).getField("diagnostics")).alias("d"))
        # The path is a string or an object holding one.
        path = F.coalesce(F.get_json_object("d.location.path", "$.file"), F.col("d.location.path"))
        found = rows.select(
            "project", path.alias("path"), F.lit(None).cast("int").alias("line_no"), F.lit("lint").alias("check"),
            F.col("d.category").alias("rule"), _level(F.col("d.severity")).alias("severity"),
            F.coalesce("d.description", "d.message", F.lit("lint issue")).alias("message"),
        )
        # One unparseable file reports many parse errors; one per file is kept.
        parse = found.where(F.col("rule") == "parse").groupBy("project", F.coalesce("path", F.lit("")).alias("_p")).agg(
            F.min(F.struct("message", "severity", "path", "line_no", "check", "rule")).alias("k")
        ).select("project", "k.path", "k.line_no", "k.check", "k.rule", "k.severity", "k.message")
        return found.where(F.coalesce(F.col("rule") != "parse", F.lit(True))).unionByName(parse)
    raise ValueError(f"unknown lint tool {tool!r}")


def parse_compiler_log(raw: DataFrame, tool: str = "tsc") -> DataFrame:
    """Findings in the text output of ``tsc`` or the Dart analyser."""
    lines = raw.select("project", F.explode(F.split("body", "\n")).alias("line"))
    if tool == "tsc":
        pattern = java(r"^(.+)\((\d+),\d+\): error (TS\d+): (.+)")
        hit = lines.where(F.col("line").rlike(pattern))
        return hit.select(
            "project", F.regexp_extract("line", pattern, 1).alias("path"), F.regexp_extract("line", pattern, 2).cast("int").alias("line_no"),
            F.lit("types").alias("check"), F.regexp_extract("line", pattern, 3).alias("rule"), F.lit("error").alias("severity"),
            F.regexp_extract("line", pattern, 4).alias("message"),
        )
    parts = lines.select("project", F.split("line", r"\|").alias("p")).where(F.size("p") >= 8)
    return parts.select(
        "project", F.col("p")[3].alias("path"), F.col("p")[4].try_cast("int").alias("line_no"), F.lit("lint").alias("check"),
        F.col("p")[2].alias("rule"),
        F.when(F.col("p")[0] == "ERROR", "error").when(F.col("p")[0] == "WARNING", "warning").otherwise("info").alias("severity"),
        F.col("p")[7].alias("message"),
    )


def parse_dead_code(raw: DataFrame) -> DataFrame:
    """Unused files, exports, types and dependencies, from the per-file or the flat report shape.

    Items are names or objects with a ``name``.
    """
    doc = raw.select("project", _json(F.col("body"), DEAD_CODE).alias("d"))

    def items(kind: str, names: Column, file: Column) -> Column:
        named = lambda n: F.struct(
            F.lit(kind).alias("kind"), file.alias("path"), F.coalesce(F.get_json_object(n, "$.name"), n).alias("name")
        )
        empty = F.array().cast("array<struct<kind:string,path:string,name:string>>")
        return F.coalesce(F.transform(names, named), empty)

    per_file = F.flatten(
        F.transform(
            F.col("d.issues"),
            lambda i: F.concat(
                items("file", i["files"], i["file"]), items("export", i["exports"], i["file"]), items("type", i["types"], i["file"]),
                items("dependency", i["dependencies"], i["file"]), items("dependency", i["devDependencies"], i["file"]),
            ),
        )
    )
    nowhere = F.lit("")
    flat = F.concat(
        items("file", F.col("d.files"), nowhere), items("export", F.col("d.exports"), nowhere), items("dependency", F.col("d.dependencies"), nowhere)
    )
    rows = F.when(F.col("d.issues").isNotNull(), per_file).otherwise(flat)
    return doc.select("project", F.explode(rows).alias("r")).select("project", "r.kind", "r.path", "r.name")


def parse_audit(raw: DataFrame) -> DataFrame:
    """Vulnerability totals per artifact, from npm totals or pnpm advisories."""
    doc = raw.select("project", _json(F.col("body"), AUDIT).alias("a"))
    levels = F.coalesce(F.transform(F.map_values("a.advisories"), lambda v: v["severity"]), F.array().cast("array<string>"))
    known = ("critical", "high", "moderate")

    def count(level: str) -> Column:
        total = F.coalesce(F.col(f"a.metadata.vulnerabilities.{level}"), F.lit(0))
        listed = F.size(F.filter(levels, lambda s: ~F.coalesce(s, F.lit("")).isin(*known) if level == "low" else s == level))
        return (total + listed).cast("bigint").alias(level)

    return doc.select("project", *[count(level) for level in ("critical", "high", "moderate", "low")])


def parse_outdated(raw: DataFrame) -> DataFrame:
    """Outdated packages with whether the major version differs."""
    rows = raw.select("project", F.explode(_json(F.col("body"), OUTDATED)).alias("name", "v"))
    current = F.coalesce("v.current", "v.version", F.lit(""))
    latest = F.coalesce("v.latest", F.lit(""))
    known = (current != "") & (latest != "")
    return rows.select(
        "project", "name", current.alias("current"), latest.alias("latest"),
        (known & (major_version(current) != major_version(latest))).alias("major_behind"),
    )


def outdated_summary(outdated: DataFrame) -> DataFrame:
    return outdated.groupBy("project").agg(F.count(F.lit(1)).alias("outdated"), F.count_if("major_behind").alias("major_behind"))


def parse_test_cases(raw: DataFrame) -> DataFrame:
    """Every test case of a JSON test run; text before the first brace is ignored."""
    doc = raw.select("project", _json(first_json_object(F.col("body")), TEST_RUN).alias("r"))
    suites = doc.select("project", F.explode("r.testResults").alias("s"))
    cases = suites.select("project", F.col("s.name").alias("file"), F.explode("s.assertionResults").alias("c"))
    joined = F.array_join(F.filter(F.concat(F.coalesce("c.ancestorTitles", F.array().cast("array<string>")), F.array(F.coalesce("c.title", F.lit("")))), lambda t: t != ""), " ")
    full = F.trim(F.coalesce("c.fullName", F.lit("")))
    status = F.when(F.col("c.status").isin("passed", "failed", "skipped", "todo"), F.col("c.status")).when(
        F.col("c.status") == "pending", "skipped"
    ).otherwise("unknown")
    return cases.select(
        "project", "file", F.when(full != "", full).otherwise(joined).alias("name"), status.alias("status"),
        S.round_half_up(F.col("c.duration")).alias("duration_ms"),
        F.when(status == "failed", F.array_join("c.failureMessages", "\n")).alias("error"),
    )


def parse_test_runs(raw: DataFrame) -> DataFrame:
    """One row per artifact: parsed or not, passed, failed and total tests."""
    doc = raw.select(*raw.columns, _json(first_json_object(F.col("body")), TEST_RUN).alias("r"))
    return doc.select(
        *[c for c in raw.columns if c != "body"], F.col("r.numTotalTests").isNotNull().alias("parsed"),
        F.coalesce("r.numPassedTests", F.lit(0)).alias("passed"), F.coalesce("r.numFailedTests", F.lit(0)).alias("failed"),
        F.coalesce("r.numTotalTests", F.lit(0)).alias("total"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """Status of each test run. ``timed_out``, ``skipped`` and ``command_ok`` columns are optional."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in runs.columns else F.lit(default)
    status = (
        F.when(has("skipped", False), "skipped")
        .when(has("timed_out", False), "timeout")
        .when(~F.col("parsed") & ~has("command_ok", True), "command-failed")
        .when(~F.col("parsed"), "parse-failed")
        .when(F.col("failed") > 0, "failed")
        .when(F.col("total") == 0, "no-tests-matched")
        .when((F.col("passed") > 0) & (F.col("passed") < F.col("total")), "partial")
        .otherwise("passed")
    )
    return runs.withColumn("status", status)


def combined_status(runs: DataFrame) -> DataFrame:
    """Status of a project over all its runs."""
    s = F.col("status")
    every = lambda c: F.bool_and(c)
    some = lambda c: F.bool_or(c)
    status = (
        F.when(every(s == "skipped"), "skipped")
        .when(some(s.isin("failed", "command-failed")), "failed")
        .when(every(s == "passed"), "passed")
        .when(some(s.isin("passed", "partial")), "partial")
        .when(some(s == "timeout"), "timeout")
        .when(every(s == "no-tests-matched"), "no-tests-matched")
        .otherwise("parse-failed")
    )
    return runs.groupBy("project").agg(F.count(F.lit(1)).alias("runs"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed"), status.alias("status"))


def slowest_tests(cases: DataFrame, k: int = 25) -> DataFrame:
    """Failures first, then the slowest."""
    timed = cases.where(F.col("duration_ms").isNotNull() | (F.col("status") == "failed"))
    return timed.orderBy((F.col("status") != "failed").cast("int"), F.desc("duration_ms"), "project", "file", "name").limit(k)


LCOV_COUNTERS = ("LH", "LF", "BRH", "BRF", "FNH", "FNF")


def lcov_counters(raw: DataFrame) -> DataFrame:
    """Sums of the LCOV counters per artifact, inside the row."""
    rows = F.split("body", "\n")

    def total(tag: str) -> Column:
        values = F.transform(F.filter(rows, lambda l: l.startswith(tag + ":")), lambda l: F.substr(l, F.lit(len(tag) + 2)).try_cast("bigint"))
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0))).alias(tag.lower())

    return raw.select("project", *[total(tag) for tag in LCOV_COUNTERS])


def coverage(counters: DataFrame) -> DataFrame:
    """Merged coverage per project in percent; statements equal lines in LCOV."""
    sums = counters.groupBy("project").agg(*[F.sum(t.lower()).alias(t.lower()) for t in LCOV_COUNTERS])

    def percent(hit: str, total: str, name: str) -> Column:
        return F.when(F.col(total) > 0, F.floor(F.col(hit) / F.col(total) * 10000 + 0.5) / 100).otherwise(F.lit(0.0)).alias(name)

    return sums.where(F.col("lf") > 0).select(
        "project", percent("lh", "lf", "lines"), percent("brh", "brf", "branches"), percent("fnh", "fnf", "functions")
    ).withColumn("low_branches", F.col("branches") < 50).withColumn("low_statements", F.col("lines") < 60)


def parse_coverage_summary(raw: DataFrame) -> DataFrame:
    """Coverage percentages of JSON summaries, clamped to 0..100."""
    doc = raw.select("project", _json(F.col("body"), COVERAGE).getField("total").alias("t")).where(F.col("t").isNotNull())
    pct = lambda name: S.clamp(F.coalesce(F.col(f"t.{name}.pct"), F.lit(0.0))).alias(name)
    return doc.select("project", pct("statements"), pct("lines"), pct("branches"), pct("functions"))


def parse_manifests(files: DataFrame) -> DataFrame:
    """Dependencies of ``package.json`` files; a name in several manifests keeps one version."""
    doc = files.where(F.col("path").endswith("package.json")).select("project", _json(F.col("content"), MANIFEST).alias("m"))
    empty = F.create_map().cast("map<string,string>")
    rows = doc.select(
        "project",
        F.explode(
            F.concat(
                F.transform(F.map_entries(F.coalesce("m.dependencies", empty)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))),
                F.transform(F.map_entries(F.coalesce("m.devDependencies", empty)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))),
            )
        ).alias("d"),
    )
    return rows.groupBy("project", F.col("d.name").alias("name")).agg(F.max("d.version").alias("version"))


def tool_run_summary(runs: DataFrame, analyzer: str | None = None, project: str | None = None) -> DataFrame:
    """Per tool: ok, failed, timed out and not found runs."""
    kept = runs
    if analyzer is not None:
        kept = kept.where(F.col("analyzer") == analyzer)
    if project is not None:
        kept = kept.where(F.col("project") == project)
    states = ("ok", "failed", "timeout", "not-found")
    return kept.groupBy("tool").agg(
        F.count(F.lit(1)).alias("runs"), *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in states],
        F.sum("duration_ms").alias("duration_ms"),
    )
