"""Filters, look-ups, roll-ups and top lists over findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.tables import (
    AUTO_FIX_RULES,
    CHECKS,
    CI_DEFAULT_THRESHOLD,
    FIX_BY_MESSAGE,
    FIX_BY_RULE,
    RULE_CATEGORIES,
)
from tidemark.functions.scoring import clamp, round_half_up
from tidemark.functions.text import matches_glob, sarif_level, severity_rank
from tidemark.operators.skew import top_n_per_key


def lookup(column: Column, table: dict[str, str]) -> Column:
    """Value of a literal map, null when the key is unknown."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), column)


def check_weight(check: Column) -> Column:
    pairs = [F.lit(x) for name, _, weight in CHECKS for x in (name, weight)]
    return F.coalesce(F.element_at(F.create_map(*pairs), check), F.lit(0))


def check_category(check: Column) -> Column:
    return lookup(check, {name: category for name, category, _ in CHECKS})


def all_findings(*parts: DataFrame) -> DataFrame:
    """Findings of all checks; columns a check does not have become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_ignored(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Remove findings whose path matches an ignore pattern of their check.

    ``ignores(check, pattern)`` is configuration: the patterns of one check are
    gathered into an array so that findings see a plain equi-join.
    """
    per_check = ignores.groupBy("check").agg(F.collect_set("pattern").alias("_patterns"))
    joined = findings.join(per_check, "check", "left")
    hit = F.exists("_patterns", lambda p: matches_glob(F.col("path"), p))
    return joined.where(F.col("path").isNull() | ~F.coalesce(hit, F.lit(False))).select(*findings.columns)


def only_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed files, and those that name no file."""
    on_files = findings.join(changed.select("path").distinct(), "path", "left_semi").select(*findings.columns)
    return on_files.unionByName(findings.where(F.col("path").isNull()))


def not_already(findings: DataFrame, reported: DataFrame) -> DataFrame:
    """Findings with no earlier finding on the same file, line and rule."""
    keys = ["project", "path", "line_no", "rule"]
    return findings.join(reported.select(*keys).distinct(), keys, "left_anti")


def change_impact(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """Changed files with the number of findings on each."""
    counts = findings.groupBy("project", "path").agg(F.count(F.lit(1)).alias("n"))
    return changes.join(counts, ["project", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def suggestion(check: Column, rule: Column, message: Column) -> Column:
    """Suggested fix: by rule, else by a part of the message."""
    found = lookup(rule, FIX_BY_RULE)
    for on_rule, on_check, part, text in FIX_BY_MESSAGE:
        applies = message.contains(part)
        if on_rule:
            applies = applies & (rule == on_rule)
        if on_check:
            applies = applies & (check == on_check)
        found = F.coalesce(found, F.when(applies, text))
    return found


def suggest_fix(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fix", suggestion(F.col("check"), F.col("rule"), F.col("message")))


def fixable(findings: DataFrame) -> DataFrame:
    """Located errors and warnings, with their suggestion."""
    located = F.col("path").isNotNull() & F.coalesce(F.col("line_no") > 0, F.lit(False))
    return suggest_fix(findings.where(located & (F.col("severity") != "info")))


def gate(scores: DataFrame) -> DataFrame:
    """Pass or fail against flag, else config, else the CI default, else 0.

    ``scores`` has score, flag, config (nullable thresholds) and ci (boolean).
    """
    ci = F.when(F.col("ci"), F.lit(CI_DEFAULT_THRESHOLD))
    threshold = F.coalesce("flag", "config", ci, F.lit(0)).cast("bigint")
    source = (
        F.when(F.col("flag").isNotNull(), "flag")
        .when(F.col("config").isNotNull(), "config")
        .when(F.col("ci"), "ci default")
        .otherwise("none")
    )
    return (
        scores.withColumn("threshold", threshold)
        .withColumn("threshold_source", source)
        .withColumn("passed", F.col("score") >= F.col("threshold"))
    )


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    by = keys or ("check",)
    return findings.groupBy(*by).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )


def file_hotspots(findings: DataFrame, k: int = 30, split_info: bool = False) -> DataFrame:
    """The ``k`` files with most findings. Without ``split_info`` infos count as warnings."""
    error = F.col("severity") == "error"
    info = F.col("severity") == "info"
    per_file = (
        findings.where(F.col("path").isNotNull())
        .groupBy("project", "path")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(error).alias("errors"),
            (F.count_if(~error & ~info) if split_info else F.count_if(~error)).alias("warnings"),
            *([F.count_if(info).alias("infos")] if split_info else []),
            F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"),
        )
    )
    return per_file.orderBy(F.desc("total"), "project", "path").limit(k)


def rule_category(rule: Column) -> Column:
    """Category of a component rule: known ids first, then the plugin prefixes."""
    return (
        F.when(rule.isNull(), "component-structure")
        .when(rule.startswith("react-hooks/") & lookup(rule, RULE_CATEGORIES).isNotNull(), lookup(rule, RULE_CATEGORIES))
        .when(rule.rlike("(?i)compiler"), "compiler-readiness")
        .when(rule.startswith("react-hooks/"), "hooks")
        .when(rule.startswith("react-refresh/"), "fast-refresh")
        .when(rule.startswith("jsx-a11y/"), "accessibility")
        .when((rule == "react/jsx-key") | rule.rlike("(^|/)(jsx-key|no-array-index-key|key)"), "rendering")
        .otherwise(F.coalesce(lookup(rule, RULE_CATEGORIES), F.lit("component-structure")))
    )


def rule_categories(findings: DataFrame, category: Column | None = None) -> DataFrame:
    """Per category: findings, severities, distinct rules and files, score, rule counts.

    Rule counts come from a first aggregation by rule, so only one row per rule
    reaches the map of a category.
    """
    tagged = findings.withColumn("category", category if category is not None else rule_category(F.col("rule")))
    per_rule = tagged.groupBy("category", "rule").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "error").alias("e"),
        F.count_if(F.col("severity") == "warning").alias("w"),
        F.count_if(F.col("severity") == "info").alias("i"),
    )
    files = (
        tagged.where(F.col("path").isNotNull()).select("category", "project", "path").distinct()
        .groupBy("category").agg(F.count(F.lit(1)).alias("files"))
    )
    rolled = per_rule.groupBy("category").agg(
        F.sum("n").alias("findings"),
        F.sum("e").alias("errors"),
        F.sum("w").alias("warnings"),
        F.sum("i").alias("infos"),
        F.count(F.lit(1)).alias("rules"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rule_counts"),
    )
    score = round_half_up(clamp(100 - 25 * F.col("errors") - 10 * F.col("warnings") - 3 * F.col("infos")))
    return rolled.join(files, "category", "left").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("score", score)


def action_groups(findings: DataFrame, check_scores: DataFrame) -> DataFrame:
    """Work list: automatic fixes, suggested fixes by check and fix, manual work by weak check."""
    auto = (F.col("check") == "lint") | F.col("rule").isin(*AUTO_FIX_RULES)
    kinds = suggest_fix(findings).withColumn(
        "kind", F.when(auto, "auto").when(F.col("fix").isNotNull(), "suggested").otherwise("manual")
    )
    grouped = kinds.groupBy(
        "kind", "check", F.when(F.col("kind") == "suggested", F.col("fix")).alias("fix")
    ).agg(F.count(F.lit(1)).alias("items"))
    scored = grouped.join(check_scores.select("check", "score"), "check", "left")
    weak = (F.col("kind") != "manual") | (F.col("score") < 90)
    return scored.where(weak).select("kind", "check", "fix", "items", "score")


def cwe_audit(findings: DataFrame) -> DataFrame:
    """Counts of storage and credential findings per project."""
    rule, message = F.col("rule"), F.col("message")
    storage = rule == "CWE-922"
    return findings.groupBy("project").agg(
        F.count_if(storage & message.contains("localStorage")).alias("local_storage"),
        F.count_if(storage & message.contains("sessionStorage")).alias("session_storage"),
        F.count_if(rule == "CWE-798").alias("hardcoded_credentials"),
        F.count_if(rule.isin("CWE-1004", "CWE-614", "CWE-525")).alias("insecure_cookies"),
        F.count_if(rule.isin("CWE-922", "CWE-798", "CWE-1004", "CWE-346")).alias("total"),
    )


def top_findings(findings: DataFrame, k: int, *tie_break: str) -> DataFrame:
    """Worst severity first, then the heavier check."""
    weighted = findings.withColumn("weight", check_weight(F.col("check")))
    return weighted.orderBy(severity_rank(F.col("severity")), F.desc("weight"), *tie_break).limit(k)


def cap_per_rule(findings: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` findings of each check and rule, plus one "…and m more" row."""
    keys = ["check", "rule"]
    shown = top_n_per_key(findings, keys, order, n).select(
        *keys, "path", "message", F.col("rank").cast("bigint").alias("rank")
    )
    rest = (
        findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > n)
        .select(
            *keys,
            F.lit(None).cast("string").alias("path"),
            F.concat(F.lit("...and "), (F.col("total") - n).cast("string"), F.lit(" more")).alias("message"),
            F.lit(n + 1).cast("bigint").alias("rank"),
        )
    )
    return shown.unionByName(rest)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object per finding, as JSON text."""
    uri = F.split("path", ":")[0]
    location = F.struct(
        F.struct(
            F.struct(uri.alias("uri")).alias("artifactLocation"),
            F.when(F.col("line_no") > 0, F.struct(F.col("line_no").alias("startLine"))).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.coalesce("rule", "check").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.concat(F.lit("["), F.col("check"), F.lit("] "), F.col("message")).alias("text")).alias("message"),
        F.when(F.col("path").isNotNull(), F.array(location)).alias("locations"),
    )
    return findings.select("project", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The distinct rules of each project with their level, as JSON text."""
    rules = findings.groupBy("project", F.coalesce("rule", "check").alias("id")).agg(
        F.min_by("severity", severity_rank(F.col("severity"))).alias("severity")
    )
    entry = F.struct(
        F.col("id"), F.col("id").alias("name"),
        F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
    )
    return rules.select("project", F.to_json(entry).alias("rule"))
