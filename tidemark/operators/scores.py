"""Check scores, composite scores, grades and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog.tables import CHECKS, DETAIL_DENYLIST
from tidemark.functions import scoring as S
from tidemark.functions.text import humanise_id, metric_trend, metric_unit
from tidemark.operators.findings import severity_counts


def check_meta(spark) -> DataFrame:
    """The check catalogue: check, category, weight."""
    return spark.createDataFrame(list(CHECKS), "check string, category string, weight int")


def score_checks(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Score of every (project, check) in ``units(project, check, n)``; no findings scores 100."""
    counts = severity_counts(findings, "project", "check")
    filled = units.join(counts, ["project", "check"], "left").na.fill(0, ["errors", "warnings", "infos"])
    score = S.check_score(F.col("check"), F.col("errors"), F.col("warnings"), F.col("infos"), F.col("n"))
    return filled.withColumn("score", score).withColumn("grade", S.grade(F.col("score")))


def composite(checks: DataFrame, meta: DataFrame, *keys: str) -> DataFrame:
    """Weighted mean over scored checks; unscored ones and weight 0 do not count.

    ``checks`` has check, score and optionally state; anything but ``ran`` is left out.
    """
    by = keys or ("project",)
    rows = checks.join(F.broadcast(meta), "check", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    counted = F.col("state") == "ran" if "state" in checks.columns else F.lit(True)
    weight = F.when(counted, F.col("weight")).otherwise(0)
    total = F.sum(weight)
    weighted = F.sum(S.normal_score(F.col("score")) * weight)
    value = F.when(total > 0, S.round_half_up(weighted / total)).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy(*by).agg(value.alias("score")).withColumn("grade", S.grade(F.col("score")))


def category_scores(checks: DataFrame, meta: DataFrame, weighted: bool, *keys: str) -> DataFrame:
    """Mean score per category, weighted or plain, over checks that ran."""
    rows = checks.join(F.broadcast(meta), "check")
    if "state" in checks.columns:
        rows = rows.where(F.col("state") == "ran")
    score = S.normal_score(F.col("score"))
    if weighted:
        total = F.sum("weight")
        value = F.when(total > 0, S.round_half_up(F.sum(score * F.col("weight")) / total)).otherwise(F.lit(0).cast("bigint"))
    else:
        value = S.round_half_up(F.avg(score))
    return rows.groupBy(*keys, "category").agg(value.alias("score"), F.count(F.lit(1)).alias("checks"))


def run_state(status: Column, reason: Column, unavailable: Column, skipped: Column) -> Column:
    """Run state of a check row that exists."""
    has_status = F.coalesce(status != "", F.lit(False))
    return (
        F.when(F.coalesce(status == "skipped", F.lit(False)), "skipped")
        .when(F.coalesce(status == "unavailable", F.lit(False)), "unavailable")
        .when(F.coalesce(reason.startswith("runner error:"), F.lit(False)), "runner-error")
        .when(has_status, "ran")
        .when(F.coalesce(unavailable, F.lit(False)), "unavailable")
        .when(F.coalesce(skipped, F.lit(False)), "skipped")
        .otherwise("ran")
    )


def normalise_checks(checks: DataFrame, meta: DataFrame) -> DataFrame:
    """Status, score mode and stored score of raw check rows.

    Input: check, raw_score (text), skipped, unavailable, synthetic (booleans),
    reason, n_findings, n_errors. A skipped check without findings keeps the
    placeholder 100; a score that is not a number is stored as 0 and adds an
    internal error finding.
    """
    crashed = F.coalesce(F.col("reason").startswith("runner error:"), F.lit(False))
    placeholder = (F.col("n_findings") == 0) & (F.col("skipped") | F.col("unavailable")) & ~crashed
    score = F.when(placeholder, F.lit(100).cast("bigint")).otherwise(S.normal_score(F.col("raw_score")))
    number = F.col("raw_score").try_cast("double")
    invalid = ~placeholder & (number.isNull() | F.isnan(number) | (number != score))
    rows = checks.join(F.broadcast(meta), "check", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    mode = (
        F.when(F.col("unavailable"), "unavailable")
        .when(F.col("skipped"), "not-applicable")
        .when(F.col("synthetic") | (F.col("weight") == 0), "available-unscored")
        .otherwise("available-scored")
    )
    failed = (F.col("n_errors") > 0) | F.col("invalid_score") | (F.col("score") < 60)
    status = (
        F.when(crashed, "failed")
        .when(F.col("unavailable"), "unavailable")
        .when(F.col("skipped"), "skipped")
        .when(F.col("score_mode") == "available-unscored", "passed")
        .when(failed, "failed")
        .otherwise("passed")
    )
    return (
        rows.withColumn("score", score)
        .withColumn("invalid_score", invalid)
        .withColumn("score_mode", mode)
        .withColumn("status", status)
        .withColumn("grade", S.grade(F.col("score")))
        .select(*checks.columns, "score", "grade", "status", "score_mode", "invalid_score")
    )


# --- fixed values: units and trends a metric may name
METRIC_UNITS = ("count", "percent", "ms", "bytes", "score")
METRIC_TRENDS = ("higher-is-better", "lower-is-better", "neutral")


def _metric(name: Column, label: Column, number: Column, text: Column, unit: Column, trend: Column) -> Column:
    return F.struct(name.alias("id"), label.alias("label"), number.alias("value_num"), text.alias("value_str"), unit.alias("unit"), trend.alias("trend"))


def _explicit_metric(item: Column) -> Column:
    """A metric from an item of the list; its id is null unless id and label are strings and the value is a number, string or boolean."""

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))

    def text(field: str) -> Column:
        return F.try_variant_get(item, f"$.{field}", "string")

    number = kind("value").rlike("^(BIGINT|DECIMAL|DOUBLE)")
    valid = (kind("id") == "STRING") & (kind("label") == "STRING") & (number | kind("value").isin("STRING", "BOOLEAN"))
    return _metric(
        F.when(valid, text("id")), text("label"), F.when(number, F.try_variant_get(item, "$.value", "double")), F.when(~number, text("value")),
        F.when(text("unit").isin(*METRIC_UNITS), text("unit")), F.when(text("trend").isin(*METRIC_TRENDS), text("trend")),
    )


def snapshot_metrics(details: DataFrame, keys: list[str], limit: int = 12) -> DataFrame:
    """The metrics a check lists itself, all of them; without a valid one, its first twelve scalar details as labelled metrics.

    ``details`` holds one small map per row, so the ranking is done inside the row. Its value ``metrics``, if any, is the list as JSON.
    """
    listed = F.try_variant_get(F.try_parse_json(F.try_element_at("details", F.lit("metrics"))), "$", "array<variant>")
    explicit = F.filter(F.transform(listed, _explicit_metric), lambda m: m["id"].isNotNull())

    def detail(e: Column) -> Column:
        number = e["value"].try_cast("double")
        return _metric(
            e["key"], humanise_id(e["key"]), number, F.when(number.isNull(), e["value"]), F.when(number.isNotNull(), metric_unit(e["key"])), metric_trend(e["key"])
        )

    entries = F.filter(F.map_entries("details"), lambda e: ~e["key"].isin(*DETAIL_DENYLIST, "metrics") & e["value"].isNotNull())
    metrics = F.when(F.size(explicit) > 0, explicit).otherwise(F.transform(F.slice(entries, 1, limit), detail))
    return details.select(*keys, F.posexplode(metrics).alias("position", "_m")).select(*keys, (F.col("position") + 1).alias("position"), "_m.*")


def weakest(checks: DataFrame, k: int = 3, below: int = 70) -> DataFrame:
    return checks.where(F.col("score") < below).orderBy("score", "check").limit(k)


def applicable(projects: DataFrame, checks: Sequence[tuple]) -> DataFrame:
    """Which checks apply to which project.

    ``checks``: (name, languages, frameworks, components) with None for "any".
    ``projects``: project, language, framework, components. One of the languages and
    one of the frameworks must match, but all components. The code-sized catalogue
    is a literal array exploded per project, so nothing is joined.
    """

    def words(values) -> Column:
        return F.lit(None).cast("array<string>") if values is None else F.array(*[F.lit(v) for v in values]).cast("array<string>")

    rows = [
        F.struct(F.lit(name).alias("check"), words(langs).alias("l"), words(fws).alias("f"), words(comps).alias("c"))
        for name, langs, fws, comps in checks
    ]
    pairs = projects.withColumn("_c", F.explode(F.array(*rows)))
    ok = (
        F.coalesce(F.array_contains("_c.l", F.col("language")), F.lit(True))
        & F.coalesce(F.array_contains("_c.f", F.col("framework")), F.lit(True))
        & (F.size(F.coalesce(F.array_except("_c.c", "components"), F.array().cast("array<string>"))) == 0)
    )
    return pairs.select("project", F.col("_c.check").alias("check"), ok.alias("applies"))


def latest_per_check(scans: DataFrame) -> DataFrame:
    """The newest score of each (project, check); ``max_by`` combines map-side."""
    return scans.groupBy("project", "check").agg(
        F.max_by("score", F.struct("scan_ts", "scan_id")).alias("score"), F.max("scan_ts").alias("scan_ts")
    )


def ranked(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows of a result that is already small (a limited top list)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
