"""Comparing scans: multiset differences, transitions and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog.tables import HISTORY_LENGTH, SPARK_LEVELS
from tidemark.operators.skew import previous_row, top_n_per_key


def _counted(findings: DataFrame, side: str) -> DataFrame:
    """Occurrences per key with the first finding as payload; combines map-side."""
    payload = F.struct("path", "line_no", "rule", "severity", "message")
    return findings.groupBy("project", "check", "fingerprint").agg(
        F.count(F.lit(1)).alias(f"n_{side}"), F.min(payload).alias(f"first_{side}")
    )


def finding_delta(before: DataFrame, after: DataFrame, comparable: DataFrame | None = None) -> DataFrame:
    """Fixed and introduced findings as an exact multiset difference.

    ``comparable(project, check)`` names the checks that ran on both sides; other
    checks have no difference to report. Output has one row per missing or new
    occurrence group, with ``copies`` telling how many times it counts.
    """
    if comparable is not None:
        before = before.join(comparable, ["project", "check"], "left_semi")
        after = after.join(comparable, ["project", "check"], "left_semi")
    both = _counted(before, "before").join(_counted(after, "after"), ["project", "check", "fingerprint"], "full")
    gap = F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))
    kind = F.when(gap > 0, "introduced").when(gap < 0, "fixed")
    payload = F.when(gap > 0, F.col("first_after")).otherwise(F.col("first_before"))
    return both.select("project", "check", "fingerprint", kind.alias("kind"), F.abs(gap).alias("copies"), payload.alias("_p")).where(
        F.col("kind").isNotNull()
    ).select("project", "check", "fingerprint", "kind", "copies", "_p.*")


def finding_delta_rows(delta: DataFrame) -> DataFrame:
    """One row per copy."""
    return delta.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def finding_trend(before: DataFrame, after: DataFrame) -> DataFrame:
    """Surplus occurrences on each side: those numbered beyond the other side's count."""
    keys = ["project", "check", "fingerprint"]
    order = Window.partitionBy(*keys).orderBy(F.coalesce("line_no", F.lit(0)), "seq")

    def surplus(mine: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        counts = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("_other"))
        return (
            mine.withColumn("_nth", F.row_number().over(order))
            .join(counts, keys, "left")
            .where(F.col("_nth") > F.coalesce("_other", F.lit(0)))
            .select(*keys, "path", "line_no", "message", F.lit(kind).alias("kind"))
        )

    return surplus(after, before, "introduced").unionByName(surplus(before, after, "fixed"))


def check_delta(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Score change per check, or the transition when the run state changed.

    Both sides: keys, check, state, score. A side without a row is ``absent``.
    """
    by = [*(keys or ("project",)), "check"]
    b = before.select(*by, F.col("state").alias("state_before"), F.col("score").alias("score_before"))
    a = after.select(*by, F.col("state").alias("state_after"), F.col("score").alias("score_after"))
    both = b.join(a, by, "full").na.fill("absent", ["state_before", "state_after"])
    ran = (F.col("state_before") == "ran") & (F.col("state_after") == "ran")
    moved = F.col("state_before") != F.col("state_after")
    return both.select(
        *by,
        "state_before",
        "state_after",
        F.when(F.col("state_before") == "ran", F.col("score_before")).alias("before"),
        F.when(F.col("state_after") == "ran", F.col("score_after")).alias("after"),
        F.when(ran, F.coalesce("score_after", F.lit(0)) - F.coalesce("score_before", F.lit(0))).otherwise(0).alias("delta"),
        F.when(moved, F.concat_ws(" → ", "state_before", "state_after")).alias("transition"),
    ).where((F.col("delta") != 0) | F.col("transition").isNotNull())


def score_changes(delta: DataFrame) -> DataFrame:
    return delta.where(F.col("delta") != 0).orderBy(F.desc("delta"), "check")


def last_points(scans: DataFrame, n: int = HISTORY_LENGTH, keys: tuple[str, ...] = ("project",)) -> DataFrame:
    """The newest ``n`` scans of each key, numbered oldest first."""
    kept = top_n_per_key(scans, keys, [F.desc("scan_ts"), F.desc("scan_id")], n, rank="age")
    points = F.count(F.lit(1)).over(Window.partitionBy(*keys))  # at most n rows by now
    return kept.withColumn("point", (points - F.col("age") + 1).cast("bigint")).withColumn("age", F.col("age").cast("bigint"))


def age_label(days: Column) -> Column:
    return (
        F.when(days == 0, "earlier today")
        .when(days == 1, "yesterday")
        .when(days <= 7, "last week")
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def score_badge(scans: DataFrame) -> DataFrame:
    """Latest score of each project against the one before, with its age."""
    newest = top_n_per_key(scans, ["project"], [F.desc("scan_ts"), F.desc("scan_id")], 2)
    pair = newest.groupBy("project").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("current"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("previous"),
        F.max(F.when(F.col("rank") == 1, F.col("scan_ts"))).alias("_now"),
        F.max(F.when(F.col("rank") == 2, F.col("scan_ts"))).alias("_then"),
    )
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    days = F.floor((millis("_now") - millis("_then")) / 86_400_000)
    delta = F.col("current") - F.col("previous")
    arrow = F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("=")
    return pair.where(F.col("previous").isNotNull()).select(
        "project", "current", "previous", delta.alias("delta"), days.alias("days"),
        F.concat(arrow, F.abs(delta).cast("string"), F.lit(" from "), age_label(days)).alias("badge"),
    )


def first_latest(scans: DataFrame) -> DataFrame:
    """First and latest score of each (project, check) over the given history."""
    when = F.struct("scan_ts", "scan_id")
    ends = scans.groupBy("project", "check").agg(
        F.min_by("score", when).alias("first"),
        F.max_by("score", when).alias("latest"),
        F.count(F.lit(1)).alias("points"),
    )
    return ends.withColumn("delta", F.col("latest") - F.col("first"))


def regressions(scans: DataFrame, drop: int) -> DataFrame:
    """Scans that lost at least ``drop`` points against the check's previous scan."""
    buckets = [F.date_trunc("minute", F.col("scan_ts")), F.date_trunc("day", F.col("scan_ts"))]
    stepped = previous_row(scans, ["project", "check"], ["scan_ts", "scan_id"], F.col("score"), buckets, "previous")
    return stepped.where(F.col("previous") - F.col("score") >= drop).withColumn("lost", F.col("previous") - F.col("score"))


def score_windows(scans: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Mean, lowest and number of scores per project and time window."""
    window = F.window("scan_ts", length, slide) if slide else F.window("scan_ts", length)
    return scans.groupBy("project", window.alias("w")).agg(
        F.count(F.lit(1)).alias("scans"), F.min("score").alias("lowest"), F.sum("score").alias("total")
    ).select("project", F.col("w.start").alias("window_start"), "scans", "lowest", "total")


def sparkline(points: DataFrame, n: int = 20) -> DataFrame:
    """Eight-level line over the last ``n`` points of each project (at most ``n`` values each)."""
    kept = top_n_per_key(points, ["project"], [F.desc("scan_ts"), F.desc("scan_id")], n)
    series = kept.groupBy("project").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("scan_ts", "scan_id", "score"))), lambda s: s["score"]).alias("_s")
    )
    low, high = F.array_min("_s"), F.array_max("_s")
    span = F.when(high > low, high - low).otherwise(F.lit(1)).cast("double")
    level = lambda v: F.substr(F.lit(SPARK_LEVELS), F.least(F.lit(7), F.floor((v - low) / span * 7)).cast("int") + 1, F.lit(1))
    return series.select("project", F.array_join(F.transform("_s", level), "").alias("line"))
