"""Queries on scan history, written from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import deltas as D
from tidemark.operators import findings as W
from tidemark.operators import scores as K
from tidemark.plans.registry import named
from tidemark.plans.views import SCANS, with_views
from tidemark.sources import history as H
from tidemark.sources.corpus import event_number, event_scans, table

HISTORY = with_views(SCANS)
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
# Event types read as checks that carry a weight.
CHECK_OF = {"click": "lint", "error": "error-handling", "purchase": "security", "signup": "testing", "view": "docs"}
_CHECK_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHECK_OF.items()) + " END"
_META = "meta AS (SELECT * FROM (VALUES ('lint', 'Foundations', 5), ('error-handling', 'Quality', 3), ('security', 'Security', 5), ('testing', 'Testing', 13), ('docs', 'Quality', 3)) t(\"check\", category, weight))"
_LATEST = (
    "latest AS (SELECT user_id AS project, " + _CHECK_SQL + " AS \"check\", arg_max(CAST(floor(greatest(0, least(100, value)) + 0.5) AS BIGINT), (ts, event_id)) AS score, "
    "CASE WHEN arg_max(CAST(props->>'$.k' AS INTEGER), (ts, event_id)) % 10 = 0 THEN 'skipped' ELSE 'ran' END AS state FROM events GROUP BY ALL)"
)


def latest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest score and run state of every (user, check); numbers ending in 0 were skipped."""
    check = F.element_at(F.create_map(*[F.lit(x) for p in CHECK_OF.items() for x in p]), F.col("event_type"))
    when = F.struct("ts", "event_id")
    newest = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("project"), check.alias("check")).agg(
        F.max_by(S.round_half_up(S.clamp(F.col("value"))), when).alias("score"), F.max_by(event_number(), when).alias("k")
    )
    return newest.select("project", "check", "score", F.when(F.col("k") % 10 == 0, "skipped").otherwise("ran").alias("state"))


@named(
    "project_scores",
    with_views(_LATEST, _META) + f""", c AS (SELECT project, CASE WHEN coalesce(sum(weight) FILTER (state = 'ran'), 0) > 0
      THEN CAST(floor(sum(score * weight) FILTER (state = 'ran')::DOUBLE / sum(weight) FILTER (state = 'ran') + 0.5) AS BIGINT) ELSE 0 END AS score FROM latest JOIN meta USING ("check") GROUP BY project)
    SELECT project, score, {_GRADE} AS grade FROM c""",
)
def project_scores(spark, sf_dir):
    return K.composite(latest_checks(spark, sf_dir), K.check_meta(spark))


@named(
    "category_scores",
    with_views(_LATEST, _META) + """SELECT project, category, CAST(floor(sum(score * weight)::DOUBLE / sum(weight) + 0.5) AS BIGINT) AS score, count(*) AS checks
    FROM latest JOIN meta USING ("check") WHERE state = 'ran' GROUP BY ALL""",
)
def category_scores(spark, sf_dir):
    return K.category_scores(latest_checks(spark, sf_dir), K.check_meta(spark), True, "project")


@named(
    "category_scores_plain",
    with_views(_LATEST, _META) + """SELECT project, category, CAST(floor(avg(score) + 0.5) AS BIGINT) AS score, count(*) AS checks FROM latest JOIN meta USING ("check") WHERE state = 'ran' GROUP BY ALL""",
)
def category_scores_plain(spark, sf_dir):
    return K.category_scores(latest_checks(spark, sf_dir), K.check_meta(spark), False, "project")


@named(
    "quality_gate",
    with_views(_LATEST, _META) + """, c AS (SELECT project, CASE WHEN coalesce(sum(weight) FILTER (state = 'ran'), 0) > 0
      THEN CAST(floor(sum(score * weight) FILTER (state = 'ran')::DOUBLE / sum(weight) FILTER (state = 'ran') + 0.5) AS BIGINT) ELSE 0 END AS score FROM latest JOIN meta USING ("check") GROUP BY project),
    t AS (SELECT project, score, CASE project % 4 WHEN 0 THEN 80 WHEN 1 THEN 40 WHEN 2 THEN 60 ELSE 0 END::BIGINT AS threshold,
      CASE project % 4 WHEN 0 THEN 'flag' WHEN 1 THEN 'config' WHEN 2 THEN 'ci default' ELSE 'none' END AS threshold_source FROM c)
    SELECT *, score >= threshold AS passed FROM t""",
)
def quality_gate(spark, sf_dir):
    scores = K.composite(latest_checks(spark, sf_dir), K.check_meta(spark)).select("project", "score")
    kind = F.pmod("project", F.lit(4))
    limits = scores.withColumn("flag", F.when(kind == 0, 80)).withColumn("config", F.when(kind < 2, 40)).withColumn("ci", kind != 3)
    return W.gate(limits).select("project", "score", "threshold", "threshold_source", "passed")


@named(
    "normalised_checks",
    """WITH e AS (SELECT event_id, """ + _CHECK_SQL + """ AS "check", CAST(props->>'$.k' AS INTEGER) AS k, value FROM events),
    r AS (SELECT event_id, "check", CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS v, k % 7 = 0 AS skipped, k % 11 = 0 AS unavailable, k % 17 = 0 AS synthetic, k % 5 = 0 AS crashed, k % 3 AS nf, k % 2 AS ne FROM e),
    s AS (SELECT *, nf = 0 AND (skipped OR unavailable) AND NOT crashed AS placeholder FROM r),
    t AS (SELECT *, CASE WHEN placeholder THEN 100 WHEN v IS NULL THEN 0 ELSE CAST(floor(greatest(0, least(100, v)) + 0.5) AS BIGINT) END AS score FROM s),
    u AS (SELECT *, NOT placeholder AND (v IS NULL OR v <> score) AS invalid_score, CASE WHEN unavailable THEN 'unavailable' WHEN skipped THEN 'not-applicable' WHEN synthetic THEN 'available-unscored' ELSE 'available-scored' END AS score_mode FROM t)
    SELECT event_id, "check", CAST(score AS BIGINT) AS score, """ + _GRADE + """ AS grade, CASE WHEN crashed THEN 'failed' WHEN unavailable THEN 'unavailable' WHEN skipped THEN 'skipped' WHEN score_mode = 'available-unscored' THEN 'passed'
      WHEN ne > 0 OR invalid_score OR score < 60 THEN 'failed' ELSE 'passed' END AS status, score_mode, invalid_score FROM u""",
)
def normalised_checks(spark, sf_dir):
    """Raw check rows written from events; some scores are no number, some checks skipped or crashed."""
    k = event_number()
    check = F.element_at(F.create_map(*[F.lit(x) for p in CHECK_OF.items() for x in p]), F.col("event_type"))
    raw = table(spark, sf_dir, "events").select(
        "event_id", check.alias("check"), F.when(k % 13 == 0, "NaN").otherwise(F.floor("value").cast("string")).alias("raw_score"),
        (k % 7 == 0).alias("skipped"), (k % 11 == 0).alias("unavailable"), (k % 17 == 0).alias("synthetic"),
        F.when(k % 5 == 0, "runner error: exit 2").otherwise("").alias("reason"), (k % 3).alias("n_findings"), (k % 2).alias("n_errors"),
    )
    done = K.normalise_checks(raw, K.check_meta(spark))
    return done.select("event_id", "check", "score", "grade", "status", "score_mode", "invalid_score")


@named(
    "snapshot_metrics",
    """WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS v, CAST(props->>'$.k' AS BIGINT) AS k, event_type FROM events)
    SELECT event_id, 1::BIGINT AS position, 'avgScore' AS id, 'Avg Score' AS label, v::DOUBLE AS value_num, NULL::VARCHAR AS value_str, 'score' AS unit, 'higher-is-better' AS trend FROM e
    UNION ALL SELECT event_id, 2, 'durationMs', 'Duration Ms', k::DOUBLE, NULL, 'ms', 'neutral' FROM e
    UNION ALL SELECT event_id, 3, 'error_kind', 'Error Kind', NULL, event_type, NULL, 'lower-is-better' FROM e""",
)
def snapshot_metrics(spark, sf_dir):
    details = F.create_map(
        F.lit("avgScore"), F.floor("value").cast("string"), F.lit("status"), F.lit("x"), F.lit("durationMs"), event_number().cast("string"),
        F.lit("error_kind"), F.col("event_type"),
    )
    return K.snapshot_metrics(table(spark, sf_dir, "events").select("event_id", details.alias("details")), ["event_id"])


@named(
    "explicit_metrics",
    """SELECT event_id, 1::BIGINT AS position, 'load' AS id, 'Load' AS label, floor(value)::DOUBLE AS value_num, NULL::VARCHAR AS value_str, 'ms' AS unit, 'neutral' AS trend FROM events
    UNION ALL SELECT event_id, 2, 'kind', 'Kind', NULL, event_type, NULL, NULL FROM events""",
)
def explicit_metrics(spark, sf_dir):
    """Every event as a check that lists its metrics: one with unit and trend, one without an id of text, one of text in an unknown unit."""
    listed = F.concat(
        F.lit('[{"id": "load", "label": "Load", "unit": "ms", "trend": "neutral", "value": '), F.floor("value").cast("string"),
        F.lit('}, {"id": 7, "label": "No id", "value": 1}, {"id": "kind", "label": "Kind", "unit": "miles", "value": "'), F.col("event_type"), F.lit('"}]'),
    )
    details = F.create_map(F.lit("avgScore"), F.lit("80"), F.lit("metrics"), listed)
    return K.snapshot_metrics(table(spark, sf_dir, "events").select("event_id", details.alias("details")), ["event_id"])


@named(
    "weakest_checks",
    with_views(_LATEST) + """SELECT "check", score FROM (SELECT "check", CAST(floor(avg(score) + 0.5) AS BIGINT) AS score FROM latest WHERE state = 'ran' GROUP BY "check") WHERE score < 70 ORDER BY score, "check" LIMIT 3""",
)
def weakest_checks(spark, sf_dir):
    per_check = latest_checks(spark, sf_dir).where("state = 'ran'").groupBy("check").agg(S.round_half_up(F.avg("score")).alias("score"))
    return K.weakest(per_check)


@named(
    "last_thirty_scans",
    HISTORY + """, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scan_ts DESC, scan_id DESC) AS age, count(*) OVER (PARTITION BY project) AS n FROM scans)
    SELECT project, scan_id, score, age, least(n, 30) - age + 1 AS point FROM r WHERE age <= 30""",
)
def last_thirty_scans(spark, sf_dir):
    return D.last_points(event_scans(spark, sf_dir)).select("project", "scan_id", "score", "age", "point")


_SNAP = """snap AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'unscored' ELSE CAST(floor(value) AS VARCHAR) END AS score, event_type = 'view' AS partial_scan, CAST(props->>'$.k' AS INTEGER) % 10 = 0 AS corrupt FROM events)"""


def snapshot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON snapshot per event: views are partial scans, errors unscored, numbers ending in 0 cut off in the middle."""
    score = F.when(F.col("event_type") == "error", "unscored").otherwise(F.floor("value").cast("string"))
    body = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("project"), F.col("event_id").cast("string").alias("scan_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), score.alias("score"),
            F.struct(F.struct(F.when(F.col("event_type") == "view", "main").alias("diffBase")).alias("scan")).alias("meta"),
            F.array(
                F.struct(
                    F.col("event_type").alias("name"), F.col("value").alias("score"),
                    F.array(
                        F.struct(
                            F.when(F.col("value") > 50, F.sha1("event_type")).alias("fingerprint"), F.lit("warning").alias("severity"), F.lit("m").alias("message")
                        )
                    ).alias("issues"),
                )
            ).alias("checks"),
        )
    )
    cut = F.when(event_number() % 10 == 0, F.substring(body, 1, 40)).otherwise(body)
    return table(spark, sf_dir, "events").select(cut.alias("body"))


def parsed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot texts read with the fixed schema; texts that are not whole JSON are dropped."""
    whole = snapshot_texts(spark, sf_dir).where(F.get_json_object("body", "$.checks").isNotNull())
    return whole.select(F.inline(F.array(F.from_json("body", H.SNAPSHOT)))).where(F.col("project").isNotNull())


@named(
    "loaded_history",
    with_views(_SNAP) + """, ok AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS age, count(*) OVER (PARTITION BY user_id) AS n
      FROM snap WHERE NOT corrupt AND NOT partial_scan AND score <> 'unscored')
    SELECT user_id::VARCHAR AS project, event_id::VARCHAR AS scan_id, score::DOUBLE AS score, least(n, 30) - age + 1 AS point FROM ok WHERE age <= 30""",
)
def loaded_history(spark, sf_dir):
    return H.load_history(parsed_snapshots(spark, sf_dir)).select("project", "scan_id", "score", "point")


@named(
    "history_findings",
    """SELECT user_id::VARCHAR AS project, event_type AS "check", sha1(event_type) AS fingerprint, count(*) AS findings FROM events
    WHERE CAST(props->>'$.k' AS INTEGER) % 10 <> 0 AND value > 50 GROUP BY ALL""",
)
def history_findings(spark, sf_dir):
    found = H.history_findings(parsed_snapshots(spark, sf_dir))
    return found.groupBy("project", "check", "fingerprint").agg(F.count(F.lit(1)).alias("findings"))


@named(
    "score_badges",
    HISTORY + """, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scan_ts DESC, scan_id DESC) AS r FROM scans),
    p AS (SELECT a.project, a.score AS current, b.score AS previous, a.score - b.score AS delta, CAST(floor((epoch_ms(a.scan_ts) - epoch_ms(b.scan_ts)) / 86400000.0) AS BIGINT) AS days
      FROM r a JOIN r b ON a.project = b.project AND a.r = 1 AND b.r = 2)
    SELECT *, CASE WHEN delta > 0 THEN '↑' WHEN delta < 0 THEN '↓' ELSE '=' END || abs(delta) || ' from ' ||
      CASE WHEN days = 0 THEN 'earlier today' WHEN days = 1 THEN 'yesterday' WHEN days <= 7 THEN 'last week' ELSE days || 'd ago' END AS badge FROM p""",
)
def score_badges(spark, sf_dir):
    return D.score_badge(event_scans(spark, sf_dir))


@named(
    "first_latest",
    HISTORY + """SELECT project, "check", arg_min(score, (scan_ts, scan_id)) AS first, arg_max(score, (scan_ts, scan_id)) AS latest, count(*) AS points,
    arg_max(score, (scan_ts, scan_id)) - arg_min(score, (scan_ts, scan_id)) AS delta FROM scans GROUP BY ALL""",
)
def first_latest(spark, sf_dir):
    return D.first_latest(event_scans(spark, sf_dir))


@named(
    "trend_series",
    HISTORY + """, r AS (SELECT *, row_number() OVER (PARTITION BY project, "check" ORDER BY scan_ts DESC, scan_id DESC) AS age FROM scans)
    SELECT project, "check", count(*) AS points, min(score) AS lowest, max(score) AS highest, arg_max(score, (scan_ts, scan_id)) AS latest FROM r WHERE age <= 30 GROUP BY ALL""",
)
def trend_series(spark, sf_dir):
    points = D.last_points(event_scans(spark, sf_dir), 30, ("project", "check"))
    return points.groupBy("project", "check").agg(
        F.count(F.lit(1)).alias("points"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        F.max_by("score", F.struct("scan_ts", "scan_id")).alias("latest"),
    )


@named(
    "sparklines",
    HISTORY + """, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scan_ts DESC, scan_id DESC) AS age FROM scans),
    k AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM r WHERE age <= 20 WINDOW w AS (PARTITION BY project))
    SELECT project, string_agg(substr('▁▂▃▄▅▆▇█', CAST(least(7, floor((score - lo)::DOUBLE / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 7)) AS BIGINT) + 1, 1), '' ORDER BY age DESC) AS line FROM k GROUP BY project""",
)
def sparklines(spark, sf_dir):
    return D.sparkline(event_scans(spark, sf_dir))


_HALVES = (
    "b AS (SELECT project, \"check\", arg_max(score, (scan_ts, scan_id)) AS score, CASE WHEN arg_max(scan_id, (scan_ts, scan_id)) % 9 = 0 THEN 'skipped' ELSE 'ran' END AS state FROM scans WHERE scan_ts < TIMESTAMP '2024-01-16' GROUP BY ALL), "
    "a AS (SELECT project, \"check\", arg_max(score, (scan_ts, scan_id)) AS score, CASE WHEN arg_max(scan_id, (scan_ts, scan_id)) % 9 = 0 THEN 'skipped' ELSE 'ran' END AS state FROM scans WHERE scan_ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)"
)
_CHECK_DELTA = with_views(SCANS, _HALVES) + """, j AS (SELECT project, "check", coalesce(b.state, 'absent') AS state_before, coalesce(a.state, 'absent') AS state_after, b.score AS bs, a.score AS as_
      FROM b FULL JOIN a USING (project, "check")),
    d AS (SELECT project, "check", state_before, state_after, CASE WHEN state_before = 'ran' THEN bs END AS before, CASE WHEN state_after = 'ran' THEN as_ END AS after,
      CASE WHEN state_before = 'ran' AND state_after = 'ran' THEN as_ - bs ELSE 0 END AS delta, CASE WHEN state_before <> state_after THEN state_before || ' → ' || state_after END AS transition FROM j)"""


def two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Newest state of every check in the first half of the month and in the second."""
    scans = event_scans(spark, sf_dir)

    def side(rows: DataFrame) -> DataFrame:
        when = F.struct("scan_ts", "scan_id")
        newest = rows.groupBy("project", "check").agg(F.max_by("score", when).alias("score"), F.max_by("scan_id", when).alias("id"))
        return newest.select("project", "check", "score", F.when(F.col("id") % 9 == 0, "skipped").otherwise("ran").alias("state"))

    middle = F.lit("2024-01-16").cast("timestamp")
    return side(scans.where(F.col("scan_ts") < middle)), side(scans.where(F.col("scan_ts") >= middle))


@named("check_delta", _CHECK_DELTA + "SELECT * FROM d WHERE delta <> 0 OR transition IS NOT NULL")
def check_delta(spark, sf_dir):
    return D.check_delta(*two_sides(spark, sf_dir))


@named("score_changes", _CHECK_DELTA + 'SELECT project, "check", before, after, delta FROM d WHERE delta <> 0')
def score_changes(spark, sf_dir):
    return D.score_changes(D.check_delta(*two_sides(spark, sf_dir))).select("project", "check", "before", "after", "delta")


@named(
    "regressions",
    HISTORY + """, l AS (SELECT *, lag(score) OVER (PARTITION BY project, "check" ORDER BY scan_ts, scan_id) AS previous FROM scans)
    SELECT project, "check", scan_id, score, previous, previous - score AS lost FROM l WHERE previous - score >= 30""",
)
def regressions(spark, sf_dir):
    lost = D.regressions(event_scans(spark, sf_dir), 30)
    return lost.select("project", "check", "scan_id", "score", "previous", "lost")


@named(
    "score_windows",
    HISTORY + "SELECT project, time_bucket(INTERVAL '1 day', scan_ts) AS window_start, count(*) AS scans, min(score) AS lowest, CAST(sum(score) AS BIGINT) AS total FROM scans GROUP BY ALL",
)
def score_windows(spark, sf_dir):
    return D.score_windows(event_scans(spark, sf_dir), "1 day")


@named(
    "sliding_score_windows",
    HISTORY + """, w AS (SELECT project, time_bucket(INTERVAL '1 day', scan_ts) - to_days(CAST(o AS INTEGER)) AS window_start, score FROM scans, (VALUES (0), (1), (2)) t(o))
    SELECT project, window_start, count(*) AS scans, min(score) AS lowest, CAST(sum(score) AS BIGINT) AS total FROM w GROUP BY ALL""",
)
def sliding_score_windows(spark, sf_dir):
    return D.score_windows(event_scans(spark, sf_dir), "3 days", "1 day")
