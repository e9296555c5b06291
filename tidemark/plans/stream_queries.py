"""Streaming jobs run over the benchmark tables until they have read them all.

Each job's SQL is its batch twin. Streams write to fresh folders below the
checkpoint folder the cluster shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import named
from tidemark.plans.views import FILES, LINES, SCANS, with_views
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.corpus import scans_from_events, table
from tidemark.streaming import jobs as J

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder.

    A plain path must be a folder; a pattern (here one that matches just the name) may be a file.
    The size of a micro-batch is limited, and with it what one key can bring to a task at once.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(512 << 20)).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Run an append stream over everything there is and read back what it wrote."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    query = J.append_to(stream, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _with_state_store(spark: SparkSession, run):
    """Run with the state store that processors with several states need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def event_scans(events: DataFrame) -> DataFrame:
    return scans_from_events(events).withColumn("scan_ts", F.col("scan_ts").cast("timestamp"))


# Every replay takes at least so many micro-batches, each with rows of the whole month in no order; none is late within the patience.
BATCHES, PATIENCE, SPAN = 5, "31 days", "16 days"


def replayed(events: DataFrame, job: Callable[[DataFrame], DataFrame], batches: int = BATCHES, close_after: str = "100 days") -> DataFrame:
    """What ``job`` emits for a stream of ``events``, shuffled into files that come in ``batches`` micro-batches, and closed at the end.

    The closing is a last file with one row, null but for a time ``close_after`` the newest: it moves the watermark past
    all that is held. It comes in a second run of the query, which goes on from the checkpoint of the first.
    """
    return _run_in_turns(events.sparkSession, [_written(events, batches)], job, batches, close_after)


def replayed_in_turns(turns: list[DataFrame], job: Callable[[DataFrame], DataFrame], close_after: str = "100 days") -> DataFrame:
    """As :func:`replayed`, but ``turns`` come one after the other, each in one micro-batch, so that what is late is known."""
    return _run_in_turns(turns[0].sparkSession, [_written(t, 1) for t in turns], job, 1, close_after)


def _written(events: DataFrame, batches: int):
    files = max(batches, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if batches > 1 else 0

    def write(path: str) -> int:
        (events.repartition(files) if files else events).write.mode("append").parquet(path)
        return -(-files // batches) if files else 0

    return write


def _run_in_turns(spark: SparkSession, turns: list, job: Callable[[DataFrame], DataFrame], batches: int, close_after: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/replay-{uuid.uuid4().hex}"

    def run(files: int) -> DataFrame:
        reader = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema)
        out = job((reader.option("maxFilesPerTrigger", str(files)) if files else reader).parquet(f"{base}/in"))
        J.append_to(out, f"{base}/out", f"{base}/state").awaitTermination()
        return out

    def all_turns() -> DataFrame:
        for write in turns:
            run(write(f"{base}/in"))
        rows = spark.read.parquet(f"{base}/in")
        newest = rows.agg((F.max("ts") + F.expr(f"interval {close_after}")).cast(rows.schema["ts"].dataType).alias("ts"))
        newest.select([F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).coalesce(1).write.mode("append").parquet(f"{base}/in")
        return run(0)

    out = _with_state_store(spark, all_turns)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@named(
    "stream_secret_scan",
    with_views(FILES, LINES) + "SELECT project, path, line_no, 'secret-detected' AS rule, contains(line, 'token') AS labelled FROM lines "
    "WHERE regexp_matches(line, '(?:password|secret|api_key|apikey|token|auth)\\s*[:=]\\s*[''\"][A-Za-z0-9+/=]{20,}[''\"]')",
)
def stream_secret_scan(spark, sf_dir):
    """Secrets of arriving documents; no stored line keeps its value."""
    docs = stream_of(spark, sf_dir, "documents")
    files = docs.select(
        F.col("source").alias("project"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")
    )
    found = run_to_end(J.continuous_scan(files))
    clean = found.where(~F.col("line").rlike(r'token = "[0-9a-f]{40}'))
    return clean.select("project", "path", "line_no", "rule", F.col("line").contains("token").alias("labelled"))


@named(
    "stream_score_changes",
    with_views(SCANS) + """, l AS (SELECT *, lag(score) OVER (PARTITION BY project, "check" ORDER BY scan_ts, scan_id) AS before FROM scans)
    SELECT project, "check", scan_id, before, score AS after, score - before AS delta FROM l WHERE before IS NOT NULL AND before <> score""",
)
def stream_score_changes(spark, sf_dir):
    changes = replayed(table(spark, sf_dir, "events"), lambda e: J.live_delta(event_scans(e), PATIENCE, SPAN))
    return changes.where("kind = 'change'").select("project", "check", "scan_id", "before", "after", "delta")


@named(
    "stream_regression_alerts",
    with_views(SCANS) + """, l AS (SELECT *, lag(score) OVER (PARTITION BY project, "check" ORDER BY scan_ts, scan_id) AS before FROM scans)
    SELECT project, "check", scan_id, before - score AS lost FROM l WHERE before - score >= 40""",
)
def stream_regression_alerts(spark, sf_dir):
    alerts = replayed(table(spark, sf_dir, "events"), lambda e: J.regression_alerts(J.live_delta(event_scans(e), PATIENCE, SPAN), 40))
    return alerts.select("project", "check", "scan_id", (-F.col("delta")).alias("lost"))


@named(
    "stream_finding_delta",
    """WITH s AS (SELECT user_id, event_type, event_id, CAST(floor(value / 50) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events),
    p AS (SELECT n.user_id, n.event_type, n.event_id, n.a AS now, b.a AS before FROM s n JOIN s b ON n.user_id = b.user_id AND n.event_type = b.event_type AND n.r = b.r + 1)
    SELECT user_id::VARCHAR AS project, event_type AS "check", event_id AS scan_id, 'f' || now AS fingerprint, 'introduced' AS kind, 1::BIGINT AS copies FROM p WHERE now <> before
    UNION ALL SELECT user_id::VARCHAR, event_type, event_id, 'f' || before, 'fixed', 1 FROM p WHERE now <> before""",
)
def stream_finding_delta(spark, sf_dir):
    """Each event is a scan with one finding, named after its value band; the job reports what changed against the scan before."""

    def job(events):
        findings = events.select(
            F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("check"), F.col("ts").alias("scan_ts"), F.col("event_id").alias("scan_id"),
            F.concat(F.lit("f"), F.floor(F.col("value") / 50).cast("string")).alias("fingerprint"),
        )
        return J.live_finding_delta(findings, PATIENCE, SPAN)

    found = replayed(table(spark, sf_dir, "events"), job)
    return found.where("kind <> 'late'").select("project", "check", "scan_id", "fingerprint", "kind", "copies")


@named(
    "stream_score_windows",
    with_views(SCANS) + """, w AS (SELECT project, time_bucket(INTERVAL '1 day', scan_ts) AS window_start, count(*) AS scans, min(score) AS lowest, CAST(sum(score) AS BIGINT) AS total FROM scans GROUP BY ALL)
    SELECT project, strftime(window_start, '%Y-%m-%d') AS day, scans, lowest, total FROM w""",
)
def stream_score_windows(spark, sf_dir):
    """Daily windows, all of them closed by the watermark: the closing row comes after the last."""
    windows = replayed(table(spark, sf_dir, "events"), lambda e: J.live_trend(event_scans(e), "1 day", patience=PATIENCE))
    return windows.where("kind = 'window'").select("project", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "scans", "lowest", "total")


@named(
    "stream_late_scans",
    with_views(SCANS) + """, t AS (SELECT *, time_bucket(INTERVAL '1 day', scan_ts) + INTERVAL '1 day' AS closes, scan_id % 3 AS turn FROM scans),
    m AS (SELECT turn, max(scan_ts) - INTERVAL '5 days' AS mark FROM t GROUP BY ALL),
    l AS (SELECT t.*, coalesce((SELECT max(mark) FROM m WHERE m.turn < t.turn), TIMESTAMP '1970-01-01') AS seen FROM t)
    SELECT project, CASE WHEN closes <= date_trunc('millisecond', seen) THEN 'late' ELSE 'window' END AS kind, strftime(closes - INTERVAL '1 day', '%Y-%m-%d') AS day, count(*) AS scans, min(score) AS lowest,
      CAST(sum(score) AS BIGINT) AS total FROM l GROUP BY ALL""",
)
def stream_late_scans(spark, sf_dir):
    """Daily windows of scans that come in three turns, each with a third of all: what a turn brings for windows closed before is counted as late."""
    events = table(spark, sf_dir, "events")
    found = replayed_in_turns([events.where(F.col("event_id") % 3 == k) for k in range(3)], lambda e: J.live_trend(event_scans(e), "1 day", patience="5 days"))
    found = found.groupBy("project", "kind", F.date_format("window_start", "yyyy-MM-dd").alias("day"))
    return found.agg(F.sum("scans").alias("scans"), F.min("lowest").alias("lowest"), F.sum("total").alias("total"))


@named("stream_unique_scans", 'SELECT user_id AS project, event_type AS "check", count(*) AS scans FROM events GROUP BY ALL')
def stream_unique_scans(spark, sf_dir):
    """Every scan sent twice, kept once."""
    twice = event_scans(stream_of(spark, sf_dir, "events")).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    kept = run_to_end(J.unique_scans(twice, "31 days"))
    return kept.groupBy("project", "check").agg(F.count(F.lit(1)).alias("scans"))
