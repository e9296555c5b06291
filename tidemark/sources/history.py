"""Stored scans: append-only tables, JSON snapshots and SARIF documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.tables import HISTORY_LENGTH
from tidemark.operators.deltas import last_points
from tidemark.operators.findings import sarif_results, sarif_rules

SNAPSHOT = (
    "project string, scan_id string, timestamp string, score string, "
    "meta struct<scan:struct<diffBase:string>,fingerprintVersion:int>, "
    "checks array<struct<name:string,status:string,score:double,details:struct<status:string,reason:string,skipped:boolean,"
    "unavailable:boolean,comingSoon:boolean>,issues:array<struct<fingerprint:string,severity:string,message:string,file:string,line:int,rule:string>>>>"
)


def write_scan(scans: DataFrame, findings: DataFrame, path: str) -> None:
    """Append a scan to the scan and finding tables, partitioned by day.

    Rows are clustered by day and project before writing, so that a day gets few files
    and readers of one project skip most of them.
    """
    for name, rows in (("scans", scans), ("findings", findings)):
        dated = rows.withColumn("scan_date", F.to_date("scan_ts"))
        dated.repartitionByRange("scan_date", "project", "scan_ts").write.mode("append").partitionBy("scan_date").parquet(f"{path}/{name}")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON snapshots with a fixed schema; documents that are not JSON are dropped."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)


def usable_snapshots(snapshots: DataFrame) -> DataFrame:
    """Full scans with a finite score and checks; scans of changed files only are no history."""
    score = F.col("score").try_cast("double")
    full = F.coalesce(F.col("meta.scan.diffBase"), F.lit("")) == ""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return snapshots.where(finite & full & F.col("checks").isNotNull()).withColumn("score", score).withColumn(
        "scan_ts", F.col("timestamp").try_cast("timestamp")
    )


def load_history(snapshots: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """The newest ``n`` usable snapshots of each project, oldest first."""
    flat = usable_snapshots(snapshots).select("project", "scan_id", "scan_ts", "score")
    return last_points(flat, n)


def history_findings(snapshots: DataFrame) -> DataFrame:
    """Findings stored in snapshots; those without fingerprint, message or known severity are dropped."""
    checks = snapshots.select("project", "scan_id", F.explode("checks").alias("c"))
    rows = checks.select("project", "scan_id", F.col("c.name").alias("check"), F.explode("c.issues").alias("i")).select(
        "project", "scan_id", "check", "i.fingerprint", "i.rule", "i.severity", F.col("i.file").alias("path"),
        F.col("i.line").alias("line_no"), "i.message",
    )
    known = (F.coalesce("fingerprint", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != "")
    return rows.where(known & F.col("severity").isin("error", "warning", "info"))


def write_sarif(findings: DataFrame, path: str, tool: str, version: str) -> None:
    """SARIF 2.1.0 runs as JSON lines.

    A project's results are cut into runs of bounded size by finding hash, which SARIF
    allows (a log holds many runs), so no project is gathered into one document.
    """
    sized = sarif_results(findings)
    counts = sized.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / 5000)).cast("int")
    cut = sized.join(counts, "project").withColumn("_part", F.pmod(F.xxhash64("result"), parts))
    results = cut.groupBy("project", "_part").agg(F.collect_list("result").alias("_r"))
    rules = sarif_rules(findings).groupBy("project").agg(F.sort_array(F.collect_list("rule")).alias("_u"))
    run = F.concat(
        F.lit(f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['),
        F.array_join("_u", ","), F.lit(']}},"results":['), F.array_join("_r", ","), F.lit("]}]}"),
    )
    results.join(rules, "project").select(run.alias("value")).write.mode("overwrite").text(path)
