"""A whole scan as one lazy plan: lines, findings, redaction, identity, scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.rules import LINE_PACKS, RESOURCE_LIFECYCLE, Pack
from tidemark.functions.redaction import redacted
from tidemark.operators.findings import all_findings
from tidemark.operators.fingerprints import fingerprint
from tidemark.operators.rules import scan_files, scan_lines, to_lines
from tidemark.operators.scores import check_meta, composite, score_checks

Check = Callable[[DataFrame], DataFrame]
_custom_checks: dict[str, Check] = {}


def register_check(name: str, check: Check) -> None:
    """Add a check of your own: a function from files to findings."""
    _custom_checks[name] = check


def pack_from_rows(name: str, rows: Sequence[dict], skip: Sequence[str] = ()) -> Pack:
    """A rule pack from catalogue rows (check, rule, severity, message, pattern, ...)."""
    from tidemark.catalog.rules import Rule

    return Pack(name, tuple(Rule(**row) for row in rows), tuple(skip))


def find(files: DataFrame, packs: Sequence[Pack] = LINE_PACKS) -> DataFrame:
    """Findings of all line packs, the resource rules and the registered checks."""
    lines = to_lines(files)
    parts = [scan_lines(lines, pack) for pack in packs]
    parts.append(scan_files(files, RESOURCE_LIFECYCLE))
    parts += [check(files) for check in _custom_checks.values()]
    return all_findings(*parts)


def identify(findings: DataFrame) -> DataFrame:
    """Redact what is stored, then fingerprint it: the anchor hashes the redacted line."""
    clean = findings.withColumn("line", redacted(F.col("line"))).withColumn("message", redacted(F.col("message")))
    return fingerprint(clean)


def score(findings: DataFrame, files: DataFrame, checks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Check scores and the composite score of every project."""
    units = files.groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "check", F.explode(F.array(*[F.lit(c) for c in checks]))
    )
    per_check = score_checks(findings, units)
    return per_check, composite(per_check, check_meta(files.sparkSession))
