"""Stable identity of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import NUL, normalise_message, normalise_path, short_hash, squeeze


def fingerprint_v1(findings: DataFrame) -> DataFrame:
    """check + rule + path + message."""
    return findings.withColumn(
        "fingerprint_v1",
        short_hash(
            F.col("check"), F.col("rule"), normalise_path(F.col("path")), normalise_message(F.col("message"))
        ),
    )


def snippet_digest(snippet: Column) -> Column:
    """Twelve hex digits over the text with white space squeezed."""
    return F.substring(F.sha1(squeeze(snippet)), 1, 12)


def fingerprint(findings: DataFrame) -> DataFrame:
    """Identity that survives moved lines and changed numbers.

    The key is the finding's subject when it has one, else the v1 key anchored on
    the text of its line (``line``, already redacted; null = not anchored). Equal
    keys are numbered by line, then ``seq``; the first keeps the plain hash.

    The numbering runs inside one project, check and key. Without a subject that
    is one file, so a group is bounded by the size of a source file, not by how
    large the project is; most findings are alone in theirs.
    """
    cols = findings.columns
    subject = F.col("subject") if "subject" in cols else F.lit(None).cast("string")
    path = normalise_path(F.col("path"))
    anchored = F.col("line").isNotNull() & (F.col("line_no") >= 1) & ~F.lower(path).rlike(r"\.(vue|svelte)\z")
    base = F.concat_ws(
        NUL,
        F.coalesce("check", F.lit("")),
        F.coalesce("rule", F.lit("")),
        path,
        normalise_message(F.col("message")),
        F.when(anchored, F.concat(F.lit("@"), snippet_digest(F.col("line")))),
    )
    by_subject = F.concat_ws(NUL, F.lit("v2"), "check", F.coalesce("rule", F.lit("")), F.lit("subject"), subject)
    keyed = findings.withColumn("_key", F.when(F.coalesce(subject, F.lit("")) != "", by_subject).otherwise(base))
    scope = [c for c in ("project", "scan_id") if c in cols]
    order = Window.partitionBy(*scope, "_key").orderBy(F.coalesce("line_no", F.lit(0)), "seq")
    numbered = keyed.withColumn("_n", F.row_number().over(order) - 1)
    suffix = F.when(F.col("_n") > 0, F.concat(F.lit("#"), F.col("_n").cast("string")))
    full = F.substring(F.sha1(F.concat_ws(NUL, "_key", suffix)), 1, 16)
    return numbered.withColumn("fingerprint", full).drop("_key", "_n")


def comparable_key(version_before: Column, version_after: Column, stored: Column, v1: Column) -> Column:
    """Stored fingerprints within one version, v1 on both sides across versions."""
    return F.when(F.coalesce(version_before, F.lit(1)) == F.coalesce(version_after, F.lit(1)), F.coalesce(stored, v1)).otherwise(v1)
