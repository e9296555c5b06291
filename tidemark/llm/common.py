"""Helpers that the operators share: words, shared tables, ranks over a total order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    A temporary folder serves only in local mode, where all tasks share one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    What follows survives lost executors without recomputation, sees the same rows however
    often it is planned, and joins plain scans, whose skewed partitions Spark can split.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def with_running(
    df: DataFrame, order: list[str], name: str, by: list[str] | None = None, sums: dict[str, str] | None = None, rank: str = "rank_"
) -> DataFrame:
    """``df`` with ``rank`` (from 0) and inclusive running sums over a total order, per ``by`` (no nulls).

    ``order`` must begin with ``by`` and be unique. Rows are dealt by range, counted and summed
    within each range, and moved by the total of the ranges before it: a hot group spreads over
    as many tasks as it has ranges, and no task sees more than its range. The one window without
    a key (only when ``by`` is empty) runs over one row per range.
    """
    by, sums = by or [], sums or {}
    dealt = stored(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), name)
    inside = W.partitionBy("part_", *by).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = dealt.groupBy("part_", *by).agg(F.count("*").alias("n_"), *[F.sum(v).alias(f"{k}_n_") for k, v in sums.items()])
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part_", *[F.col(c).alias(f"{c}_by_") for c in by],
        F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n_"),
        *[F.coalesce(F.sum(f"{k}_n_").over(before), F.lit(0)).alias(f"{k}_n_") for k in sums],
    )
    rows = dealt.withColumn(rank, F.row_number().over(inside) - 1)
    for k, v in sums.items():
        rows = rows.withColumn(k, F.sum(v).over(so_far))
    same = rows["part_"] == offsets["part_"]
    for c in by:
        same = same & (rows[c] == offsets[f"{c}_by_"])
    joined = rows.join(offsets, same)
    keep = [c for c in rows.columns if c not in ("part_", rank, *sums)]
    return joined.select(
        *[rows[c] for c in keep], (rows[rank] + offsets["n_"]).alias(rank),
        *[(rows[k] + offsets[f"{k}_n_"]).alias(k) for k in sums],
    )
