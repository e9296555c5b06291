"""Ordered work per key that stays distributed when one key dominates.

A plain window puts every row of a key into one task. The helpers here first cut
a key into salts or ordered buckets, work inside those, and only then combine the
small per-bucket results, so a key holding a third of all rows is still shared
between tasks. All of them are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows of each key; a salted pre-selection bounds the second step at ``salts * n`` rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(inner))
        .where(F.col("_r") <= n)
        .drop("_r", "_salt")
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= n)
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, buckets: Sequence[Column], out: str
) -> DataFrame:
    """``lag(value)`` per key in ``order``, worked out bucket by bucket.

    ``buckets`` are nested, finest first (minute, day), grow with ``order`` and must
    not be null, nor must the keys. Inside a finest bucket a window looks back one
    row; its first row takes the last value of the nearest earlier bucket, which is
    found the same way among the bucket ends, one level coarser. No window ever
    holds more than one finest bucket, or the buckets of one coarser one.
    """
    keys, order = list(keys), list(order)
    levels = [f"_bucket{i}" for i in range(len(buckets))]
    tagged = df.select(*df.columns, *[b.alias(n) for b, n in zip(buckets, levels)], F.struct(value.alias("v")).alias("_value"))
    return _previous(tagged, keys, order, levels).select(*df.columns, F.col("_prev.v").alias(out))


def _previous(df: DataFrame, keys: list[str], order: list[str], levels: list[str]) -> DataFrame:
    """Adds ``_prev``, the ``_value`` of the row before."""
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    lagged = df.withColumn("_prev", F.lag("_value").over(inside))
    if not levels:
        return lagged
    finest, coarser = levels[0], levels[1:]
    ends = df.groupBy(*keys, *levels).agg(F.max_by("_value", F.struct(*order)).alias("_value"))
    before = _previous(ends, keys, [finest], coarser).select(*keys, *levels, F.col("_prev").alias("_before"))
    joined = lagged.join(before, [*keys, *levels], "left")
    return joined.withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before")


def numbered_runs(
    df: DataFrame, keys: Sequence[str], position: str, first: Sequence[str] = (), last: Sequence[str] = ()
) -> DataFrame:
    """Collapse consecutive whole positions of a key into ``(start, stop, size)`` runs.

    Runs are first found inside fixed stretches of positions, then stitched together
    across the stretch borders, so one long key is shared by many tasks. ``first``
    and ``last`` name columns to carry over from the first and last row of a run.
    """
    keys = list(keys)
    width = 4096
    head = F.struct(position, *first)
    tail = F.struct(position, *last)
    cut = df.select(*keys, F.col(position), head.alias("_head"), tail.alias("_tail")).withColumn(
        "_bucket", F.floor(F.col(position) / width)
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position)
    pieces = (
        cut.withColumn("_island", F.col(position) - F.row_number().over(inside))
        .groupBy(*keys, "_bucket", "_island")
        .agg(F.min("_head").alias("_head"), F.max("_tail").alias("_tail"))
    )
    start, stop = F.col(f"_head.{position}"), F.col(f"_tail.{position}")
    order = Window.partitionBy(*keys).orderBy(start)
    fresh = (start != F.coalesce(F.lag(stop).over(order), start - 2) + 1).cast("int")
    linked = pieces.withColumn("_new", fresh).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = linked.groupBy(*keys, "_run").agg(F.min("_head").alias("_head"), F.max("_tail").alias("_tail"))
    return runs.select(
        *keys,
        start.alias("start"),
        stop.alias("stop"),
        (stop - start + 1).alias("size"),
        *[F.col(f"_head.{c}").alias(c) for c in first],
        *[F.col(f"_tail.{c}").alias(c) for c in last],
    )
