"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """node, root (smallest node that can be reached) for every end of ``edges`` (columns u, v).

    Each round points every node at its smallest neighbour or itself, shortens the pointers by
    ``jumps`` doublings, and replaces both ends of every edge by what they point at. Edges
    within one group vanish, so few rounds remain: a chain shrinks by 2 ** jumps each time.
    Joins run between written tables, so Spark can split the partition of a node with very many edges.
    """
    left = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    known: DataFrame | None = None
    while True:
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "pointers")
        for _ in range(jumps):
            above = point.select(F.col("node").alias("a"), F.col("root").alias("b"))
            point = stored(point.join(above, point["root"] == above["a"]).select("node", F.col("b").alias("root")), "pointers")
        from_u = point.select(F.col("node").alias("nu"), F.col("root").alias("ru"))
        from_v = point.select(F.col("node").alias("nv"), F.col("root").alias("rv"))
        moved = left.join(from_u, F.col("u") == F.col("nu")).join(from_v, F.col("v") == F.col("nv")).where("ru <> rv")
        left = stored(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if known is None:
            known = point
        else:
            on = point.select(F.col("node").alias("a"), F.col("root").alias("b"))
            known = stored(known.join(on, known["root"] == on["a"], "left").select("node", F.coalesce("b", "root").alias("root")), "roots")
        if left.limit(1).count() == 0:
            return known
