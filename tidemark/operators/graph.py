"""Metrics of the import graph on node and edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.session import Scratch


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every node.

    Both ends of an edge are stacked and counted in one aggregation with map-side
    combine, so a hub costs one row per task.
    """
    ends = edges.select("src", "dst").distinct().select(
        F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    ).select("e.*")
    stacked = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return stacked.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def directory_degrees(edges: DataFrame, directory: Callable[[Column], Column]) -> DataFrame:
    """Outgoing and incoming edges per directory with instability and role."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(directory(F.col("src")).alias("dir"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(directory(F.col("dst")).alias("dir"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    sums = ends.groupBy("dir").agg(F.sum("o").alias("ce"), F.sum("i").alias("ca"))
    exact = F.col("ce") / F.greatest(F.lit(1), F.col("ce") + F.col("ca"))
    role = F.when(exact > 0.7, "unstable").when(exact < 0.3, "stable").otherwise("balanced")
    return sums.withColumn("instability", F.floor(exact * 100 + 0.5) / 100).withColumn("role", role)


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """God modules, high fan-out and connector modules.

    The node count behind the threshold is a scalar subquery.
    """
    count = nodes.agg(F.count(F.lit(1))).scalar()
    threshold = F.greatest(F.lit(3), F.floor(count * 0.5))
    return (
        degrees(nodes, edges).withColumn("god", F.col("fan_in") >= threshold)
        .withColumn("high_fan_out", F.col("fan_out") > 10)
        .withColumn("connector", (F.col("fan_in") > 5) & (F.col("fan_out") > 5))
    )


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Pairs of nodes importing each other: both directions fall into one group."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    ways = edges.select(a.alias("a"), b.alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    both = ways.groupBy("a", "b").agg(F.bool_or("up").alias("x"), F.bool_or(~F.col("up")).alias("y"))
    return both.where(F.col("x") & F.col("y")).select("a", "b")


def structure_matrix(edges: DataFrame) -> DataFrame:
    """The dependency matrix in long form: one cell per edge, with its mutual flag."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    ways = edges.select(a.alias("a"), b.alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    both = ways.groupBy("a", "b").agg(F.bool_or("up").alias("x"), F.bool_or(~F.col("up")).alias("y"))
    mutual = F.col("x") & F.col("y")
    cells = F.array_compact(
        F.array(
            F.when(F.col("x"), F.struct(F.col("a").alias("row"), F.col("b").alias("col"))),
            F.when(F.col("y"), F.struct(F.col("b").alias("row"), F.col("a").alias("col"))),
        )
    )
    return both.select(F.explode(cells).alias("_c"), mutual.alias("mutual")).select("_c.row", "_c.col", "mutual")


def assessment(edges: DataFrame, directory: Callable[[Column], Column]) -> DataFrame:
    """Cross-coupling, cohesion, layering violations and the rating of one graph.

    Edges are first counted per pair of directories; all that follows works on those
    few rows.
    """
    pairs = (
        edges.select("src", "dst").distinct()
        .groupBy(directory(F.col("src")).alias("from_dir"), directory(F.col("dst")).alias("to_dir"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stability = directory_degrees(edges, directory).select("dir", "instability")
    rows = pairs.join(stability.select(F.col("dir").alias("from_dir"), F.col("instability").alias("from_i")), "from_dir").join(
        stability.select(F.col("dir").alias("to_dir"), F.col("instability").alias("to_i")), "to_dir"
    )
    cross = (F.col("from_dir") != F.col("to_dir")) & (F.col("to_i") >= 0.35)
    violation = cross & (F.col("from_i") > 0.5) & (F.col("to_i") > 0.5)
    per_dir = rows.groupBy("from_dir").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("from_dir") == F.col("to_dir"), F.col("n")).otherwise(0)).alias("internal"),
        F.sum(F.when(cross, F.col("n")).otherwise(0)).alias("crossing"),
        F.sum(F.when(violation, F.col("n")).otherwise(0)).alias("violations"),
    )
    totals = per_dir.agg(
        F.sum("total").alias("edges"),
        S.round_half_up(F.sum("crossing") / F.sum("total") * 100).alias("cross_coupling"),
        S.round_half_up(F.avg(F.col("internal") / F.col("total")) * 100).alias("cohesion"),
        F.sum("violations").alias("violations"),
    )
    layering = F.when(F.col("violations") == 0, "clean").when(F.col("violations") < 5, "mixed").otherwise("tangled")
    rating = (
        F.when((F.col("cross_coupling") > 80) | (layering == "tangled"), "poor")
        .when((F.col("cross_coupling") > 60) | (layering == "mixed"), "fair")
        .when((F.col("cross_coupling") > 40) | (F.col("cohesion") < 20), "good")
        .otherwise("excellent")
    )
    return totals.withColumn("layering", layering).withColumn("rating", rating)


def architecture_pattern(directories: DataFrame) -> DataFrame:
    """Pattern label of each project from its directory names."""
    d = F.col("dir")
    facts = directories.groupBy("project").agg(
        F.count_distinct("dir").alias("dirs"),
        F.bool_or(d.contains("runner") | d.contains("plugin") | d.contains("check")).alias("plugins"),
        F.bool_or(d.contains("report") | d.contains("output") | d.contains("view")).alias("reports"),
    )
    label = (
        F.when(F.col("plugins") & (F.col("dirs") >= 3), "plugin")
        .when((F.col("dirs") >= 4) & F.col("reports"), "layered")
        .when(F.col("dirs") >= 3, "modular")
        .when(F.col("dirs") == 2, "two-tier")
        .otherwise("flat")
    )
    return facts.select("project", "dirs", label.alias("pattern"))


def coverage_map(nodes: DataFrame, pairing: DataFrame) -> DataFrame:
    """Share of tested files per directory. ``nodes``: project, path, dir; ``pairing``: project, path, paired."""
    joined = nodes.join(pairing, ["project", "path"], "left")
    return joined.groupBy("project", "dir").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.coalesce("paired", F.lit(False))).alias("tested"),
        S.round_half_up(F.count_if(F.coalesce("paired", F.lit(False))) / F.count(F.lit(1)) * 100).alias("percent"),
    )


# Trimming and contracting go on while they take away such a share; the rounds after them are right for any graph.
WORTH = 0.05


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has a way in and whose target has a way out."""
    out_ends, in_ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return edges.join(in_ends, "src", "left_semi").join(out_ends, "dst", "left_semi").select("src", "dst")


def _chains(edges: DataFrame, n_edges: int, scratch: Scratch) -> DataFrame | None:
    """Nodes with one way in and one way out, and where the chain each lies on begins and ends; none if they are too few to be worth the rounds.

    node, head and tail (the nearest nodes before and after that are no such nodes; null on a ring of such nodes only), and ``top``, the largest node
    seen on the way, on a ring its largest one. Pointers double each round, so rounds grow with the logarithm of the longest chain.
    """
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("after"), F.lit(None).cast(edges.schema["src"].dataType).alias("before")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["dst"].dataType).alias("after"), F.col("src").alias("before"))
    )
    single = ways.groupBy("node").agg(F.count("after").alias("n_after"), F.count("before").alias("n_before"), F.min("after").alias("after"), F.min("before").alias("before"))
    single = scratch.write(single.where("n_after = 1 AND n_before = 1").select("node", "before", "after"))
    size = single.count()
    if size < WORTH * n_edges:
        scratch.drop(single)
        return None
    inside = single.select(F.col("node").alias("other"))
    marked = single.join(inside.withColumnRenamed("other", "before"), "before", "left_anti").select("node", F.lit(True).alias("first"))
    ends = single.join(inside.withColumnRenamed("other", "after"), "after", "left_anti").select("node", F.lit(True).alias("last"))
    pointers = single.join(marked, "node", "left").join(ends, "node", "left")
    side = lambda to, done: F.struct(F.col(to).alias("to"), F.coalesce(done, F.lit(False)).alias("done"))
    pointers = scratch.write(pointers.select("node", side("before", F.col("first")).alias("back"), side("after", F.col("last")).alias("ahead"), F.col("node").alias("top")), single)
    reach = 1
    while not pointers.where("NOT back.done OR NOT ahead.done").isEmpty():
        if reach > 2 * size:
            break  # what is open now lies on rings
        known = lambda alias: pointers.select(F.col("node").alias(alias), F.col("back").alias(f"{alias}_back"), F.col("ahead").alias(f"{alias}_ahead"), F.col("top").alias(f"{alias}_top"))
        back_key, ahead_key = F.when(~F.col("back.done"), F.col("back.to")), F.when(~F.col("ahead.done"), F.col("ahead.to"))
        step = pointers.withColumn("bk", back_key).withColumn("ak", ahead_key).join(known("b"), F.col("bk") == F.col("b"), "left").join(known("a"), F.col("ak") == F.col("a"), "left")
        step = step.select("node", F.coalesce("b_back", "back").alias("back"), F.coalesce("a_ahead", "ahead").alias("ahead"), F.greatest("top", "b_top").alias("top"))
        pointers, reach = scratch.write(step, pointers), 2 * reach
    on_ring = ~F.col("back.done")
    end = lambda c: F.when(~on_ring, F.col(f"{c}.to"))
    return scratch.write(pointers.select("node", end("back").alias("head"), end("ahead").alias("tail"), "top"), pointers)


def _ranked(edges: DataFrame) -> DataFrame:
    """Nodes with their rank: the lesser of their ways in and out, since the best connected node likely lies in the largest group; then a hash."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("dst", F.lit(0), F.lit(1)))
    ways = ends.groupBy("node").agg(F.least(F.sum("out"), F.sum("in")).alias("ways"))
    return ways.select("node", F.struct("ways", F.xxhash64("node").alias("hash"), F.col("node").alias("root")).alias("best"), F.lit(True).alias("moved"))


def _reaching(edges: DataFrame, ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node of ``ranked`` with the node of the highest rank that reaches it along the edges (node, root).

    A node takes over what its neighbours know and what the node it points at knows, so that what is known reaches about half as far again each
    round. Only rows that moved are sent on.
    """
    table, first = ranked, True
    while not table.where("moved").isEmpty():
        fresh = table.where("moved")
        offers = edges.join(fresh.select(F.col("node").alias("src"), "best"), "src").groupBy(F.col("dst").alias("to")).agg(F.max("best").alias("offer"))
        jumps = fresh.select(F.col("node").alias("via"), F.col("best").alias("jump"))
        step = table.join(offers, F.col("node") == F.col("to"), "left").join(jumps, F.col("best.root") == F.col("via"), "left")
        step = step.select("node", F.greatest("best", "offer", "jump").alias("new"), "best")
        table, first = scratch.write(step.select("node", F.col("new").alias("best"), (F.col("new") > F.col("best")).alias("moved")), None if first else table), False
    return table.select("node", F.col("best.root").alias("root"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Members of every cycle group: (node, component, size), component = its largest node.

    First what can't lie on a cycle is trimmed, and chains of nodes with one way in and out are contracted to one edge, while that helps; a ring of such nodes is
    a group. Then each node learns the node of the highest rank that reaches it and, among those with the same one, the highest it reaches; where
    both agree, it belongs to that node's group. Groups and edges between different roots leave, and the rest goes on. At last the
    nodes of a chain join the group that both its ends belong to. Chains and rings of any length take a logarithmic number of rounds.

    Each round's table is written below the checkpoint folder in place of the one before, which is deleted; the driver only sees row counts.
    """
    scratch = Scratch(edges.sparkSession, "components")
    rest = scratch.write(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    found, layers = [], []
    while True:
        size, before = rest.count(), None
        while size and (before is None or size < (1 - WORTH) * before):
            before = size
            rest = scratch.write(_trimmed(rest), rest)
            size = rest.count()
            chains = _chains(rest, size, scratch) if size else None
            if chains is not None:
                layers.append(chains.where("head IS NOT NULL").select("node", "head", "tail"))
                found.append(chains.where("head IS NULL").select("node", F.col("top").alias("root")))
                inside = chains.select("node")
                open_edges = rest.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(inside.withColumnRenamed("node", "dst"), "dst", "left_anti")
                short = layers[-1].where(F.col("head") != F.col("tail")).select(F.col("head").alias("src"), F.col("tail").alias("dst"))
                rest = scratch.write(open_edges.select("src", "dst").union(short).distinct(), rest)
                size = rest.count()
        if not size:
            break
        ranked = scratch.write(_ranked(rest))
        ahead = _reaching(rest, ranked, scratch)
        rooted = rest.join(ahead.select(F.col("node").alias("src"), F.col("root").alias("one")), "src").join(ahead.select(F.col("node").alias("dst"), F.col("root").alias("two")), "dst")
        inner = scratch.write(rooted.where(F.col("one") == F.col("two")).select("src", "dst"), rest)
        back = _reaching(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ranked, scratch)
        members = scratch.write(ahead.join(back.withColumnRenamed("root", "other"), "node").where(F.col("root") == F.col("other")).select("node", "root"))
        found.append(members)
        gone = members.select("node")
        rest = scratch.write(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), inner)
    nothing = edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).where(F.lit(False))
    groups = nothing
    for part in found:
        groups = groups.unionByName(part)
    for chain in reversed(layers):
        ends = chain.join(groups.select(F.col("node").alias("head"), F.col("root").alias("one")), "head", "left").join(groups.select(F.col("node").alias("tail"), F.col("root").alias("two")), "tail", "left")
        ends = ends.select("node", "head", F.coalesce("one", "head").alias("one"), F.coalesce("two", "tail").alias("two")).where(F.col("one") == F.col("two"))
        joined = ends.select("node", F.col("one").alias("root"))
        # A head that is in no group yet is one with the chain that leads back to it.
        heads = ends.select(F.col("head").alias("node"), F.col("one").alias("root")).distinct().join(groups.select("node"), "node", "left_anti")
        groups = scratch.write(groups.unionByName(joined).unionByName(heads))
    named = groups.groupBy("root").agg(F.max("node").alias("component"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return groups.join(named, "root").select("node", "component", "size")


def cycle_findings(components: DataFrame, rule: str = "circular-dep", severity: str = "error") -> DataFrame:
    """One finding per cycle group."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")).select(
        F.lit("architecture").alias("check"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        F.concat(F.lit("Circular dependency between "), F.col("members").cast("string"), F.lit(" modules")).alias("message"),
        F.col("first").cast("string").alias("path"), "members",
    )
