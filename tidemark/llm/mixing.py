"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, with_running, words_of

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words of each source (columns source, source_size), capped and filled up.

    Sources in code-point order, null last, take the weights in turn. Sharing the total by
    weight and handing on what exceeds a cap ends at one water level: with sources sorted by
    cap per weight, those below the level are full, the rest get weight times level. Prefix
    sums over that order find it without rounds.
    """
    named = sources.withColumn("null_last", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    turn = with_running(named, ["null_last", "name"], "mix-turn")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    capped = turn.select("source", "source_size", "null_last", "name", weight.cast("bigint").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    capped = capped.withColumn("fill", F.col("cap") / F.col("weight"))
    summed = stored(with_running(capped, ["fill", "null_last", "name"], "mix-fill", sums={"caps": "cap", "weights": "weight"}), "mix-level")
    total = summed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    words, all_weights = total["s"] or 0, total["w"] or 1
    share = F.lit(words * share_percent / 100.0)
    # The level if all sources up to and including this one are full, and the one before it if not.
    level = (share - (F.col("caps") - F.col("cap"))) / (F.lit(all_weights) - (F.col("weights") - F.col("weight")))
    reached = summed.withColumn("level", level).where("level < fill").agg(F.min_by("level", "rank_").alias("l")).first()["l"]
    target = F.col("cap").cast("double") if reached is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(reached)))
    return summed.select("source", "source_size", "weight", target.alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The source's one random offset in [0, 1), fixed by the seed and its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: int = 17, **settings: int) -> DataFrame:
    """Copies of each document, so that every source's words come near its target.

    Within a source all documents have the same expected copies, target / source_size. They are
    ordered by size, doc_id and an order number; the prefix sum of expected copies, moved by one
    random offset per source, emits a copy at each integer it crosses. Neighbours are of like size,
    so the words taken stay within about one document of the target, and no document is
    taken more than ceil(target / source_size) times.

    Adds size, source_size, target, copies, taken to the given rows as doc_id, source and row
    number; returns doc_id, source, size, source_size, target, copies, taken. Null or empty text
    has size 0; a source without words has target 0 and takes nothing. Null sources form a source
    of their own, repeated rows are rows of their own, an empty table gives an empty result, other
    columns are ignored.
    """
    return _mixed(_sized(docs), seed, **settings).drop("row")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.size(words_of(F.col("text"))).cast("bigint")
    return stored(docs.select("doc_id", "source", size.alias("size")).withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def _mixed(rows: DataFrame, seed: int, **settings: int) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources, **settings), "mix-targets").select(F.col("source").alias("s_"), "source_size", "target")
    keyed = rows.withColumn("null_last", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("id_null", F.col("doc_id").isNull())
    ranked = stored(with_running(keyed, ["null_last", "name", "size", "id_null", "doc_id", "row"], "mix-order", by=["null_last", "name"]), "mix-ranked")
    joined = ranked.join(targets, ranked["source"].eqNullSafe(targets["s_"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset_of(F.col("source"), seed)
    copies = F.floor((F.col("rank_") + 1) * rate + u) - F.floor(F.col("rank_") * rate + u)
    return joined.withColumn("copies", copies.cast("bigint")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row"
    )


def mixed_documents(docs: DataFrame, seed: int = 17, **settings: int) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; its columns are kept.

    Columns travel in one struct, so any names may be among them. Nulls, empty texts, repeated rows and empty
    tables are handled as by ``mix``: rows without words are never taken. A very long text is one row like others.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    held = stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "mix-docs")
    own = lambda c: F.col("whole")[c].alias(c)
    rows = held.select(own("doc_id"), own("source"), F.size(words_of(F.col("whole")["text"])).cast("bigint").alias("size"), "row")
    copies = _mixed(rows, seed, **settings).where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return held.join(copies, "row").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("whole.*")
