"""Sharding along a Hilbert curve over document metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, with_running

BITS = 4


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell whose coordinates have ``bits`` bits each.

    Skilling's transform: Gray-decode from the highest bit down by conditional exchange and
    inversion, then interleave. Only integer column arithmetic; its size is fixed by ``bits``
    and the number of coordinates.
    """
    x, n = [c.cast("int") for c in coords], len(coords)
    state = F.struct(*[c.alias(f"x{i}") for i, c in enumerate(x)])

    def step(i: int, q: int) -> Callable[[Column], Column]:
        def on(s: Column) -> Column:
            p, first, own = q - 1, s["x0"], s[f"x{i}"]
            swap = F.when(own.bitwiseAND(q) != 0, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(p))
            new_first = F.when(own.bitwiseAND(q) != 0, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap))
            return F.struct(*[(new_first if k == 0 else s[f"x{k}"].bitwiseXOR(swap) if k == i else s[f"x{k}"]).alias(f"x{k}") for k in range(n)])

        return on

    # Each step is one lambda over a one-element array, so that expressions stay linear in size.
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            state = F.transform(F.array(state), step(i, 1 << b))[0]

    def gray(s: Column) -> Column:
        out = [s["x0"]]
        for k in range(1, n):
            out.append(s[f"x{k}"].bitwiseXOR(out[-1]))
        return F.struct(*[c.alias(f"x{k}") for k, c in enumerate(out)])

    state = F.transform(F.array(state), gray)[0]

    def index(s: Column) -> Column:
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(s[f"x{n - 1}"].bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        value = F.lit(0).cast("bigint")
        for b in range(bits - 1, -1, -1):
            for k in range(n):
                bit = F.shiftright(s[f"x{k}"].bitwiseXOR(t), b).bitwiseAND(1)
                value = F.shiftleft(value, 1).bitwiseOR(bit.cast("bigint"))
        return value

    return F.transform(F.array(state), index)[0]


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Logarithmic size class: two classes per power of two from 32 bytes on, clamped to the grid."""
    return F.least(F.greatest(F.floor(F.log2(size.cast("double")) * 2 - 10), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def name_cell(name: Column, bits: int = BITS) -> Column:
    """Cell of a name: its CRC-32 (null: of no bytes) on the grid."""
    return F.pmod(F.crc32(F.coalesce(name, F.lit("")).cast("binary")), F.lit(1 << bits)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int, law: str = "rows") -> DataFrame:
    """Cut the documents, ordered along a Hilbert curve, into ``shards`` runs.

    Dimensions: size class, language, source. Equal texts take the smallest language and source
    of their group, so that they lie side by side and meet in one shard unless a cut runs through
    them. ``law`` is ``rows`` (counts at most one apart) or ``bytes`` (a document goes to the
    shard in which its middle byte falls). Returns doc_id, size, text_crc32, cell, law, shard, slot.

    Null or empty text: size 16, CRC-32 0. Null doc_id, source or language count as values of
    their own. Repeated rows with equal doc_id are each placed (an order number splits ties); an
    empty table gives an empty result; other columns are ignored.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    return _placed(docs, shards, law).drop("row")


def _placed(docs: DataFrame, shards: int, law: str, row: Column | None = None) -> DataFrame:
    """The places with the row number of every document: ``row``, or one of its own."""
    narrow = docs.select(
        F.col("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )
    rows = stored(narrow, "shard-rows")
    copies = rows.groupBy("same", "size").agg(F.min("lang").alias("g_lang"), F.min("source").alias("g_source"), F.count("*").alias("n"))
    copies = stored(copies.where("n > 1").drop("n"), "shard-copies")
    placed = rows.join(copies, ["same", "size"], "left").select(
        "doc_id", "size", "text_crc32", "same", "row",
        F.coalesce("g_lang", "lang").alias("lang"), F.coalesce("g_source", "source").alias("source"),
    )
    cell = hilbert_index([size_cell(F.col("size")), name_cell(F.col("lang")), name_cell(F.col("source"))])
    order = ["cell", "same", "id_null", "doc_id", "row"]
    keyed = placed.select("doc_id", "size", "text_crc32", cell.alias("cell"), "same", F.col("doc_id").isNull().alias("id_null"), "row")
    ranked = with_running(keyed, order, "shard-order", sums={"upto": "size"})
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, total_bytes = total["n"], max(total["bytes"], 1)
    if law == "rows":
        shard = F.expr(f"rank_ * {shards} div {max(n, 1)}")
        out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"rank_ - ((cast(shard as bigint) * {n} + {shards - 1}) div {shards})"))
    else:
        ranked = stored(ranked, "shard-ranked")
        out = ranked.withColumn("shard", F.expr(f"cast(((2 * upto - size) * {shards}) div (2 * {total_bytes}) as int)"))
        first = out.groupBy("shard").agg(F.min("rank_").alias("first"))
        out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank_") - F.col("first"))
    return out.select("doc_id", "size", "text_crc32", "cell", F.lit(law).alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "row")


def write_shards(docs: DataFrame, path: str, shards: int, law: str = "rows", files: int = 8) -> None:
    """Place the documents and write them as one folder per shard, rows in curve order.

    A shard is cut along its slots into about ``files`` files, each written by a task of its own. Names are dealt to
    cells by hash, so the range of a file's names says little; what a file holds few of are cells. They are written as
    size_cell, lang_cell and source_cell: a reader who filters on ``source_cell = name_cell(lit(name))`` beside
    the source itself skips most files by their statistics.
    Every row is written once, whatever its doc_id: rows are joined with their places by number. The documents
    stand in the column ``doc`` with all their columns, so any names may be among them, beside cell and slot.
    Null and empty texts, repeated rows and empty tables as in ``hilbert_shards``; an empty table writes no folder.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    held = stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "shard-docs")
    narrow = held.select(*[F.col("doc")[c].alias(c) for c in ("doc_id", "text", "lang", "source")], "row")
    places = _placed(narrow, shards, law, F.col("row")).select("row", "cell", "shard", "slot")
    cells = {
        "size_cell": size_cell(F.octet_length(F.coalesce(F.col("doc")["text"], F.lit(""))) + 16),
        "lang_cell": name_cell(F.col("doc")["lang"]), "source_cell": name_cell(F.col("doc")["source"]),
    }
    ordered = held.join(places, "row").drop("row").withColumns(cells).repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
