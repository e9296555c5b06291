"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lowered, stored, with_running, words_of

K = 128
SHINGLE = 5


def shingle_hashes(words: str | Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of ``size`` words; of the whole sequence if shorter; none without words."""
    ws = F.col(words) if isinstance(words, str) else words
    n = F.size(ws)
    run = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)])
    return (
        F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), run))
        .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", ws))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes in ascending order; all of them if there are fewer."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    top = (F.get(sketch, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / top)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    union = merged(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)), F.size(union)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's bottom k that both hold. Two empty sketches: 1."""
    both, size = _shared(a, b, k)
    return F.when(size > 0, both / size).otherwise(F.lit(1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first document's shingles that the second holds too. An empty first: 1."""
    part = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) > 0, F.least(part, F.lit(1.0))).otherwise(F.lit(1.0))


def as_text(sketch: Column) -> Column:
    """The hashes as 16 hex digits each, without separator."""
    return F.lower(F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0"))))


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """``df`` with the bottom-k sketch of its column ``text``, A-Z lower-cased; null counts as empty."""
    df = df.withColumn("words_", words_of(lowered(F.col(text))))
    return df.withColumn("hashes_", shingle_hashes("words_")).withColumn(name, bottom_k(F.col("hashes_"), k)).drop("words_", "hashes_")


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document beside the next one (descending doc_id, after the last the first) and an edited text.

    In the edited text the last half of the code points is replaced by as many from the start of
    the next text. Returns doc_id, next_id, n_chars, sketch, edited, edited_sketch, next_sketch. Null texts
    are empty. Documents of equal or null doc_id are told apart by the hash of their text, null ids last; rows
    that agree in both are one document and share its next. An empty table gives an empty result; a single
    document is its own next. Other columns are ignored.

    Neighbours are found on keys alone. The texts are dealt by key once, for both roles; only the part of
    the next text that an edit can use moves on to its neighbour, with that text's sketch.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ["id_null", "back", "hash"]
    rows = docs.select(
        "doc_id", text.alias("text"), F.col("doc_id").isNull().alias("id_null"), F.coalesce(-F.col("doc_id"), F.lit(0)).alias("back"), F.xxhash64(text).alias("hash")
    )
    narrow = rows.select(*keys, F.length("text").alias("n")).distinct()
    ranked = stored(with_running(narrow, keys, "edit-order"), "edit-ranked")
    total = max(ranked.count(), 1)
    # The document of rank r lends its start to the one of rank r - 1.
    lends = ranked.select(*[F.col(c).alias(f"from_{c}") for c in keys], ((F.col("rank_") + total - 1) % total).alias("to_rank"))
    takes = ranked.select(*[F.col(c).alias(f"to_{c}") for c in keys], "rank_", F.floor(F.col("n") / 2).cast("int").alias("half"))
    needs = stored(lends.join(takes, F.col("to_rank") == F.col("rank_")).drop("to_rank", "rank_"), "edit-needs")
    same = lambda a, b: (F.col(f"{a}{keys[0]}") == F.col(f"{b}{keys[0]}")) & (F.col(f"{a}{keys[1]}") == F.col(f"{b}{keys[1]}")) & (F.col(f"{a}{keys[2]}") == F.col(f"{b}{keys[2]}"))
    dealt = rows.join(needs, same("", "from_"))
    part = dealt.select(*[F.col(f"to_{c}").alias(f"part_{c}") for c in keys], F.col("doc_id").alias("next_id"), "text", "half", *[F.col(c).alias(f"key_{c}") for c in keys])
    part = with_sketch(part.dropDuplicates([f"key_{c}" for c in keys]), "text", "next_sketch", k)
    part = part.select(*[f"part_{c}" for c in keys], "next_id", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"), "next_sketch")
    both = dealt.select("doc_id", "text", *keys).join(part, same("", "part_"))
    keep = F.length("text") - F.floor(F.length("text") / 2)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep.cast("int")), F.col("head"))
    out = both.select("doc_id", "next_id", F.length("text").cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "next_sketch")
    return with_sketch(with_sketch(out, "text", "sketch", k).drop("text"), "edited", "edited_sketch", k)
