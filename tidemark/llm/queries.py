"""The operators over the benchmark tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, divergence, fingerprints, langid, licenses, lm, mixing, neardup, quality, sharding, toolcalls, urls

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40
ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern of the tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, *tokenizer()).drop("text")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), SHARDS, "rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve_cell"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark, ALLOW, BLOCK))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(docs, rules).select(*names, F.col("rule").cast("bigint").alias("rule"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "next_id",
    )


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the conversations stand for: a user's turn calls a tool, the assistant's next turn is its result.

    The text decides the tool, and whether the call uses the result of the user's turn before; some arguments break their schema.
    """
    mark = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    query = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    limit = F.when(mark % 11 == 0, F.lit('"many"')).otherwise((mark % 50).cast("string"))
    arguments = F.when(mark % 13 == 0, F.lit("{broken")).otherwise(
        F.concat(F.lit('{"query": '), F.regexp_extract(F.to_json(F.array(query)), r"(?s)^\[(.*)\]$", 1), F.lit(', "limit": '), limit, F.lit("}"))
    )
    name = F.element_at(F.array(F.lit("search"), F.lit("search"), F.lit("lookup"), F.lit("unknown_tool")), (mark % 4 + 1).cast("int"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), F.col("turn").alias("pos"), name.alias("name"), arguments.alias("arguments"),
        F.when(mark % 3 != 0, call_id(F.col("turn") - 2)).alias("after"),
    )
    results = conversations.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return calls, results


TOOLS = (
    ("search", {"query": "string", "limit": "integer"}, ["query"]),
    ("lookup", {"query": "array", "limit": "number", "language": "string"}, ["query", "language"]),
)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(list(TOOLS), "name string, kinds map<string,string>, required array<string>")
    return toolcalls.linked_calls(calls, results, schemas, further=True).withColumn("errors", F.array_join("errors", ","))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs, licenses.word_idf(docs))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.linked(docs, known.path("byte_bpe_50k.json"), known.path("piece_bpe_32k.model"), known.PATTERN)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.divergence(table(spark, sf_dir, "documents"))
    return found.select("lang", "source", "part", "item", "value", "rank")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.in_fold(F.col("doc_id")).alias("held_out"))
    model = langid.fit_model(docs.where("not held_out"))
    return langid.identified(docs.select("doc_id", "held_out", "text"), model).drop("text")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of this subpackage."""
    from tidemark.llm.queries_sql import SQL

    ops = (op1_near_duplicates, op2_byte_bpe, op3_hilbert_shards, op4_url_filters, op5_source_mix, op6_quality_rules, op7_context_tree, op8_bottom_k, op9_tool_calls, op10_license_scan, op11_token_alignment, op12_source_divergence, op13_language_id)
    return {f.__name__: f for f in ops}, dict(SQL)
