"""The corpus pipeline: quality rules, near-duplicates, source mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, neardup, quality
from tidemark.llm.common import stored
from tidemark.llm.queries import table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned list, with the columns they came with."""
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, rules)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.without_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of tokens, and hashes of the ids and of what they decode to."""
    return bpe.encoded(docs.select("doc_id", "source", "text"), *tokenizer()).drop("text")


STAGES = [("quality rules", quality_stage), ("near-dedup", dedup_stage), ("source mix", mix_stage), ("byte BPE", token_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
