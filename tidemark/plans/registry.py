"""Named queries over the benchmark tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text_queries", "page_queries", "code_queries", "history_queries", "graph_queries", "report_queries", "stream_queries")


def named(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its whole numbers come out as BIGINT."""

    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(query(spark, sf_dir))

        run.__doc__ = query.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return query

    return add


def widened(df: DataFrame) -> DataFrame:
    whole = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, whole) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        import_module(f"tidemark.plans.{module}")
    return dict(_QUERIES), dict(_SQL)
