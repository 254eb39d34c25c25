"""All core queries with their SQL, and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coursewright.plans import corpus_queries, graph_queries, nested_records, parsing_queries, retrieval_queries, sequence_queries, stream_queries, sync_queries, text_queries

_MODULES = (nested_records, text_queries, retrieval_queries, graph_queries, sync_queries, sequence_queries, parsing_queries, stream_queries, corpus_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_records.p5_found(spark, sf_dir)
