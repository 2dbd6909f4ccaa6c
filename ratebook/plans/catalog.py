"""All registered queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import call_queries, corpus_queries, gate_queries, history_queries, rating_queries, store_queries, stream_queries

_MODULES = [rating_queries, call_queries, corpus_queries, gate_queries, stream_queries, store_queries, history_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rate_orders_total"](spark, sf_dir)
