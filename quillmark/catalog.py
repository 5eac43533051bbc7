"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.queries import comparison, functions, planning, retrieval, round_trips, tests_and_trials

_ALL = retrieval.QUERIES | comparison.QUERIES | tests_and_trials.QUERIES | planning.QUERIES | functions.QUERIES | round_trips.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ALL["bm25_topk"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ALL.items() if text}
