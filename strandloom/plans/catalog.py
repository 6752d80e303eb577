"""All queries by name, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import duplicon_queries, element_queries, format_queries, hit_queries, joining_queries, nesting_queries, pair_queries, rule_queries, sequence_queries, tail_queries
from strandloom.session import shipped


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["class_coverage"](spark, sf_dir)


def _all() -> dict[str, tuple[Callable, str | None]]:
    return {**hit_queries.QUERIES, **sequence_queries.QUERIES, **format_queries.QUERIES, **element_queries.QUERIES, **pair_queries.QUERIES, **joining_queries.QUERIES, **rule_queries.QUERIES, **nesting_queries.QUERIES, **duplicon_queries.QUERIES, **tail_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(f) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
