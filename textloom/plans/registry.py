"""Registered queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its SQL gives the same rows where SQL can express them."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bucket_distribution"](spark, sf_dir)


for _module in ("text_queries", "feature_queries", "validity_queries", "selection_queries", "alignment_queries", "metric_queries", "rule_queries", "ledger_queries", "model_queries", "candidate_queries", "report_queries", "source_queries", "choice_queries"):
    import_module(f"textloom.plans.{_module}")
