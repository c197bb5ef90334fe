"""All queries of the posting engine, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans import detail_queries, page_queries, posting_queries, report_queries, run_queries, source_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [detail_queries, page_queries, posting_queries, report_queries, run_queries, source_queries, stream_queries]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_queries.rule_stage(spark, sf_dir)
