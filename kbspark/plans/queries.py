"""The registered queries of the library's own operators, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbspark.plans import chats, graphs, retrieval, streams, texts

PLANS = (retrieval, graphs, texts, chats, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
