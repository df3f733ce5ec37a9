"""Queries of the operators and the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyframe.queries import base, models, science, tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (tables, science, models)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object manifest with splits, and its balance."""
    return base.QUERIES["manifest_balance"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
