"""Registry of the library's queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import assurance, checks, costs, definitions, evidence, finance, forecast, quality, reporting, rules, scenario, utilisation, views

_PARTS = (utilisation, quality, forecast, finance, scenario, views, reporting, checks, evidence, definitions, costs, rules, assurance)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utilisation.QUERIES["unit_utilisation"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.ORACLE_SQL.items()}
