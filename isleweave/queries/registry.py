"""All queries of the core library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph, instants, proximity, ranking, texts, units

MODULES = (proximity, units, instants, graph, texts, ranking)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.weighted_retrieve(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
