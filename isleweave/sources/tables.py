"""Reading the engine's tables: one parquet file or folder per table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``folder``; columns are pruned and filters pushed by Catalyst."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
