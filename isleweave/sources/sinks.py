"""Written results: JSON reports and annotator sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_sheets(rows: DataFrame, path: str) -> None:
    """One folder of CSV per ``annotator``, each with an empty ``relevance`` column to fill in."""
    rows.withColumn("relevance", F.lit(None).cast("string")).write.mode("overwrite").partitionBy("annotator").option("header", True).csv(path)
