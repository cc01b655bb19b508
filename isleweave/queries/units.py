"""Problem 2: ratings and prices in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import hotel_units, not_in_common_unit
from ..sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """``id, field_name, unit``: every known value that is not in the common unit."""
    return not_in_common_unit(hotel_units(table(spark, folder, "hotel"), table(spark, folder, "fx_rate")))


def p2_common(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings (0-5) and nightly prices (LKR) of every hotel row in common units, rounded half up."""
    to = lambda c, n: F.floor(F.col(c) * n + 0.5) / n
    rows = hotel_units(table(spark, folder, "hotel"), table(spark, folder, "fx_rate"))
    return rows.select("id", "source", to("rating_5", 100).alias("rating_5"), to("price_lkr", 1).alias("price_lkr"), to("lkr_value", 1).alias("lkr_value"))


QUERIES = {"p2_found": p2_found, "p2_common": p2_common}
SQL: dict[str, str] = {}
