"""Problem 6: timestamps of hotels, news and events as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import normalise_instants
from ..sources.tables import table

FIELDS = (("hotel", "last_updated"), ("news_signal", "published_at"), ("graph_event", "start_time"))


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(f"{t}.{c}").alias("field_name"), "id", "source", F.col(c).alias("value"), "loaded_at") for t, c in FIELDS]
    return normalise_instants(parts[0].unionByName(parts[1]).unionByName(parts[2]), table(spark, folder, "feed_source"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, id, utc_s``: every value that denotes an instant and is not yet in the normal form."""
    return _instants(spark, folder).where(~F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")).select("field_name", "id", "utc_s").distinct()


def p6_normal(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, id, value, utc``: every value that denotes an instant, with its one normal form."""
    utc = F.format_string("%sT%02d:%02d:%02dZ", F.date_from_unix_date(F.floor(F.col("utc_s") / 86400).cast("int")).cast("string"), F.pmod(F.floor(F.col("utc_s") / 3600), F.lit(24)), F.pmod(F.floor(F.col("utc_s") / 60), F.lit(60)), F.pmod("utc_s", F.lit(60)))
    return _instants(spark, folder).select("field_name", "id", "value", utc.alias("utc"))


QUERIES = {"p6_found": p6_found, "p6_normal": p6_normal}
SQL: dict[str, str] = {}
