"""Problem 1: signals near hotels, and positions inside regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.proximity import near_pairs, points_in_regions
from ..sources.tables import table

RADIUS_KM = 0.08
#: Half the side, in degrees, of the square region drawn around each city.
HALF_SIDE = 0.03


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """``hotel_id, signal_id``: every known signal position at most 80 m from a hotel."""
    pairs = near_pairs(table(spark, folder, "hotel"), table(spark, folder, "traffic_signal"), RADIUS_KM)
    return pairs.select(F.col("left_id").alias("hotel_id"), F.col("right_id").alias("signal_id"))


def p1_region_signals(spark: SparkSession, folder: str) -> DataFrame:
    """``city, signals``: distinct signals inside the square region around each city centre."""
    corner = lambda y, x: F.struct((F.col("lat") + y * HALF_SIDE).alias("lat"), (F.col("lng") + x * HALF_SIDE).alias("lng"))
    cities = table(spark, folder, "city").where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    regions = cities.select(F.col("name").alias("region_id"), F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)).alias("ring"))
    inside = points_in_regions(table(spark, folder, "traffic_signal"), regions)
    return inside.groupBy(F.col("region_id").alias("city")).agg(F.countDistinct("id").alias("signals"))


QUERIES = {"p1_found": p1_found, "p1_region_signals": p1_region_signals}

_KNOWN = "lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0"
SQL = {
    "p1_found": f"""
        WITH h AS (SELECT DISTINCT id, lat, lng FROM hotel WHERE {_KNOWN}),
             s AS (SELECT DISTINCT id, lat, lng FROM traffic_signal WHERE {_KNOWN})
        SELECT DISTINCT h.id AS hotel_id, s.id AS signal_id
        FROM h JOIN s ON s.lat BETWEEN h.lat - 0.001 AND h.lat + 0.001 AND s.lng BETWEEN h.lng - 0.001 AND h.lng + 0.001
        WHERE 2 * 6371.0e0 * asin(sqrt(pow(sin(radians(s.lat - h.lat) / 2), 2)
              + cos(radians(h.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - h.lng) / 2), 2))) <= 0.08e0""",
    "p1_region_signals": f"""
        SELECT c.name AS city, count(DISTINCT s.id) AS signals
        FROM city c JOIN traffic_signal s ON s.lat BETWEEN c.lat - 0.03e0 AND c.lat + 0.03e0 AND s.lng BETWEEN c.lng - 0.03e0 AND c.lng + 0.03e0
        WHERE s.{_KNOWN.replace('AND lng', 'AND s.lng').replace('AND lat', 'AND s.lat')}
        GROUP BY c.name""",
}
