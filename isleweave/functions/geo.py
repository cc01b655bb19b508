"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def known(lat: Column, lng: Column) -> Column:
    """True where a position is known: neither coordinate null, NaN or 0.0, and both within range."""
    ok = lambda c, most: c.isNotNull() & ~F.isnan(c) & (c != 0.0) & (F.abs(c) <= most)
    return ok(lat, 90.0) & ok(lng, 180.0)


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance on a sphere of radius 6371 km; null where any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    a = F.when(a > 1, 1.0).otherwise(a)  # least() would hide a null
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring (array of struct lat, lng); false for fewer than 3 corners."""
    size = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, size))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return F.when(spans & (lng < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), F.lit(0), lambda acc, i: acc + crosses(i))
    return F.when(size >= 3, F.pmod(hits, F.lit(2)) == 1).otherwise(F.lit(False))
