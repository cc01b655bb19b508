"""Ranking candidates by a weighted sum of normalised sub-scores, for many queries and groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import join_small

#: Default weights of the sub-scores.
WEIGHTS = {"spatial": 0.25, "accessibility": 0.20, "facility": 0.25, "economic": 0.15, "disruption": 0.15}

#: Personas with their weights, their liking of events and of nearness.
PERSONAS = {
    "event_seeker": ({"spatial": 0.30, "accessibility": 0.15, "facility": 0.30, "economic": 0.10, "disruption": 0.15}, "seek", "close"),
    "quiet_seeker": ({"spatial": 0.10, "accessibility": 0.25, "facility": 0.20, "economic": 0.10, "disruption": 0.35}, "avoid", "far"),
    "budget_traveler": ({"spatial": 0.15, "accessibility": 0.15, "facility": 0.15, "economic": 0.45, "disruption": 0.10}, "neutral", "any"),
    "luxury_traveler": ({"spatial": 0.20, "accessibility": 0.15, "facility": 0.45, "economic": 0.05, "disruption": 0.15}, "neutral", "any"),
}
EVENT_WEIGHT = 0.30


def persona_weights(persona: str | None, event: bool) -> dict[str, float] | None:
    """Weights of a persona (any case; None for an unknown one), with an event weight where it seeks or avoids an active event."""
    known = PERSONAS.get((persona or "").lower())
    if known is None:
        return None
    return normalised(known[0] | {"event": EVENT_WEIGHT if event and known[1] in ("seek", "avoid") else 0.0})


#: How much each sign of an intent moves a weight.
DELTAS = [
    ("cheapest", "economic", 0.20), ("cheapest", "facility", -0.05), ("highest_rated", "facility", 0.20), ("highest_rated", "economic", -0.05), ("most_accessible", "accessibility", 0.20),
    ("most_accessible", "disruption", 0.10), ("access", "accessibility", 0.15), ("traffic", "disruption", 0.15), ("traffic", "accessibility", 0.05), ("far", "disruption", 0.10), ("amenities", "facility", 0.10),
]


def intent_weights(i: dict[str, Column]) -> dict[str, Column]:
    """Weights of an intent (its columns by name): the defaults moved by its signs, none below 0, summing to 1."""
    sign = {"cheapest": i["sort"] == "cheapest", "highest_rated": i["sort"] == "highest_rated", "most_accessible": i["sort"] == "most_accessible", "access": i["access"] == "high", "traffic": i["avoid_traffic"], "far": i["proximity"] == "far", "amenities": F.size(i["amenities"]) > 0}
    moved = {k: F.lit(w) for k, w in WEIGHTS.items()}
    for s, k, d in DELTAS:
        moved[k] = moved[k] + F.when(sign[s], d).otherwise(0.0)
    moved["spatial"] = F.when(sign["far"], F.greatest(F.lit(0.05), moved["spatial"] - 0.10)).otherwise(moved["spatial"])
    moved = {k: F.greatest(F.lit(0.0), c) for k, c in moved.items()}
    total = sum(moved.values(), F.lit(0.0))
    return {k: c / total for k, c in moved.items()}


def truthy(c: Column) -> Column:
    """``c`` where it is neither null, NaN nor zero, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (c != 0), c)


def with_ranges(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with ``low_`` and ``high_`` of each of ``values`` over its group, aggregated and joined back, so that no task holds a whole group.

    Rows of a group with a null key are left out. ``rows`` are read twice.
    """
    rows = rows.withColumns({f"__{k}": v for k, v in values.items()})
    ends = rows.groupBy(*group).agg(*[f(f"__{k}").alias(f"{n}_{k}") for k in values for n, f in (("low", F.min), ("high", F.max))])
    return join_small(rows, ends, group).drop(*[f"__{k}" for k in values])


def lower_is_better(value: Column, low: Column, high: Column) -> Column:
    """1 for the least value of the range, 0 for the greatest, 0.5 for unknown, 1 where all are equal."""
    return F.when(value.isNull(), 0.5).when(high <= low, 1.0).otherwise(1 - (value - low) / F.when(high > low, high - low))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def share_matched(asked: list[str], have: Column) -> Column:
    """Share of the asked terms that are part of any element of ``have``."""

    def hit(term: str) -> Column:
        return F.when(F.coalesce(F.exists(have, lambda x: F.contains(x, F.lit(term))), F.lit(False)), 1.0).otherwise(0.0)

    return sum((hit(a) for a in asked), F.lit(0.0)) / len(asked)


def facility(asked_amenities: list[str], asked_attractions: list[str], amenities: Column, attractions: Column, rating: Column, star: Column, most: Column) -> Column:
    """Amenities (asked ones, else how many compared with ``most``, those of the richest of the group), asked attractions, rating and star."""
    some = F.when(most > 0, F.size(amenities) / most).otherwise(0.5)
    amen = share_matched(asked_amenities, amenities) if asked_amenities else some
    attr = share_matched(asked_attractions, attractions) if asked_attractions else F.lit(0.0)
    return 0.40 * amen + 0.20 * attr + 0.20 * F.coalesce(rating, F.lit(0.0)) / 5 + 0.20 * F.coalesce(star, F.lit(0.0)) / 5


def disruption(heavy: Column, moderate: Column, events: Column, worst_delay: Column) -> Column:
    """1 less penalties for heavy and moderate signals (each once), events (two at most) and the worst delay."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return clamp01(1 - 0.40 * flag(heavy) - 0.20 * flag(moderate) - 0.30 * F.least(F.coalesce(events, F.lit(0)), F.lit(2)) - F.least(F.coalesce(worst_delay, F.lit(0.0)) / 20, F.lit(0.5)))


def event_affinity(km: Column, radius_km: float, preference: str, low: Column, high: Column) -> Column:
    """How well a distance to an event suits: near for ``seek`` (more inside the zone), far for ``avoid``; 0.5 for unknown."""
    far = F.when(high <= low, 0.5).otherwise((km - low) / F.when(high > low, high - low))
    zone = km <= radius_km
    score = F.least(F.lit(1.0), 1 - far + F.when(zone, 0.15).otherwise(0.0)) if preference == "seek" else far if preference == "avoid" else F.lit(0.5)
    return F.when(km.isNull(), 0.5).otherwise(score)


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to 1; the defaults where they sum to nothing."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(WEIGHTS)


def weighted_total(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return sum((parts[k] * F.lit(w) for k, w in normalised(weights).items()), F.lit(0.0))


def half_up(c: Column, digits: int) -> Column:
    """Rounds half up by plain arithmetic, so that every engine agrees."""
    n = float(10**digits)
    return F.floor(c * n + 0.5) / n


def top_k(scored: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each group, with ``rank`` from 1 as bigint. Top-k is the feature, not a cap on the input."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def relaxed(pool: DataFrame, keep: Column, group: list[str]) -> DataFrame:
    """Rows that pass ``keep``; where none of a group does, the whole group, with ``filters_relaxed`` true. Groups with a null key are left out."""
    rows = pool.withColumn("__ok", F.coalesce(keep, F.lit(False)))
    none = rows.groupBy(*group).agg((F.count(F.when(F.col("__ok"), 1)) == 0).alias("filters_relaxed"))
    return join_small(rows, none, group).where(F.col("__ok") | F.col("filters_relaxed")).drop("__ok")


def passes_softly(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Bounds that an unknown value passes."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (value.isNull() | (value >= least))
    if most is not None:
        ok = ok & (value.isNull() | (value <= most))
    return ok


def passes_strictly(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Bounds that an unknown value fails."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & F.coalesce(value >= least, F.lit(False))
    if most is not None:
        ok = ok & F.coalesce(value <= most, F.lit(False))
    return ok


def at_least(value: str, bound: str) -> Column:
    """A bound that is a column: null bounds nothing; an unknown value fails any other."""
    return F.col(bound).isNull() | F.coalesce(F.col(value) >= F.col(bound), F.lit(False))


def at_most(value: str, bound: str) -> Column:
    return F.col(bound).isNull() | F.coalesce(F.col(value) <= F.col(bound), F.lit(False))
