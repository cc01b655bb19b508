"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in SHARE; there are fewer than SHARE such keys, whatever the input,
#: so their table may be broadcast.
SHARE = 1000
#: Keys with fewer rows than this are never worth a salt.
LEAST = 20_000
#: Salts of the rows without a key in a left join.
NULL_SALTS = 256


def hot_keys(counts: DataFrame, keys: list[str], n: str, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``keys`` with ``__salts`` for the hot ones among ``counts`` (one row per key, ``n`` rows each)."""
    total = counts.agg(F.sum(n)).scalar()
    bar = F.greatest(total / F.lit(share), F.lit(least))
    return counts.where(F.col(n) > bar).select(*keys, F.ceil(F.col(n) / F.greatest(total / F.lit(share), F.lit(least))).cast("int").alias("__salts"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None, n: str = "__n", how: str = "inner", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Equi-join in which rows of ``left`` with a hot key are spread over several tasks.

    ``right`` rows of a hot key are repeated once per salt; nothing is dropped. ``counts`` may give the rows of
    ``left`` per key when the caller has them already. Null keys join nothing, as in SQL: a left join spreads their
    rows over NULL_SALTS salts, an inner join drops them early. ``how`` is ``inner`` or ``left``.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    lost = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    if how == "inner":
        left = left.where(~lost)
    hot = F.broadcast(hot_keys(counts, keys, n, share, least))
    salts = F.when(lost, NULL_SALTS).otherwise(F.coalesce("__salts", F.lit(1)))
    a = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    b = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


#: A table of more rows than this is never broadcast by name.
BROADCAST_ROWS = 100_000


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a table expected to be small, one key of which may be held by most ``rows``.

    ``small`` is broadcast only after its size is checked; beyond ``BROADCAST_ROWS`` the join shuffles with salted
    keys.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys, how)
    return salted_join(rows, small, keys, how=how)
