"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.skew import join_small
from .tokenise import token_count

SEED = 20_24


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of every document, counted once and kept (the mix reads it several times)."""
    return cut(documents.select("doc_id", "source", token_count(documents.sparkSession, F.col("text"), vocabulary).alias("tokens")))


def mixing_rates(sized: DataFrame, mix: DataFrame, total: float | None = None) -> DataFrame:
    """One row per source of either table: ``source, target_share, max_repeats, tokens, share, rate``.

    ``rate`` is how often each document is used on average. Sources with documents, tokens and a positive target take
    part; their targets are scaled to sum 1 (``share``). The mix aims at ``total`` tokens, by default those of all
    sources that take part. A source whose cap (``max_repeats``) forbids its share is used exactly ``max_repeats``
    times and falls short, which ``reached_shares`` reports; the others still get their share of the total, so a tiny
    source never shrinks them. Others have rate 0. A null cap means no cap. Sources must be unique in ``mix``; a null
    source takes no part.
    """
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    all_ = mix.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(sizes, "source", "full")
    part = (F.col("source").isNotNull()) & (F.col("tokens") > 0) & (F.col("target_share") > 0) & F.coalesce(F.col("max_repeats") > 0, F.lit(True))
    goal = F.when(part, F.col("target_share"))
    sums = all_.agg(F.sum(goal).alias("goals"), F.sum(F.when(part, F.col("tokens"))).alias("corpus"), F.lit(1).alias("one"))
    out = all_.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one")  # sums is one row
    share = goal / F.col("goals")
    aim = F.col("corpus") if total is None else F.lit(float(total))
    rate = F.coalesce(share * aim / F.when(F.col("tokens") > 0, F.col("tokens")), F.lit(0.0))
    rate = F.least(rate, F.coalesce(F.col("max_repeats").cast("double"), rate))
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(share, F.lit(0.0)).alias("share"), rate.alias("rate"))


def with_copies(sized: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` plus ``copies``: floor(rate), plus one where a hash of seed and id falls below the fraction.

    The draw depends on the id alone, so it is the same in every run and on every partitioning; a null id draws as
    its own hash.
    """
    rate = F.round(F.coalesce("rate", F.lit(0.0)), 9)  # 2.9999999999 is three
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return join_small(sized, rates.select("source", "rate"), ["source"], "left").withColumn("copies", copies.cast("int")).drop("rate")


def mixed(documents: DataFrame, mix: DataFrame, seed: int = SEED, total: float | None = None) -> DataFrame:
    """``doc_id, source, tokens, copy``: one row per use of a document, ``copy`` from 1."""
    sized = sized_documents(documents)
    used = with_copies(sized, mixing_rates(sized, mix, total), seed).where(F.col("copies") > 0)
    return used.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def reached_shares(documents: DataFrame, mix: DataFrame, seed: int = SEED, total: float | None = None) -> DataFrame:
    """One row per source: target, cap, corpus tokens, rate, tokens and documents in the mix, most copies, share reached, and how far it stays ``short`` of its share."""
    sized = sized_documents(documents)
    rates = cut(mixing_rates(sized, mix, total))
    used = with_copies(sized, rates, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("mixed_tokens")).scalar()
    both = rates.join(used, rates["source"].eqNullSafe(used["source"]), "left").drop(used["source"])
    reached = F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0))
    return both.select("source", "target_share", "max_repeats", "tokens", "share", "rate", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mixed_tokens", "mixed_documents", "most_copies")], reached.alias("share_reached"), F.greatest(F.lit(0.0), F.col("share") - reached).alias("short"))
