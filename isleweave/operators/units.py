"""Quantities in different units: a mined dictionary of unit spellings, and conversion to common units.

The dictionary is built from the distinct spellings only. Canonical names and spellings meet through an inverted
index on character bigrams; survivors are verified with a weighted edit distance. The dictionary is then joined to all
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.lineage import cut
from ..plans.shipping import ship
from ..plans.skew import join_small

#: Signs and short forms that no currency list spells out, and the code each stands for.
SIGNS = [("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("$", "USD"), ("us$", "USD"), ("a$", "AUD"), ("au$", "AUD"), ("rs", "LKR"), ("slrs", "LKR"), ("රු", "LKR"), ("indian rs", "INR")]
#: Greatest weighted edit distance, as a share of the longer spelling.
LIMIT = 0.3
#: The same for spellings of scales, which are short: "out of ten" may lose a letter, "/10" may not.
SCALE_LIMIT = 0.15
TOLERANCE = 0.03


def tidy_unit(c: Column) -> Column:
    """Lower case, single spaces, no full stop at the end; null for blank."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "))
    t = F.regexp_replace(t, r"\s*\.+$", "")
    return F.when(t != "", t)


def _weighted_distance(a: str, b: str) -> float:
    """Edit distance in which vowels, repeated letters, blanks and a final s cost less than other letters; swapped neighbours cost one."""

    def cost(s: str, i: int) -> float:
        if s[i] in "aeiou -.'" or (i and s[i] == s[i - 1]) or (s[i] == "s" and i == len(s) - 1):
            return 0.5
        return 1.0

    before, row = None, [0.0]
    for j in range(len(b)):
        row.append(row[-1] + cost(b, j))
    for i in range(len(a)):
        new = [row[0] + cost(a, i)]
        for j in range(len(b)):
            both = 0.0 if a[i] == b[j] else (0.6 if a[i] in "aeiou" and b[j] in "aeiou" else 1.0)
            best = min(row[j + 1] + cost(a, i), new[j] + cost(b, j), row[j] + both)
            if before is not None and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                best = min(best, before[j - 1] + 1.0)
            new.append(best)
        before, row = row, new
    return row[-1]


@F.pandas_udf(DoubleType())
def weighted_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.array([_weighted_distance(x, y) for x, y in zip(a, b)], dtype=float))


def unit_dictionary(spellings: DataFrame, canon: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``spelling, unit``: the unit that each distinct spelling stands for.

    ``spellings`` has one column ``spelling`` (tidied with ``tidy_unit``); ``canon`` has ``alias, unit``. An equal
    alias wins; else the alias with the least weighted edit distance, at most ``limit`` of the longer of the two. A
    spelling whose best aliases name different units equally well, and one near to nothing, is left out. Nulls are
    left out.
    """
    ship(spellings.sparkSession)
    words = spellings.where(F.col("spelling").isNotNull()).select("spelling").distinct()
    canon = canon.select(tidy_unit(F.col("alias")).alias("alias"), "unit").where(F.col("alias").isNotNull() & F.col("unit").isNotNull()).distinct()
    exact = words.join(canon, words["spelling"] == canon["alias"]).select("spelling", "unit", F.lit(0.0).alias("share"))

    def grams(c: str) -> Column:
        padded = F.concat(F.lit("^"), F.col(c), F.lit("$"))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))

    left = words.join(exact.select("spelling"), "spelling", "left_anti").select("spelling", F.size(grams("spelling")).alias("na"), F.explode(grams("spelling")).alias("gram"))
    right = canon.select("alias", "unit", F.size(grams("alias")).alias("nb"), F.explode(grams("alias")).alias("gram"))
    shared = left.join(right, "gram").groupBy("spelling", "alias", "unit", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    near = shared.where(F.col("n") * 3 >= F.least("na", "nb")).withColumn("share", weighted_distance("spelling", "alias") / F.greatest(F.length("spelling"), F.length("alias"))).where(F.col("share") <= limit)
    best = exact.unionByName(near.select("spelling", "unit", "share")).groupBy("spelling", "unit").agg(F.min("share").alias("share"))
    return (
        best.groupBy("spelling").agg(F.min("share").alias("low"), F.collect_list(F.struct("share", "unit")).alias("all"))  # at most one entry per unit
        .withColumn("all", F.filter("all", lambda x: x["share"] == F.col("low")))
        .where(F.size("all") == 1)
        .select("spelling", F.col("all")[0]["unit"].alias("unit"))
    )


def with_unit(rows: DataFrame, dictionary: DataFrame, spelling: str, out: str) -> DataFrame:
    """``rows`` plus the unit of their ``spelling``; null where the dictionary has none.

    A spelling may be shared by most rows, so the dictionary is broadcast after its size is checked; a larger one is
    joined with salted keys.
    """
    return join_small(rows, dictionary.select(F.col("spelling").alias(spelling), F.col("unit").alias(out)), [spelling], "left")


def currency_mention(text: Column) -> Column:
    """How a text names the currency of its nightly price, or null: after an amount, before it, or in "quoted in …"."""
    number = r"\d[\d,]*(?:\.\d+)?"
    per = r"\s*(?:a|per|each|/)\s*night|\s*nightly"
    after = F.regexp_extract(text, rf"{number}\s*([A-Z]{{3}}|[€£₹$])(?:{per})", 1)
    before = F.regexp_extract(text, rf"(?:^|[\s(])([A-Z]{{0,3}}[$€£₹]|[A-Z]{{3}}|[A-Za-z]{{0,2}}Rs\.?|රු\.?)\s?{number}(?:{per})", 1)
    named = F.regexp_extract(text, r"(?i)\b(?:rates?|prices?|tariffs?)\b(?:\s+(?:are|is))?(?:\s+(?:quoted|stated|given|shown))?\s+in\s+([\p{L}$€£₹ ]{2,30})", 1)
    pick = lambda c: F.when(c != "", c)
    return tidy_unit(F.coalesce(pick(named), pick(after), pick(before)))


#: How texts name the scale of a rating; other spellings are mapped to the nearest of these.
SCALES = [(f"{w}{x}", str(n)) for n, xs in ((5, ("5", "five")), (10, ("10", "ten")), (100, ("100", "hundred"))) for x in xs for w in ("/", "of ", "out of ")] + [
    (f"{x}-point", str(n)) for n, xs in ((5, ("5", "five")), (10, ("10", "ten")), (100, ("100", "hundred"))) for x in xs
] + [("%", "100"), ("percent", "100"), ("per cent", "100")]


def rating_mention(text: Column, rating: Column) -> Column:
    """How a text names the scale of its rating ("out of 10", "%", "ten-point"), or null. A number beside the scale must be the rating."""
    same = lambda c: F.abs(c.try_cast("double") - rating) <= 0.051
    low = F.lower(text)
    of = r"(\d+(?:\.\d+)?)\s*((?:/|out of|of)\s*[a-z0-9]+)(?!\.?\d)"
    share = r"(\d+(?:\.\d+)?)\s*(%|per ?cent)"
    point = F.regexp_extract(low, r"\b([a-z]+|\d+)[- ]point", 1)
    pick = lambda shape: F.when(same(F.regexp_extract(low, shape, 1)), F.regexp_replace(F.regexp_replace(F.regexp_extract(low, shape, 2), r"\s+", " "), "^/ ", "/"))
    return F.coalesce(pick(of), pick(share), F.when(point != "", F.concat(point, F.lit("-point"))))


def usual_scales(rows: DataFrame) -> DataFrame:
    """``source, usual``: the scale of a source's ratings that name none, by their median (over 10: 100; over 5: 10; else 5)."""
    middle = F.percentile_approx("rating", 0.5, 1000)
    return rows.where(F.col("named").isNull() & (F.col("rating") > 0)).groupBy("source").agg(F.when(middle > 10, 100).when(middle > 5, 10).otherwise(5).alias("usual"))


def hotel_units(hotels: DataFrame, fx: DataFrame) -> DataFrame:
    """One row per hotel row: ``id``, the unit of each known value, and the values in common units.

    Columns: ``rating_scale`` (5, 10, 100), ``rating_5``, ``currency`` (code of price_per_night), ``price_lkr``,
    ``lkr_unit`` (LKR, LKR_thousand or a code: what price_per_night_lkr really holds), ``lkr_value``, ``unplaced``. Null,
    NaN, zero and negative values are unknown and stay null. An amount whose currency nothing names is in LKR; one
    whose spelling the dictionary cannot place has no currency and no ``price_lkr``, and the spelling stands in
    ``unplaced``. Scales of ratings are mined from the descriptions and mapped by a dictionary like the currencies'.
    Extra columns are ignored. An empty input gives an empty result.

    price_per_night_lkr is judged against price_per_night where that is known, else against the range of the values
    that such a comparison confirmed.
    """
    value = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0), F.col(c)).alias(c)
    rows = hotels.select("id", "source", value("rating"), value("price_per_night"), value("price_per_night_lkr"), tidy_unit(F.col("price_currency")).alias("spelling"), F.coalesce("description", F.lit("")).alias("text"))
    rows = rows.withColumn("mention", currency_mention(F.col("text"))).withColumn("scale_spelling", rating_mention(F.col("text"), F.col("rating"))).drop("text")
    rows = cut(rows)  # read several times; the texts are searched once
    canon = fx.select(F.col("currency").alias("alias"), F.col("currency").alias("unit")).unionByName(fx.select(F.col("currency_name").alias("alias"), F.col("currency").alias("unit"))).unionByName(fx.sparkSession.createDataFrame(SIGNS, "alias string, unit string"))
    dictionary = cut(unit_dictionary(rows.select(F.explode(F.array("spelling", "mention")).alias("spelling")).distinct(), canon))
    scales = cut(unit_dictionary(rows.select(F.col("scale_spelling").alias("spelling")).distinct(), fx.sparkSession.createDataFrame(SCALES, "alias string, unit string"), SCALE_LIMIT))
    rows = with_unit(with_unit(with_unit(rows, dictionary, "spelling", "currency"), dictionary, "mention", "mentioned"), scales, "scale_spelling", "named")
    rows = rows.withColumn("named", F.col("named").cast("int")).withColumn("currency", F.coalesce("currency", F.when(F.col("spelling").isNull(), F.coalesce("mentioned", F.lit("LKR"))).otherwise(F.col("mentioned"))))
    rows = rows.withColumn("unplaced", F.when(F.col("currency").isNull(), F.col("spelling"))).drop("spelling", "mention", "mentioned", "scale_spelling")
    # fx has one row per currency (at most some 180 in the world), usual one per source kept small by the same check
    rates = fx.groupBy(F.col("currency").alias("currency")).agg(F.max("lkr_per_unit").alias("rate"))
    table = rates.agg(F.map_from_entries(F.collect_list(F.struct("currency", "rate"))).alias("rates"))
    rows = rows.join(F.broadcast(rates), "currency", "left").withColumn("rate", F.when(F.col("currency").isNotNull(), F.coalesce("rate", F.lit(1.0))))
    rows = join_small(rows, cut(usual_scales(rows)), ["source"], "left")

    scale = F.coalesce("named", "usual", F.lit(5))
    scale = F.when(F.col("rating") > F.greatest(scale, F.lit(10)), 100).when(F.col("rating") > scale, F.greatest(scale, F.lit(10))).otherwise(scale)
    rows = rows.withColumn("rating_scale", F.when(F.col("rating").isNotNull(), scale).cast("int")).withColumn("rating_5", F.col("rating") * 5 / F.col("rating_scale"))
    rows = rows.withColumn("price_lkr", F.col("price_per_night") * F.col("rate"))

    v = F.col("price_per_night_lkr")
    near = lambda a, b: F.abs(a / b - 1) <= TOLERANCE
    rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(table.withColumn("__one", F.lit(1))), "__one").drop("__one")
    other = F.try_element_at(F.map_keys(F.map_filter("rates", lambda k, r: near(v * r, F.col("price_lkr")))), F.lit(1))
    judged = F.when(near(v, F.col("price_lkr")), F.lit("LKR")).when(near(v, F.col("price_per_night")), F.col("currency")).when(near(v * 1000, F.col("price_lkr")), F.lit("LKR_thousand")).otherwise(other)
    rows = rows.withColumn("judged", F.when(v.isNotNull() & F.col("price_lkr").isNotNull(), judged))
    span = rows.where(F.col("judged") == "LKR").agg(F.percentile_approx("price_per_night_lkr", F.array(F.lit(0.01), F.lit(0.99)), 1000).alias("p"))
    span = span.select(F.coalesce(F.col("p")[0] / 3, F.lit(500.0)).alias("low"), F.coalesce(F.col("p")[1] * 3, F.lit(1e6)).alias("high"), F.lit(1).alias("__one"))
    rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(span), "__one")  # one row
    fits = lambda x: x.between(F.col("low"), F.col("high"))
    guessed = F.when(fits(v), F.lit("LKR")).when((F.col("currency") != "LKR") & fits(v * F.col("rate")), F.col("currency")).when(fits(v * 1000), F.lit("LKR_thousand")).otherwise(F.lit("LKR"))
    rows = rows.withColumn("lkr_unit", F.when(v.isNotNull(), F.coalesce("judged", guessed)))
    factor = F.when(F.col("lkr_unit") == "LKR_thousand", 1000.0).otherwise(F.coalesce(F.try_element_at("rates", F.col("lkr_unit")), F.lit(1.0)))
    return rows.select("id", "source", "rating", "rating_scale", "rating_5", "price_per_night", F.when(F.col("price_per_night").isNotNull(), F.col("currency")).alias("currency"), "price_lkr", "price_per_night_lkr", "lkr_unit", (v * factor).alias("lkr_value"), F.when(F.col("price_per_night").isNotNull(), F.col("unplaced")).alias("unplaced"))


def not_in_common_unit(units: DataFrame) -> DataFrame:
    """``id, field_name, unit`` of every known value of ``hotel_units`` that is not in the common unit; distinct."""
    cases = F.array(
        F.struct(F.lit("rating").alias("field_name"), F.when(F.col("rating_scale") != 5, F.concat(F.lit("of_"), F.col("rating_scale"))).alias("unit")),
        F.struct(F.lit("price_per_night").alias("field_name"), F.when(F.col("currency") != "LKR", F.col("currency")).alias("unit")),
        F.struct(F.lit("price_per_night_lkr").alias("field_name"), F.when(F.col("lkr_unit") != "LKR", F.col("lkr_unit")).alias("unit")),
    )
    return units.where(F.col("id").isNotNull()).select("id", F.inline(cases)).where(F.col("unit").isNotNull()).distinct()
