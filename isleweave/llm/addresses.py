"""Postal addresses that denote the same house, by rewrites mined from the addresses themselves.

An address is parsed into house number, street words and town. Addresses that agree in everything but one street
word support a rewrite between the two words. Rewrites that are supported beyond chance, and whose words look like
spellings or abbreviations of each other, are applied and the addresses are matched again, until none is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.skew import join_small, salted_join

#: Notes that name no house, and names of the country.
CARE_OF = r"\b(?:c/o|care of|attn:?)\b[^,]*(?:,|$)"
WITHIN = r"\b(?:level|floor|unit|suite|apt|apartment|flat|room|rm|ste)\b\.?\s*#?\s*[a-z0-9]{1,3}\b,?|\b\d+(?:st|nd|rd|th)\s+(?:floor|level)\b,?|\b(?:ground|first|second|third|fourth|fifth|top)\s+(?:floor|level)\b,?"
COUNTRY = r"\bsri\s+lanka\b|\blk\b"
HOUSE = r"(?:\bno\b\.?|#)?\s*\b(\d{1,4})(?:\s*/\s*(\d{1,4}|[a-z]\b)|\s*-?\s*([a-z])(?![a-z.]))?(?![\d])"
#: A rewrite needs this much log-likelihood ratio against chance (3.84: one in twenty).
SIGNIFICANT = 3.84
#: Shortenings (st, gdns) need so many supporting contexts; misspellings, whose form says more, need one.
SUPPORT = 2


def town_name(city: Column) -> Column:
    """A town as written freely, in one form: lower case, "mount" in full, without postcode, punctuation or a trailing "city"; null for blank."""
    t = F.regexp_replace(F.regexp_replace(F.lower(city), r"[^\p{L}]+", " "), r"\bmt\b", "mount")
    t = F.trim(F.regexp_replace(F.trim(t), r"\s+city$", ""))
    return F.when(t != "", t)


def parsed(rows: DataFrame, towns: DataFrame) -> DataFrame:
    """``id, town, number, words`` of every address with house number, street and town; distinct.

    ``rows`` has ``id, address, city_name``; ``towns`` (``name``, a small fixed table) gives the town of an address
    whose ``city_name`` is null. Addresses that are null, blank, or lack number, street or town are left out.
    """
    a = F.lower(F.regexp_replace("address", r"[\s ]+", " "))
    for shape in (CARE_OF, WITHIN, COUNTRY, r"\b\d{5}\b"):
        a = F.regexp_replace(a, shape, " ")
    known = towns.agg(F.collect_set(town_name(F.col("name"))).alias("__towns"), F.lit(1).alias("__one"))  # one row of a small fixed table
    out = rows.select("id", "address", "city_name").where(F.col("id").isNotNull() & F.col("address").isNotNull()).distinct()
    out = out.withColumn("__one", F.lit(1)).join(F.broadcast(known), "__one").drop("__one")
    out = out.withColumn("a", a).withColumn("town", F.coalesce(town_name(F.col("city_name")), F.try_element_at(F.filter("__towns", lambda t: F.contains(F.col("a"), t)), F.lit(1))))
    digits, part, letter = (F.regexp_extract("a", HOUSE, k) for k in (1, 2, 3))
    number = F.when(digits != "", F.concat(digits.try_cast("int").cast("string"), F.when(part != "", F.concat(F.lit("/"), F.coalesce(part.try_cast("int").cast("string"), part))).otherwise(F.upper(letter))))
    rest = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace("a", HOUSE, " , "), F.lit(" ")), r"\bno\b", " ")
    words = F.filter(F.split(F.regexp_replace(rest, r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 2)
    town_words = F.split("town", " ")
    of_town = lambda w: F.exists(town_words, lambda t: (w == t) | ((F.length(t) >= 5) & (F.levenshtein(w, t, 2) >= 0)) | ((F.length(t) == 4) & (F.levenshtein(w, t, 1) >= 0)))
    out = out.withColumn("number", number).withColumn("words", F.filter(words, lambda w: ~of_town(w)))
    return out.where(F.col("town").isNotNull() & F.col("number").isNotNull() & (F.size("words") > 0)).select("id", "town", "number", "words").distinct()


def _new_rewrites(forms: DataFrame) -> DataFrame:
    """``word, better`` mined from distinct ``town, number, words``; a word has at most one better form, a more frequent one."""
    each = forms.select("town", "number", "words", F.posexplode("words").alias("at", "word"))
    around = F.concat_ws(" ", F.filter("words", lambda w, i: i != F.col("at")))
    slots = each.select("town", "number", F.size("words").alias("n"), "at", around.alias("around"), "word").distinct()
    key = ["town", "number", "n", "at", "around"]
    uses = each.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    crowded = slots.groupBy(*key).agg(F.count(F.lit(1)).alias("variants")).where(F.col("variants") > 1)
    slots = slots.join(crowded, key)
    pairs = salted_join(slots.withColumnRenamed("word", "a"), slots.select(*key, F.col("word").alias("b")), key, crowded, "variants").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    shorter, letters = F.least(F.length("a"), F.length("b")), lambda c: F.array_sort(F.split(c, ""))
    # two misspellings of one word may lie three edits apart; a swap of two letters counts as two
    rare = (shorter >= 10) & (F.greatest("uses_a", "uses_b") <= 3)
    alike = (shorter >= 4) & (F.levenshtein("a", "b") <= F.when(rare, 3).when((shorter >= 7) | (letters("a") == letters("b")), 2).otherwise(1))
    short, long = F.when(F.length("a") <= F.length("b"), F.col("a")).otherwise(F.col("b")), F.when(F.length("a") <= F.length("b"), F.col("b")).otherwise(F.col("a"))
    shortened = (F.length(short) < F.length(long)) & (F.length(short) <= 4) & F.rlike(long, F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*")))
    pairs = pairs.join(uses.toDF("a", "uses_a"), "a").join(uses.toDF("b", "uses_b"), "b").where(alike | (shortened & (F.col("n_ab") >= SUPPORT)))
    seen = slots.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    total = crowded.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("__one"))
    scored = (
        pairs.join(seen.toDF("a", "seen_a"), "a").join(seen.toDF("b", "seen_b"), "b")
        .withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    )
    chance = F.col("seen_a") * F.col("seen_b") / F.col("total") / 2
    ratio = 2 * (F.col("n_ab") * F.log(F.col("n_ab") / chance) - (F.col("n_ab") - chance))
    scored = scored.where((F.col("n_ab") > chance) & (ratio >= SIGNIFICANT))
    up = (F.col("uses_b") > F.col("uses_a")) | ((F.col("uses_b") == F.col("uses_a")) & (F.length("b") > F.length("a"))) | ((F.col("uses_b") == F.col("uses_a")) & (F.length("b") == F.length("a")))
    directed = scored.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("word"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("better"), "n_ab", F.greatest("uses_a", "uses_b").alias("uses"))
    return directed.groupBy("word").agg(F.max(F.struct("n_ab", "uses", "better")).alias("m")).select("word", F.col("m.better").alias("better"))


def _rewritten(houses: DataFrame, rewrites: DataFrame) -> DataFrame:
    """``houses`` with every word replaced by its better form."""
    keys = ["id", "town", "number", "words"]
    each = houses.select(*keys, F.posexplode("words").alias("at", "word"))
    new = join_small(each, rewrites, ["word"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("better", "word").alias("w")))).alias("w"))
    return new.select("id", "town", "number", F.col("w.w").alias("words")).distinct()


def mined(houses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``houses`` in their last form, and all rewrites ``round, word, better``.

    Every round replaces words by more frequent ones, so it ends; each is written to the shared checkpoint folder. An
    empty input ends at once.
    """
    rewrites, k = None, 0
    houses = cut(houses)
    while True:
        k += 1
        new = cut(_new_rewrites(houses.select("town", "number", "words").distinct()).select(F.lit(k).alias("round"), "word", "better"))
        rewrites = new if rewrites is None else rewrites.unionByName(new)
        if new.isEmpty():
            return houses, rewrites
        houses = cut(_rewritten(houses, new.select("word", "better")))


def same_house(houses: DataFrame) -> DataFrame:
    """``id_a, id_b`` of different ids with the same town, number and street, smaller id first; distinct."""
    keyed = houses.select("id", "town", "number", F.concat_ws(" ", "words").alias("street")).distinct()
    pairs = salted_join(keyed.withColumnRenamed("id", "id_a"), keyed.withColumnRenamed("id", "id_b"), ["town", "number", "street"])
    return pairs.where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()


def house_classes(houses: DataFrame) -> DataFrame:
    """``id, house_id, records``: of each record and each of its houses, the least id at that house and how many ids are there.

    The links of ``same_house`` in a form that grows with the records, however many share a house.
    """
    key = ["town", "number", "street"]
    keyed = houses.select("id", "town", "number", F.concat_ws(" ", "words").alias("street")).distinct()
    classes = keyed.groupBy(*key).agg(F.min("id").alias("house_id"), F.count(F.lit(1)).alias("records"))
    return salted_join(keyed, classes, key, classes, "records").select("id", "house_id", "records").distinct()
