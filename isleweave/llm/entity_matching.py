"""Records of one entity in several sources that share no key.

All attributes become terms of one inverted index. The score of a record for a query is BM25 with every term at most
once in a record. Each record asks for its K best in every other source, exactly: it looks up its terms from the
rarest on, until the rest together cannot reach FLOOR of its own weight, and scores what it meets on all terms. A
record that no pair above that holds looks up more terms, down to LOWER. Nearest neighbours that choose each other are
rated by a logistic model of the gap to the runner-up and the shares of the attributes that agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_km, known
from ..plans.lineage import cut
from ..plans.skew import salted_join
from .addresses import town_name
from .near_duplicates import components

#: Least share of the weight of the lighter record that a pair must have, and of its own weight that a record asks for which no such pair holds.
FLOOR, LOWER = 0.42, 0.33
#: How many a record asks for in each other source; BM25's saturation and normalisation by length.
K, K1, B = 3, 1.2, 0.3
#: Weight of terms made of several attributes, which repeat what other terms say.
REPEATED = 0.3
#: A pair this close to a record's best in a source counts as its best too (a source may list one entity twice).
TIE = 0.6
#: Labelled pairs that the calibration may fit, and how few are too few.
LABELLED, FEWEST = 20_000, 60
#: Positions at most AT km apart agree wholly; those farther apart than FAR are different houses; labels need FAR or NEAR.
AT, NEAR, FAR = 0.08, 0.15, 0.5
#: Used where there are too few labels: a constant, then one weight per feature.
DEFAULT = [-9.5, -1.0, 3.0, 3.5, 1.5, 8.0]
FEATURES = ("rival", "share", "near_name", "place_share", "both")
#: Common words for kinds of house and their short forms; they identify nothing.
KINDS = "hotel htl hotels villa lodge residency resid inn resort rsrt hostel retreat bungalow guest house rest beach gh rh grand the and restaurant".split()
#: Term kinds in the packed terms.
NAME, PLACE = 0, 1


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def record_terms(rows: DataFrame, houses: DataFrame | None = None) -> DataFrame:
    """One row per id: ``id, source, lat, lng, site, brand, terms`` (array of struct ``kind, term``).

    ``rows`` has ``id, source, name, address, city_name, lat, lng, website``; of an id's rows the least name, address
    and so on count (repeated rows keep them equal). ``houses`` (``id, town, number, words``) may give addresses
    already parsed. Null attributes and unknown positions give no term. Ids and sources must not be null.
    """
    per = rows.where(F.col("id").isNotNull() & F.col("source").isNotNull()).select("id", "source", "name", "address", "city_name", "website", F.when(known(F.col("lat"), F.col("lng")), F.struct("lat", "lng")).alias("at"))
    one = per.groupBy("id").agg(*[F.min(c).alias(c) for c in ("source", "name", "address", "city_name", "website", "at")])
    if houses is not None:
        parsed = houses.groupBy("id").agg(F.min(F.struct("number", "words")).alias("house"))
        one = one.join(parsed, "id", "left")
    else:
        one = one.withColumn("house", F.lit(None).cast("struct<number:string,words:array<string>>"))
    town = town_name(F.col("city_name"))
    one = one.withColumn("town", town).withColumn("lat", F.col("at.lat")).withColumn("lng", F.col("at.lng"))
    kinds, town_words = F.array(*map(F.lit, KINDS)), F.coalesce(F.split("town", " "), F.array().cast("array<string>"))
    # one-letter leftovers of shortened kinds (R.H.) are no brand; town words are, unless nothing else is left
    full = F.filter(F.array_distinct(_words(F.col("name"))), lambda w: (F.length(w) > 1) & ~F.array_contains(kinds, w))
    less = F.array_except(full, town_words)
    one = one.withColumn("brand", F.array_sort(F.when(F.size(less) >= 1, less).otherwise(full)))
    term = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("term"))
    tag = lambda t, *c: F.concat_ws(":", F.lit(t), *c)
    none = F.array().cast("array<struct<kind:int,term:string>>")
    last = F.size("brand") - 1
    couples = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws("_", F.get("brand", i - 1), F.get("brand", i)))).otherwise(F.array().cast("array<string>"))  # neighbours in order, so that long names stay linear
    names = [
        F.transform("brand", lambda w: term(NAME, tag("n", w))),
        F.when(F.col("town").isNotNull(), F.transform(couples, lambda w: term(NAME, tag("nt", w, F.col("town"))))).otherwise(none),
        F.transform(F.array_intersect(F.array_distinct(_words(F.col("name"))), kinds), lambda w: term(NAME, tag("k", w))),
    ]
    # cells of about 200 m in four grids, each shifted by half a cell: places within 50 m share at least one
    cell = lambda a, b: F.concat_ws("_", F.floor(F.col("lat") * 500 + a).cast("string"), F.floor(F.col("lng") * 500 + b).cast("string"))
    cells = F.when(F.col("lat").isNotNull(), F.array(*[term(PLACE, tag(f"c{k}", cell(a, b))) for k, (a, b) in enumerate(((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)))])).otherwise(none)
    number, street = F.col("house.number"), F.col("house.words")
    places = [
        cells,
        F.when(F.col("town").isNotNull(), F.array(term(PLACE, tag("t", F.col("town"))))).otherwise(none),
        F.when(number.isNotNull(), F.array(term(PLACE, tag("h", number)), term(PLACE, tag("hs", number, F.array_join(street, " "), F.coalesce("town", F.lit("")))))).otherwise(none),
        F.when(street.isNotNull(), F.transform(street, lambda w: term(PLACE, tag("s", w)))).otherwise(none),
        # one word of the name with the street or the number finds what misspellings hide elsewhere
        F.when(street.isNotNull() & F.col("town").isNotNull(), F.flatten(F.transform("brand", lambda w: F.array(term(NAME, tag("xs", w, F.array_join(street, " "), F.col("town"))), term(NAME, tag("xh", w, number, F.col("town"))))))).otherwise(none),
    ]
    return one.select("id", "source", "lat", "lng", F.regexp_extract(F.lower("website"), r"://(?:www\.)?([^/:?#]+)", 1).alias("site"), "brand", F.array_distinct(F.concat(*names, *places)).alias("terms"))


def weighted(records: DataFrame) -> DataFrame:
    """``records`` with ``rec`` (a number), ``length`` (BM25's factor of the record's length), ``own`` and ``packed``: per term a 64-bit number of hash, weight and kind, most common first.

    A weight is the inverse document frequency of BM25 in half-percent steps; ``own`` is the sum of a record's weights.
    """
    total, mean = records.agg(F.count(F.lit(1))).scalar(), records.agg(F.avg(F.size("terms"))).scalar()
    # a term is a number from here on: hash, whether it repeats others, kind
    number = lambda t: F.shiftleft(F.xxhash64(t["kind"], t["term"]), 2).bitwiseOR(F.when(F.rlike(t["term"], F.lit("^(?:xs|xh):")), F.lit(2)).otherwise(0).cast("long")).bitwiseOR(t["kind"].cast("long"))
    each = records.select("id", F.explode(F.transform("terms", number)).alias("t"))
    counts = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.when(F.col("t").bitwiseAND(F.lit(2)) == 2, REPEATED).otherwise(1.0)
    w = F.least(F.greatest(F.round(weight * 200), F.lit(0)), F.lit(8191)).cast("long")
    packed = F.shiftleft(F.shiftright("t", 2), 14).bitwiseOR(F.shiftleft(w, 1)).bitwiseOR(F.col("t").bitwiseAND(F.lit(1)))
    scored = salted_join(each, counts.select("t", "df", packed.alias("p")), ["t"], counts, "df").select("id", "df", "p")
    packs = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("rarity"), "p"))).alias("t")).select("id", F.col("t.p").alias("packed"))  # a record's own terms, some thirty
    length = (K1 + 1) / (1 + K1 * (1 - B + B * F.size("packed") / mean))
    return records.drop("terms").join(packs, "id").withColumn("rec", F.monotonically_increasing_id()).withColumn("length", length).withColumn("own", _sum(F.col("packed")))


def _weight(p: Column) -> Column:
    return F.shiftright(p, 1).bitwiseAND(F.lit(8191)).cast("int")


def _sum(packed: Column, kind: int | None = None) -> Column:
    return F.aggregate(packed, F.lit(0), lambda acc, p: acc + (_weight(p) if kind is None else F.when(p.bitwiseAND(F.lit(1)) == kind, _weight(p)).otherwise(0)))


def _unneeded(floor: Column) -> Column:
    """How many of the most common terms a record may leave out: all together they stay below the floor."""
    step = lambda acc, p: F.struct((acc["sum"] + _weight(p)).alias("sum"), (acc["n"] + F.when(acc["sum"] + _weight(p) < floor, 1).otherwise(0)).alias("n"))
    return F.aggregate("packed", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def _met(records: DataFrame, index: DataFrame, counts: DataFrame, start: Column, stop: Column) -> DataFrame:
    """``a, b`` (a < b): records of different sources that share a term which one of them looks up, from place ``start`` to before ``stop`` of its terms."""
    probes = records.select(F.col("rec").alias("q"), F.col("source").alias("q_source"), F.explode(F.slice("packed", start + 1, stop - start)).alias("p"))
    pairs = salted_join(index, probes, ["p"], counts, "df").where(F.col("source") != F.col("q_source"))
    return cut(pairs.select(F.least("q", "rec").alias("a"), F.greatest("q", "rec").alias("b")).distinct())


def _scored(met: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with the weight that they share, that of names among it, and what each has; those below LOWER of both are dropped."""
    side = lambda x: records.select(F.col("rec").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("packed", "own", "source", "length")])
    both = salted_join(salted_join(met, side("a"), ["a"], met.groupBy("a").agg(F.count(F.lit(1)).alias("__n"))), side("b"), ["b"], met.groupBy("b").agg(F.count(F.lit(1)).alias("__n")))
    both = both.withColumn("shared", F.array_intersect("packed_a", "packed_b")).withColumn("score", _sum(F.col("shared"))).where(F.col("score") >= LOWER * F.least("own_a", "own_b"))
    names = [_sum(F.col(f"packed_{x}"), NAME).alias(f"own_name_{x}") for x in "ab"]
    return cut(both.select("a", "b", "source_a", "source_b", "score", _sum(F.col("shared"), NAME).alias("name"), "own_a", "own_b", *names, "length_a", "length_b"))


def retrieved(records: DataFrame, k: int = K) -> DataFrame:
    """``q, d, q_source, d_source, score, bm25, pair``: of each record q the ``k`` best d in every other source by BM25 (then by number), exactly.

    Asked for are pairs that share at least FLOOR of the weight of the lighter record, and for a record without any
    such pair those that share at least LOWER of its own. Terms are left out of the search only while together they
    cannot reach that, so nothing is missed. ``pair`` holds the columns of ``_scored``.
    """
    index = records.select("rec", "source", F.explode("packed").alias("p"))
    counts = index.groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    first, size = _unneeded(F.col("own") * FLOOR), F.size("packed")
    scored = _scored(_met(records, index, counts, first, size), records)
    sure = F.col("score") >= F.least("own_a", "own_b") * FLOOR
    alone = cut(records.join(scored.where(sure).select(F.explode(F.array("a", "b")).alias("rec")).distinct(), "rec", "left_anti"))
    more = _scored(_met(alone, index, counts, _unneeded(F.col("own") * LOWER), first), records)
    lonely = lambda x: alone.select(F.col("rec").alias(x), F.lit(LOWER).alias(f"least_{x}"))
    pairs = scored.unionByName(more).dropDuplicates(["a", "b"]).join(lonely("a"), "a", "left").join(lonely("b"), "b", "left")
    enough = lambda x: F.coalesce(F.col("score") >= F.col(f"own_{x}") * F.col(f"least_{x}"), F.lit(False))
    pairs = cut(pairs.where(sure | enough("a") | enough("b")).drop("least_a", "least_b"))
    pair = F.struct(*pairs.columns).alias("pair")
    way = lambda q, d: pairs.select(F.col(q).alias("q"), F.col(d).alias("d"), F.col(f"source_{q}").alias("q_source"), F.col(f"source_{d}").alias("d_source"), "score", (F.col("score") * F.col(f"length_{d}")).alias("bm25"), pair)
    ways = way("a", "b").unionByName(way("b", "a"))
    rank = F.row_number().over(Window.partitionBy("q", "d_source").orderBy(F.col("bm25").desc(), "d"))
    return ways.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def mutual(found: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs of ``retrieved`` that choose each other and are (nearly) best from both sides, with features and what speaks against them.

    Nearly best means within TIE of the record's highest score in the other's source. ``rival`` is the score gap, told
    as the share of the score that the best pair not tied with it reaches (0 where there is none). ``far`` and
    ``other_site`` are exact grounds for different entities.
    """
    best = F.max("bm25").over(Window.partitionBy("q", "d_source"))  # K rows at most
    found = found.withColumn("best", best).withColumn("next", F.max(F.when(F.col("bm25") < TIE * F.col("best"), F.col("bm25"))).over(Window.partitionBy("q", "d_source"))).where(F.col("bm25") >= TIE * F.col("best"))
    gap = F.coalesce("next", F.lit(0.0)) / F.col("bm25")
    chosen = found.groupBy(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("rival"), F.first("pair").alias("pair")).where(F.col("n") == 2)
    info = records.select("rec", "id", "lat", "lng", "site", "brand")
    side = lambda x: info.toDF(x, *[f"{c}_{x}" for c in info.columns[1:]])
    full = chosen.select("a", "b", "rival", *[F.col(f"pair.{c}").alias(c) for c in ("source_a", "source_b", "score", "name", "own_a", "own_b", "own_name_a", "own_name_b")])
    full = full.join(side("a"), "a").join(side("b"), "b")  # a record is in at most K pairs a source
    full = full.withColumn("place", F.col("score") - F.col("name"))
    for x in "ab":
        full = full.withColumn(f"own_place_{x}", F.col(f"own_{x}") - F.col(f"own_name_{x}"))
    km = distance_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    share = lambda x, own: F.coalesce(F.try_divide(F.col(x).cast("double"), F.least(f"{own}_a", f"{own}_b")), F.lit(0.0))
    letters = lambda x: F.array_sort(F.split(x, ""))
    close = lambda x, y: F.levenshtein(x, y) <= F.when((F.least(F.length(x), F.length(y)) >= 6) | (letters(x) == letters(y)), 2).otherwise(1)
    fewer, more = F.when(F.size("brand_a") <= F.size("brand_b"), F.col("brand_a")).otherwise(F.col("brand_b")), F.when(F.size("brand_a") <= F.size("brand_b"), F.col("brand_b")).otherwise(F.col("brand_a"))
    alike = F.size(F.filter(fewer, lambda x: F.exists(more, lambda y: close(x, y)))) / F.greatest(F.size(fewer), F.lit(1))
    place = F.when(km <= AT, F.lit(1.0)).otherwise(share("place", "own_place"))  # cells tell less than the distance
    sites = (F.col("site_a") != "") & (F.col("site_b") != "")
    return full.select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), "source_a", "source_b", km.alias("km"),
        "rival", share("score", "own").alias("share"), alike.alias("near_name"), place.alias("place_share"), F.least(alike, place).alias("both"),
        F.coalesce(km > FAR, F.lit(False)).alias("far"), F.coalesce(sites & (F.col("site_a") != F.col("site_b")), F.lit(False)).alias("other_site"), F.coalesce(sites & (F.col("site_a") == F.col("site_b")), F.lit(False)).alias("same_site"),
    )


def calibrated(pairs: DataFrame) -> list[float]:
    """Weights of the logistic model, fitted by Newton steps on at most LABELLED pairs that web sites and positions label.

    One site at near positions is the same entity; different sites, or far positions, are not. The sample is the first
    LABELLED by a hash. With too few labels of either kind the defaults stay.
    """
    label = F.when(F.col("other_site") | F.col("far"), 0).when(F.col("same_site") & (F.col("km") <= NEAR), 1)
    sample = pairs.select(*FEATURES, label.alias("y"), F.xxhash64("a", "b").alias("h")).where(F.col("y").isNotNull()).orderBy("h").limit(LABELLED).toPandas()
    y = sample["y"].to_numpy(dtype=float)
    if min(y.sum(), (1 - y).sum()) < FEWEST / 2:
        return DEFAULT
    x = np.column_stack([np.ones(len(y)), sample[list(FEATURES)].to_numpy(dtype=float)])
    start = np.array(DEFAULT)
    w, penalty = start.copy(), np.diag([0.1] * len(start))  # labels may be separable, so weights are drawn to the defaults
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (w - start))
        w = w + step * min(1.0, 1.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _sure(records: DataFrame, least: float) -> DataFrame:
    """``a, b, confidence``: mutual nearest records with at least ``least`` confidence and no exact ground against them."""
    pairs = cut(mutual(retrieved(records), records))
    weights = calibrated(pairs)
    score = F.lit(weights[0]) + sum((F.lit(w) * F.col(c) for w, c in zip(weights[1:], FEATURES)), F.lit(0.0))
    return cut(pairs.where(~F.col("far") & ~F.col("other_site")).withColumn("confidence", 1 / (1 + F.exp(-score))).where(F.col("confidence") >= least).select("a", "b", "confidence"))


def _entities(sure: DataFrame) -> DataFrame:
    """``rec, root``: records that sure pairs connect."""
    nodes = sure.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
    return cut(components(nodes, sure.select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))))


def entities(rows: DataFrame, houses: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``id, entity_id, matches, weakest``: of each matched record the least id of its entity, its number of direct matches and the entity's weakest confidence.

    The form of ``matches`` that grows with the records, however many describe one entity.
    """
    sure = _sure(cut(weighted(cut(record_terms(rows, houses)))), least)
    ends = sure.select(F.explode(F.array("a", "b")).alias("rec"), "confidence").groupBy("rec").agg(F.count(F.lit(1)).alias("matches"), F.min("confidence").alias("low"))
    placed = _entities(sure).join(ends, "rec")
    weakest = placed.groupBy("root").agg(F.min("low").alias("weakest"), F.count(F.lit(1)).alias("n"))
    return salted_join(placed, weakest, ["root"], weakest, "n").select(F.col("rec").alias("id"), F.col("root").alias("entity_id"), "matches", "weakest")


def matches(rows: DataFrame, houses: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``id_a, id_b, confidence, direct`` of records of different sources that describe one entity, smaller id first.

    Direct matches are mutual nearest with at least ``least`` confidence and no exact ground against them; records
    that these connect are one entity, so pairs between them come out too (``direct`` false, with the weakest
    confidence of the group). Nulls in any attribute are allowed; an empty input gives no match.
    """
    records = cut(weighted(cut(record_terms(rows, houses))))
    sure = _sure(records, least)
    roots = _entities(sure)
    weakest = sure.join(roots.withColumnRenamed("rec", "a"), "a").groupBy("root").agg(F.min("confidence").alias("weakest"))
    placed = roots.join(records.select(F.col("id").alias("rec"), "source", "lat", "lng", "site"), "rec")
    side = lambda x: placed.select("root", *[F.col(c).alias(f"{c}_{x}") for c in ("rec", "source", "lat", "lng", "site")])
    km = distance_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    fits = ~F.coalesce(km > FAR, F.lit(False)) & ((F.col("site_a") == "") | (F.col("site_b") == "") | F.coalesce(F.col("site_a") == F.col("site_b"), F.lit(True)))
    joined = salted_join(side("a"), side("b"), ["root"]).where((F.col("rec_a") < F.col("rec_b")) & (F.col("source_a") != F.col("source_b")) & fits).join(weakest, "root")
    direct = sure.toDF("rec_a", "rec_b", "confidence")
    out = joined.join(direct, ["rec_a", "rec_b"], "left")
    return out.select(F.col("rec_a").alias("id_a"), F.col("rec_b").alias("id_b"), F.coalesce("confidence", "weakest").alias("confidence"), F.col("confidence").isNotNull().alias("direct"))
