"""Ranked retrieval over all cities at once, its baselines, their fusion and evaluation, and annotator agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.geo import distance_km, known
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..plans.lineage import cut
from ..plans.skew import join_small
from ..sources.landed import resolved_gold
from ..sources.tables import table
from . import base
from .base import AFFECTED, AMENITY, ATTRACTION, EVENTS, HOTELS, KNOWN, SIGNALS, km_sql, rounded, values

K = 10
ASKED, WANTED = ["pool", "wifi"], ["Beach", "Market"]
#: An active event for the personalised rankings: position and impact radius.
EVENT = {"name": "Harbour Night", "lat": 6.1, "lng": 79.9, "radius_km": 5.0, "severity": "high"}
SEEK = {"spatial": 0.30, "accessibility": 0.15, "facility": 0.30, "economic": 0.10, "disruption": 0.15}
QUERY_TEXTS = [("v1", "quiet beach with pool and garden"), ("v2", "breakfast on the terrace"), ("v3", "family friendly pavilion with gym"), ("v4", "harbour lighthouse concert")]
#: Words that say nothing in descriptions.
STOPS = "the a an and or of in on at with by for from to is are was it its be as this that".split()


def pool(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Candidates with the raw values of all sub-scores: one row per hotel that has a city."""
    h, s, e = (f(spark, folder) for f in (base.hotels, base.signals, base.events))
    c = base.positioned(table(spark, folder, "city")).select(F.col("name").alias("city"), F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    sig = base.signal_values(h, s, whole).drop("severities")
    aff = base.event_counts(h, e, *((base.news(spark, folder), table(spark, folder, "city")) if whole else ()))
    rating = sc.truthy(F.col("rating"))
    rating = F.when(rating > 10, rating / 20).when(rating > 5, rating / 2).otherwise(rating)
    km = sc.half_up(F.when(F.col("known"), distance_km(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"))), 6)
    h = h.where(F.col("city").isNotNull()).withColumn("known", known(F.col("lat"), F.col("lng")))
    return h.join(c, "city", "left").join(sig, "id", "left").join(aff, "id", "left").select(
        "id", "city", "lat", "lng", "known", "description", km.alias("km"), sc.half_up(F.col("delay"), 6).alias("delay"), "heavy", "moderate", "worst", F.coalesce("events", F.lit(0)).alias("events"),
        rating.alias("rating5"), sc.truthy(F.col("star_rating")).alias("star"), sc.truthy(F.col("price_per_night_lkr")).alias("price"), F.coalesce(t.amenities(F.col("description")), F.array().cast("array<string>")).alias("amen"),
        F.coalesce(t.attraction_kinds(F.col("description")), F.array().cast("array<string>")).alias("attr"),
    )


def _with_ranges(candidates: DataFrame, *more: str) -> DataFrame:
    """Candidates with the ends of what sub-scores compare within a city."""
    return sc.with_ranges(candidates, ["city"], {c: F.col(c) for c in ("km", "delay", "price", *more)} | {"amen": F.size("amen")})


def parts(asked: list[str] = ASKED, wanted: list[str] = WANTED) -> dict[str, Column]:
    """Sub-scores of candidates from ``_with_ranges``."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    low = lambda c: sc.lower_is_better(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}"))
    return {
        "spatial": low("km"), "accessibility": low("delay"), "facility": sc.facility(asked, wanted, F.col("amen"), F.col("attr"), F.col("rating5"), F.col("star"), F.col("high_amen")),
        "economic": low("price"), "disruption": sc.disruption(flag("heavy"), flag("moderate"), F.col("events"), F.col("worst")),
    }


def _ranked(scored: DataFrame, k: int = K) -> DataFrame:
    return sc.top_k(scored, ["city"], [F.col("score").desc(), F.col("id").asc()], k)


def weighted(candidates: DataFrame) -> DataFrame:
    p = parts()
    return _with_ranges(candidates).select("id", "city", *[c.alias(k) for k, c in p.items()]).withColumn("score", sc.half_up(sc.weighted_total({k: F.col(k) for k in p}, sc.WEIGHTS), 4))


def weighted_retrieve(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """The ten best hotels of every city by the weighted score, with the sub-scores."""
    return _ranked(weighted(cut(pool(spark, folder, whole)))).select("city", "rank", "id", "score", *[sc.half_up(F.col(k), 3).alias(k) for k in sc.WEIGHTS])


def weighted_retrieve_relaxed(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """The same after filters that unknown values pass; a city where nothing passes keeps all its hotels."""
    keep = sc.passes_softly(F.col("rating5"), least=4.8) & sc.passes_softly(F.col("star"), least=5.0) & sc.passes_softly(F.col("km"), most=12.0)
    left = cut(sc.relaxed(cut(pool(spark, folder, whole)), keep, ["city"]))
    flags = left.select("id", "filters_relaxed")
    return _ranked(weighted(left)).join(flags, "id").select("city", "rank", "id", "score", "filters_relaxed")


def _personal(spark: SparkSession, folder: str, preference: str, whole: bool = True) -> DataFrame:
    km = sc.half_up(F.when(F.col("known"), distance_km(F.lit(EVENT["lat"]), F.lit(EVENT["lng"]), F.col("lat"), F.col("lng"))), 6)
    p = parts()
    rows = _with_ranges(cut(pool(spark, folder, whole).withColumn("event_km", km)), "event_km")
    rows = rows.select("id", "city", "event_km", *[x.alias(k) for k, x in p.items()], sc.event_affinity(F.col("event_km"), EVENT["radius_km"], preference, F.col("low_event_km"), F.col("high_event_km")).alias("event"))
    dis = F.when(F.coalesce(F.col("event_km") <= EVENT["radius_km"], F.lit(False)), F.greatest(F.lit(0.0), F.col("disruption") - rt.EVENT_PENALTY[EVENT["severity"]])).otherwise(F.col("disruption")) if preference == "avoid" else F.col("disruption")
    every = {**{k: F.col(k) for k in p}, "disruption": dis, "event": F.col("event")}
    return _ranked(rows.withColumn("score", sc.half_up(sc.weighted_total(every, SEEK | {"event": 0.30}), 4))).select("city", "rank", "id", "score", sc.half_up(F.col("event"), 3).alias("event"))


def personalized_event_seek(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """The ten best hotels of every city for those who seek an event."""
    return _personal(spark, folder, "seek", whole)


def personalized_event_avoid(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """The ten best hotels of every city for those who avoid an event."""
    return _personal(spark, folder, "avoid", whole)


def intent_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of every question: defaults moved by its intent, none below 0, summing to 1."""
    q = table(spark, folder, "documents").where((F.col("doc_type") == "qa") & F.col("text").isNotNull()).select("doc_id", t.intent(F.col("text"), F.lit(None).cast("string")).alias("i"))
    moved = sc.intent_weights({c: F.col(f"i.{c}") for c in rt.ASKED})
    return q.select("doc_id", *[sc.half_up(c, 4).alias(k) for k, c in moved.items()])


def _question_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where((F.col("doc_type") == "qa") & F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def _asks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Asks of all question documents, each about the city beside it, and which question asks what."""
    d = _question_texts(spark, folder)
    return rt.asks_of(d.select(F.col("doc_id").alias("question_id"), t.intent(F.col("text"), t.island_city(F.col("city_name"))).alias("i")))


SHOWN = ("ask_id", "city", "rank", "id", "score", *sc.WEIGHTS, "filters_relaxed")


def retrieve_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best hotels for every ask of the questions, with sub-scores and reasons."""
    best = rt.retrieve(cut(pool(spark, folder)), rt.with_weights(cut(_asks(spark, folder)[0])), K)
    return best.select(*SHOWN, F.array_join("reasons", "; ").alias("reasons"))


def retrieve_personas(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every persona while the event is on."""
    c, asks = cut(pool(spark, folder)), cut(_asks(spark, folder)[0])
    rows = [rt.retrieve(c, rt.with_weights(asks, p, EVENT), K).select(F.lit(p).alias("persona"), *SHOWN, F.array_join("reasons", "; ").alias("reasons")) for p in sc.PERSONAS]
    return reduce(DataFrame.unionByName, rows)


def question_asks(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, ask_id``: which question asks what."""
    return _asks(spark, folder)[1]


def question_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of every ask as one text for an answer."""
    h = base.hotels(spark, folder)
    return rt.contexts(rt.retrieve(cut(pool(spark, folder)), rt.with_weights(cut(_asks(spark, folder)[0])), K), h)


def _question_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Per ask the rankings of ``graph``, ``filter`` and ``vector``, the relevant ones among their items, how many are relevant by its bounds at all, and whether it asks for one thing only."""
    c, (asks, members) = cut(pool(spark, folder)), map(cut, _asks(spark, folder))
    ranked = rt.retrieve(c, rt.with_weights(asks), K).select(F.lit("graph").alias("system"), F.col("ask_id").alias("query_id"), "rank", F.col("id").alias("item"))
    strict = sc.at_least("rating5", "min_rating") & sc.at_least("star", "min_star") & sc.at_least("price", "min_price") & sc.at_most("price", "max_price")
    kept, sizes = rt.strictly_filtered(c, asks, K)
    kept = kept.select(F.lit("filter").alias("system"), F.col("ask_id").alias("query_id"), "rank", F.col("id").alias("item"))
    first = members.groupBy("ask_id").agg(F.min("question_id").alias("doc_id"))
    first = cut(first.select(F.concat(F.lit("question:"), "doc_id").alias("query_id"), "ask_id"))
    vector = _alike(spark, folder, _question_texts(spark, folder), first).join(first, "query_id").select(F.lit("vector").alias("system"), F.col("ask_id").alias("query_id"), "rank", F.col("id").alias("item"))
    every = F.size("amenities") == F.size(F.filter("amenities", lambda a: F.exists("amen", lambda x: F.contains(x, a))))
    dims = F.when(F.col("min_price").isNotNull() | F.col("max_price").isNotNull(), 1).otherwise(0) + F.when(F.col("min_rating").isNotNull() | F.col("min_star").isNotNull(), 1).otherwise(0)
    single = asks.select(F.col("ask_id").alias("query_id"), ((dims <= 1) & (F.col("access") != "high") & ~F.col("avoid_traffic") & (F.size("attractions") == 0)).alias("single"))
    lists = cut(ranked.unionByName(kept).unionByName(vector))
    shown = lists.select(F.col("query_id").alias("ask_id"), F.col("item").alias("id")).distinct().join(c.dropDuplicates(["id"]), "id")
    relevant = join_small(shown, asks, ["ask_id", "city"]).where(strict & every).select(F.col("ask_id").alias("query_id"), F.col("id").alias("item"), F.lit(1).alias("rel"))
    return lists, cut(relevant), sizes.select(F.col("ask_id").alias("query_id"), F.col("n_all").alias("n_gold")), single


#: The weights by which lists are fused; the adaptive ones depend on whether an ask is for one thing only.
FUSED = {"graph+vector": {"graph": 1.0, "vector": 1.0}, "graph+filter": {"graph": 1.0, "filter": 1.0}}
ADAPTIVE = {True: {"filter": 2.0, "graph": 1.0}, False: {"graph": 2.0, "filter": 1.0}}


def question_systems(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall, nDCG and MRR of each of the six systems over all asks."""
    lists, relevant, sizes, single = _question_lists(spark, folder)
    place = lambda s: F.when(s == "graph", 0).when(s == "filter", 1).otherwise(2)
    weight = lambda of: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("system")), F.lit(0.0))
    rows = lists.join(single, "query_id")
    fused = [(name, weight(of)) for name, of in FUSED.items()] + [("adaptive", F.when(F.col("single"), weight(ADAPTIVE[True])).otherwise(weight(ADAPTIVE[False])))]
    own = F.explode(F.array(*[F.struct(F.lit(name).alias("system"), w.alias("weight")) for name, w in fused]))
    part = rows.withColumn("own", own).where(F.col("own.weight") > 0).select(F.struct("own.system", "query_id").alias("query_id"), place(F.col("system")).alias("list"), "own.weight", "rank", "item")
    mixed = ev.fused(part).select("query_id.system", "query_id.query_id", F.col("position").cast("bigint").alias("rank"), "item")
    judged = lists.unionByName(mixed).join(relevant, ["query_id", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    metrics = ev.judged_metrics(judged, sizes, K)
    return metrics.groupBy("system").agg(F.count(F.lit(1)).alias("asks"), *[sc.half_up(F.avg(c), 6).alias(c) for c in NAMES])


def filtered(candidates: DataFrame) -> DataFrame:
    """Filter-and-sort baseline: known rating of 3.5 or more, best rated first, then cheapest."""
    keep = candidates.where(sc.passes_strictly(F.col("rating5"), least=3.5))
    order = [F.col("rating5").desc(), F.coalesce("price", F.lit(float("inf"))).asc(), F.col("id").asc()]
    return sc.top_k(keep, ["city"], order, K)


def filter_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return filtered(pool(spark, folder, False)).select("city", "rank", "id", "rating5")


def gold(candidates: DataFrame) -> DataFrame:
    """Relevant hotels per city: star of 3 or more, rating of 3.5 or more, and every asked amenity."""
    have = F.exists("amen", lambda a: F.contains(a, F.lit("pool")))
    return candidates.where(sc.passes_strictly(F.col("star"), least=3.0) & sc.passes_strictly(F.col("rating5"), least=3.5) & F.coalesce(have, F.lit(False))).select(F.col("city").alias("query_id"), F.col("id").alias("item"))


def gold_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return gold(pool(spark, folder, False))


def tfidf_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The ten hotels most like each of four texts, by the cosine of TF-IDF vectors fitted on all descriptions and the texts."""
    h = base.hotels(spark, folder).select("id", F.coalesce("description", F.lit("")).alias("text"))
    q = spark.createDataFrame(QUERY_TEXTS, "id string, text string")
    w = ev.tf_idf(h.unionByName(q), STOPS)
    ids = [k for k, _ in QUERY_TEXTS]
    sims = ev.cosine_scores(w.where(F.col("id").isin(ids)).withColumnRenamed("id", "query_id"), w.where(~F.col("id").isin(ids))).withColumn("similarity", sc.half_up(F.col("similarity"), 8))
    return sc.top_k(sims, ["query_id"], [F.col("similarity").desc(), F.col("id").desc()], K)


def _alike(spark: SparkSession, folder: str, questions: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The ten hotels most like each question, or each of ``only`` (``query_id``), by vectors fitted on all hotels and all ``questions``."""
    words = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    h = base.hotels(spark, folder).select("id", F.concat_ws(" ", "name", "description", words(t.amenities(F.col("description"))), words(t.attraction_kinds(F.col("description")))).alias("text"))
    q = questions.groupBy("doc_id").agg(F.min("text").alias("text")).select(F.concat(F.lit("question:"), F.col("doc_id")).alias("id"), "text")
    w = ev.tf_idf_vectors(h.unionByName(q), STOPS)
    asked = F.col("id").startswith("question:")
    compared = w.where(asked) if only is None else w.where(asked).join(only.select(F.col("query_id").alias("id")), "id", "left_semi")
    return ev.best_alike(compared, w.where(~asked), K)


def tfidf_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten hotels most like each question document whose id is divisible by 20, over name, description, amenities and attractions."""
    return _alike(spark, folder, _question_texts(spark, folder).where(F.col("doc_id") % 20 == 0))


def _lists(spark: SparkSession, folder: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rankings of the systems ``graph`` and ``filter`` per city, and gold."""
    c = cut(pool(spark, folder, whole))  # read several times
    graph = _ranked(weighted(c)).select(F.lit("graph").alias("system"), F.col("city").alias("query_id"), "rank", F.col("id").alias("item"))
    flt = filtered(c).select(F.lit("filter").alias("system"), F.col("city").alias("query_id"), "rank", F.col("id").alias("item"))
    return graph.unionByName(flt), gold(c)


def rrf_fusion(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    r, _ = _lists(spark, folder, whole)
    lists = r.select("query_id", F.when(F.col("system") == "graph", 0).otherwise(1).alias("list"), F.lit(1.0).alias("weight"), "rank", "item")
    return ev.fused(lists).select("query_id", "item", sc.half_up(F.col("score"), 8).alias("score"), "position")


def adaptive_fusion(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Cities of few candidates trust the filter twice, others the graph twice."""
    r, _ = _lists(spark, folder, whole)
    small = pool(spark, folder, whole).groupBy(F.col("city").alias("query_id")).agg((F.count(F.lit(1)) < 20).alias("small"))
    lists = r.join(small, "query_id").select("query_id", F.when((F.col("system") == "graph") == F.col("small"), 1).otherwise(0).alias("list"), F.when((F.col("system") == "graph") == F.col("small"), 1.0).otherwise(2.0).alias("weight"), "rank", "item")
    return ev.fused(lists).select("query_id", "item", sc.half_up(F.col("score"), 8).alias("score"), "position")


def _metrics(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    r, relevant = _lists(spark, folder, whole)
    return ev.ranking_metrics(r, relevant, K)


NAMES = ("precision", "recall", "ndcg", "mrr")


def ranking_metrics(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    return _metrics(spark, folder, whole).select("system", "query_id", *[sc.half_up(F.col(c), 6).alias(c) for c in NAMES])


def metrics_by_system(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    return _metrics(spark, folder, whole).groupBy("system").agg(*[sc.half_up(F.avg(c), 6).alias(c) for c in NAMES])


def metrics_by_category(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    c = table(spark, folder, "city").select(F.col("name").alias("query_id"), F.col("province").alias("category"))
    return _metrics(spark, folder, whole).join(c, "query_id").groupBy("category", "system").agg(*[sc.half_up(F.avg(x), 6).alias(x) for x in NAMES])


def best_system(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Per city the system with the best nDCG; the first system wins ties."""
    m = _metrics(spark, folder, whole).withColumn("ndcg", sc.half_up(F.col("ndcg"), 6))
    key = F.struct("ndcg", F.when(F.col("system") == "graph", 0).otherwise(-1))
    return m.groupBy("query_id").agg(F.max_by("system", key).alias("best"), F.max("ndcg").alias("ndcg"))


def hybrid_delta(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Mean nDCG per system and its difference from the graph's in percent."""
    m = _metrics(spark, folder, whole).groupBy("system").agg(F.avg("ndcg").alias("ndcg"))
    graph = m.where(F.col("system") == "graph").select("ndcg").scalar()
    return m.select("system", sc.half_up(F.col("ndcg"), 6).alias("ndcg"), sc.half_up((F.col("ndcg") - graph) / graph * 100, 2).alias("delta"))


def inspect_query(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Rankings beside the candidates' values and whether each is relevant."""
    r, relevant = _lists(spark, folder, whole)
    c = pool(spark, folder, whole).select(F.col("id").alias("item"), "km", "rating5", "star")
    hit = relevant.distinct().withColumn("relevant", F.lit(True))
    return r.join(c, "item", "left").join(hit, ["query_id", "item"], "left").select("system", "query_id", "rank", "item", "km", "rating5", "star", F.coalesce("relevant", F.lit(False)).alias("relevant"))


def annotation_pool(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Top five of both systems and two others per city, drawn by a seeded hash, shuffled for an annotator by another."""
    r, _ = _lists(spark, folder, whole)
    c = pool(spark, folder, whole).select(F.col("city").alias("query_id"), F.col("id").alias("item"))
    p = ev.pooled(r, c, 5, 2, 7)
    shuffle = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", F.lit("8"), "query_id", "item")), "item")
    return p.withColumn("place", F.row_number().over(shuffle).cast("bigint"))


def _judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Three made-up annotators on every document, with gaps."""
    d = table(spark, folder, "documents").select("doc_id", "doc_type").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    score = F.when(F.pmod(F.col("doc_id") * 31 + F.col("k") * 7, F.lit(11)) == 0, None).otherwise(F.pmod(F.floor(F.col("doc_id") / 3) + F.when(F.pmod(F.col("doc_id") + F.col("k"), F.lit(5)) == 0, 1).otherwise(0), F.lit(3)).cast("double"))
    return d.select("doc_id", "doc_type", "k", score.alias("value"))


def krippendorff_alpha(spark: SparkSession, folder: str) -> DataFrame:
    return ev.krippendorff_alpha(_judgments(spark, folder).withColumnRenamed("doc_id", "unit")).select(sc.half_up(F.col("alpha"), 6).alias("alpha"))


def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    return ev.majority(_judgments(spark, folder), ["doc_id"])


def judgment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _judgments(spark, folder).groupBy("doc_type", "k").agg(F.count("value").alias("n"), sc.half_up(F.avg("value"), 6).alias("mean"))


def reasons(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Why each of a city's ten best hotels is where it is, in words, as one line per hotel."""
    w = _ranked(weighted(cut(pool(spark, folder, whole))))
    why = F.array_compact(F.array(F.when(F.col("spatial") > 0.7, "close to the centre"), F.when(F.col("accessibility") > 0.7, "quick to reach"), F.when(F.col("facility") > 0.5, "well equipped"), F.when(F.col("disruption") < 0.5, "disturbed"), F.when(F.col("disruption") > 0.85, "undisturbed")))
    return w.select("city", "rank", "id", F.array_join(why, "; ").alias("reasons"))


def context_text(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """The ranking of every city as one text, a line per hotel with its score in ten-thousandths."""
    w = _ranked(weighted(cut(pool(spark, folder, whole))))
    line = F.concat_ws(" ", F.concat(F.col("rank").cast("string"), F.lit(".")), "id", F.lit("score"), F.round(F.col("score") * 10000).cast("bigint").cast("string"))
    lines = w.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))  # at most K per city
    return lines.select("city", F.array_join("l.line", "\n").alias("context"))


def persona_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the personas while an event is active."""
    rows = [(p, *[sc.persona_weights(p, True)[k] for k in (*sc.WEIGHTS, "event")]) for p in sc.PERSONAS]
    return spark.createDataFrame(rows, "persona string, " + ", ".join(f"{k} double" for k in (*sc.WEIGHTS, "event"))).select("persona", *[sc.half_up(F.col(k), 6).alias(k) for k in (*sc.WEIGHTS, "event")])


def gold_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Human labels (here: hotels of star 5 in three provinces' cities) supersede the rules of their queries."""
    c = pool(spark, folder, False)
    own = table(spark, folder, "city").where(F.col("province").isin("West Shore", "Dry Plain")).select(F.col("name").alias("query_id"))
    human = c.where(F.col("star") == 5).select(F.col("city").alias("query_id"), F.col("id").alias("item")).join(own, "query_id", "left_semi")
    return resolved_gold(human, gold(c))


QUERIES = {
    f.__name__: f
    for f in (
        weighted_retrieve, weighted_retrieve_relaxed, personalized_event_seek, personalized_event_avoid, intent_weights, retrieve_questions, retrieve_personas, question_asks, question_contexts, question_systems, filter_baseline, gold_predicate, tfidf_baseline, tfidf_questions, rrf_fusion, adaptive_fusion, ranking_metrics,
        metrics_by_system, metrics_by_category, best_system, hybrid_delta, inspect_query, annotation_pool, krippendorff_alpha, majority_vote, judgment_counts, reasons, context_text, persona_weights, gold_resolution,
    )
}
#: Queries on links by distance and by keyword; their SQL is made of that of the nearer links.
WHOLE = (
    weighted_retrieve, weighted_retrieve_relaxed, personalized_event_seek, personalized_event_avoid, rrf_fusion, adaptive_fusion, ranking_metrics, metrics_by_system, metrics_by_category, best_system, hybrid_delta, inspect_query, annotation_pool, reasons, context_text,
)


def _low(c: str) -> str:
    w = "OVER (PARTITION BY city)"
    return f"CASE WHEN {c} IS NULL THEN 0.5e0 WHEN max({c}) {w} <= min({c}) {w} THEN 1e0 ELSE 1 - ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


def _has(col: str, word: str) -> str:
    return f"CASE WHEN len(list_filter({col}, lambda x: contains(x, '{word}'))) > 0 THEN 1e0 ELSE 0e0 END"


_POOL = f"""{HOTELS}, {SIGNALS}, {EVENTS}, {AMENITY}, {ATTRACTION}, {AFFECTED},
    g AS (SELECT hotel_id, avg(eta_change_min) AS delay, bool_or(severity = 'heavy') AS heavy, bool_or(severity = 'moderate') AS moderate, max(eta_change_min) AS worst FROM s WHERE hotel_id IS NOT NULL GROUP BY 1),
    x AS (SELECT src, count(DISTINCT dst) AS events FROM ab GROUP BY 1), ma AS (SELECT src, list(dst) AS v FROM am GROUP BY 1), mt AS (SELECT src, list(dst) AS v FROM att GROUP BY 1),
    c AS (SELECT h.id, h.city, h.lat, h.lng, {KNOWN.format('h')} AS known, h.description, CASE WHEN {KNOWN.format('h')} THEN {rounded(km_sql('h', 'k'), 6)} END AS km, {rounded('g.delay', 6)} AS delay,
        coalesce(g.heavy, false) AS heavy, coalesce(g.moderate, false) AS moderate, g.worst, coalesce(x.events, 0) AS events,
        CASE WHEN h.rating = 0 THEN NULL WHEN h.rating > 10 THEN h.rating / 20 WHEN h.rating > 5 THEN h.rating / 2 ELSE h.rating END AS rating5, nullif(h.star_rating, 0) AS star, nullif(h.price_per_night_lkr, 0) AS price,
        coalesce(ma.v, []) AS amen, coalesce(mt.v, []) AS attr
        FROM h LEFT JOIN (SELECT * FROM city WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0) k ON k.name = h.city LEFT JOIN g ON g.hotel_id = h.id LEFT JOIN x ON x.src = h.id LEFT JOIN ma ON ma.src = h.id LEFT JOIN mt ON mt.src = h.id WHERE h.city IS NOT NULL)"""
_FAC = f"0.40e0 * ((0e0 + {_has('amen', 'pool')} + {_has('amen', 'wifi')}) / 2) + 0.20e0 * ((0e0 + {_has('attr', 'Beach')} + {_has('attr', 'Market')}) / 2) + 0.20e0 * coalesce(rating5, 0e0) / 5 + 0.20e0 * coalesce(star, 0e0) / 5"
_DIS = "greatest(0e0, least(1e0, 1 - 0.40e0 * CASE WHEN heavy THEN 1e0 ELSE 0e0 END - 0.20e0 * CASE WHEN moderate THEN 1e0 ELSE 0e0 END - 0.30e0 * least(events, 2) - least(coalesce(worst, 0e0) / 20, 0.5e0)))"
_PARTS = f"{_low('km')} AS spatial, {_low('delay')} AS accessibility, {_FAC} AS facility, {_low('price')} AS economic, {_DIS} AS disruption"


def _total(weights: dict[str, float], **instead: str) -> str:
    return "0e0 + " + " + ".join(f"{instead.get(k, k)} * {w!r}e0" for k, w in sc.normalised(weights).items())


_SCORED = "sc AS (SELECT id, city, {0} FROM {1}), w AS (SELECT *, {2} AS score FROM sc), wr AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, id) AS rank FROM w)"
_WEIGHTED = _SCORED.format(_PARTS, "c", rounded(_total(sc.WEIGHTS), 4))
_FILTER = "fr AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY rating5 DESC, coalesce(price, 'infinity'::DOUBLE), id) AS rank FROM c WHERE rating5 >= 3.5e0)"
_GOLD = "gold AS (SELECT city AS query_id, id AS item FROM c WHERE star >= 3 AND rating5 >= 3.5e0 AND len(list_filter(amen, lambda x: contains(x, 'pool'))) > 0)"
_LISTS = f"{_POOL}, {_WEIGHTED}, {_FILTER}, {_GOLD}, l AS (SELECT 'graph' AS system, city AS query_id, rank, id AS item FROM wr WHERE rank <= {K} UNION ALL SELECT 'filter', city, rank, id FROM fr WHERE rank <= {K})"
_METRICS = f"""{_LISTS}, gn AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), r AS (SELECT l.*, CASE WHEN gold.item IS NULL THEN 0 ELSE 1 END AS rel FROM l LEFT JOIN gold ON gold.query_id = l.query_id AND gold.item = l.item),
    p AS (SELECT system, query_id, sum(rel) AS hits, count(*) AS shown, sum(rel / log2(rank + 1e0)) AS dcg, min(rank) FILTER (WHERE rel = 1) AS first FROM r GROUP BY 1, 2),
    m AS (SELECT p.system, p.query_id, hits / shown AS precision, coalesce(hits / gn.n, 0e0) AS recall, CASE WHEN gn.n > 0 THEN dcg / list_sum(list_transform(range(1, cast(least(gn.n, {K}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1e0))) ELSE 0e0 END AS ndcg, coalesce(1e0 / first, 0e0) AS mrr FROM p LEFT JOIN gn ON gn.query_id = p.query_id)"""
_AVG = ", ".join(f"{rounded(f'avg({n})', 6)} AS {n}" for n in NAMES)
_FUSED = "f AS (SELECT query_id, item, sum(weight / (60 + rank)) AS score, min({{'list': list, 'rank': rank}}) AS first FROM y GROUP BY 1, 2) SELECT query_id, item, {0} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS position FROM f".replace("{{", "{").replace("}}", "}").replace("{0}", rounded("score", 8))
_JUDGED = "j AS (SELECT doc_id, doc_type, k, CASE WHEN (doc_id * 31 + k * 7) % 11 = 0 THEN NULL ELSE cast((cast(floor(doc_id / 3e0) AS BIGINT) + CASE WHEN (doc_id + k) % 5 = 0 THEN 1 ELSE 0 END) % 3 AS DOUBLE) END AS value FROM documents, (VALUES (0), (1), (2)) v(k))"
_STOP = "(" + ", ".join(f"'{s}'" for s in STOPS) + ")"
_EV = f"CASE WHEN known THEN {rounded(km_sql('ev', 'c'), 6)} END"
_AFF = {
    "seek": "CASE WHEN event_km IS NULL THEN 0.5e0 ELSE least(1e0, 1 - (CASE WHEN max(event_km) OVER () <= min(event_km) OVER () THEN 0.5e0 ELSE (event_km - min(event_km) OVER ()) / (max(event_km) OVER () - min(event_km) OVER ()) END) + CASE WHEN event_km <= 5e0 THEN 0.15e0 ELSE 0e0 END) END",
    "avoid": "CASE WHEN event_km IS NULL THEN 0.5e0 WHEN max(event_km) OVER () <= min(event_km) OVER () THEN 0.5e0 ELSE (event_km - min(event_km) OVER ()) / (max(event_km) OVER () - min(event_km) OVER ()) END",
}


def _personal_sql(preference: str) -> str:
    dis = "CASE WHEN coalesce(event_km <= 5e0, false) THEN greatest(0e0, disruption - 0.45e0) ELSE disruption END" if preference == "avoid" else "disruption"
    return f"WITH {_POOL}, ev AS (SELECT {EVENT['lat']}e0 AS lat, {EVENT['lng']}e0 AS lng), k0 AS (SELECT c.*, {_EV} AS event_km FROM c, ev WHERE city = 'Kolavara'), sc AS (SELECT id, city, event_km, {_PARTS}, {_AFF[preference]} AS event FROM k0), w AS (SELECT *, {rounded(_total(SEEK | {'event': 0.30}, disruption=f'({dis})'), 4)} AS score FROM sc), wr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM w) SELECT rank, id, score, {rounded('event', 3)} AS event FROM wr WHERE rank <= {K}"


def _intent_sql() -> str:
    from .texts import QUESTIONS, _any

    moved = {k: f"{w!r}e0" for k, w in sc.WEIGHTS.items()}
    for s, k, d in sc.DELTAS:
        moved[k] += f" + CASE WHEN {s} THEN {d!r}e0 ELSE 0e0 END"
    moved["spatial"] = f"CASE WHEN far THEN greatest(0.05e0, {moved['spatial']} - 0.10e0) ELSE {moved['spatial']} END"
    total = "(0e0 + " + " + ".join(sc.WEIGHTS) + ")"
    return f"""WITH {QUESTIONS}, b AS (SELECT doc_id, {_any('t', t.QUIET)} AS far, {_any('t', t.TRAFFIC)} AS tr, {_any('t', t.ACCESS)} AS access, {_any('t', t.CHEAP)} AS cheapest, {_any('t', t.LUXURY)} AS lux, {_any('t', [w for ws in t.AMENITIES.values() for w in ws])} AS amenities FROM q),
        f AS (SELECT *, far OR tr AS traffic, NOT cheapest AND lux AS highest_rated, NOT cheapest AND NOT lux AND (access OR far OR tr) AS most_accessible FROM b), g AS (SELECT doc_id, {', '.join(f'greatest(0e0, {c}) AS {k}' for k, c in moved.items())} FROM f)
        SELECT doc_id, {', '.join(f'{rounded(f"{k} / {total}", 4)} AS {k}' for k in sc.WEIGHTS)} FROM g"""


_RELAX = "kk AS (SELECT *, coalesce((rating5 IS NULL OR rating5 >= 4.8e0) AND (star IS NULL OR star >= 5) AND (km IS NULL OR km <= 12), false) AS ok FROM c), k2 AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY city) AS n FROM kk), k3 AS (SELECT * FROM k2 WHERE ok OR n = 0)"
_PERSONAS = "(VALUES " + ", ".join("('" + p + "', " + ", ".join(f"{v!r}e0" for v in (*w.values(), sc.EVENT_WEIGHT if likes in ("seek", "avoid") else 0.0)) + ")" for p, (w, likes, _) in sc.PERSONAS.items()) + ") v(persona, spatial, accessibility, facility, economic, disruption, event)"
_SUM = "(spatial + accessibility + facility + economic + disruption + event)"
SQL = {
    "context_text": f"WITH {_POOL}, {_WEIGHTED} SELECT city, string_agg(concat(rank, '. ', id, ' score ', cast(round(score * 10000) AS BIGINT)), chr(10) ORDER BY rank) AS context FROM wr WHERE rank <= {K} GROUP BY 1",
    "persona_weights": f"SELECT persona, {', '.join(f'{rounded(f"{k} / {_SUM}", 6)} AS {k}' for k in (*sc.WEIGHTS, 'event'))} FROM {_PERSONAS}",
    "gold_resolution": f"WITH {_POOL}, {_GOLD}, hu AS (SELECT city AS query_id, id AS item FROM c WHERE star = 5 AND city IN (SELECT name FROM city WHERE province IN ('West Shore', 'Dry Plain'))) SELECT query_id, item, 'human' AS gold_source FROM hu UNION ALL SELECT query_id, item, 'rules' FROM gold WHERE query_id NOT IN (SELECT query_id FROM hu)",
    "weighted_retrieve": f"WITH {_POOL}, {_WEIGHTED} SELECT city, rank, id, score, {', '.join(f'{rounded(k, 3)} AS {k}' for k in sc.WEIGHTS)} FROM wr WHERE rank <= {K}",
    "weighted_retrieve_relaxed": f"WITH {_POOL}, {_RELAX}, {_SCORED.format(_PARTS + ', n', 'k3', rounded(_total(sc.WEIGHTS), 4))} SELECT city, rank, id, score, n = 0 AS filters_relaxed FROM wr WHERE rank <= {K}",
    "personalized_event_seek": _personal_sql("seek"),
    "personalized_event_avoid": _personal_sql("avoid"),
    "intent_weights": _intent_sql(),
    "filter_baseline": f"WITH {_POOL}, {_FILTER} SELECT city, rank, id, rating5 FROM fr WHERE rank <= {K}",
    "gold_predicate": f"WITH {_POOL}, {_GOLD} SELECT query_id, item FROM gold",
    "tfidf_baseline": f"""WITH {HOTELS}, d AS (SELECT id, coalesce(description, '') AS text FROM h UNION ALL SELECT * FROM (VALUES {values(QUERY_TEXTS)}) v(id, text)),
        tk AS (SELECT id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf FROM tk WHERE length(term) >= 2 AND term NOT IN {_STOP} GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w0 AS (SELECT tf.id, tf.term, tf.tf * (ln((1e0 + (SELECT count(*) FROM d)) / (1 + df.df)) + 1) AS raw FROM tf JOIN df ON df.term = tf.term),
        nn AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM w0 GROUP BY 1), w1 AS (SELECT w0.id, w0.term, w0.raw / nn.norm AS w FROM w0 JOIN nn ON nn.id = w0.id),
        sm AS (SELECT a.id AS query_id, b.id, {rounded('sum(a.w * b.w)', 8)} AS similarity FROM w1 a JOIN w1 b ON a.term = b.term WHERE a.id IN ('v1', 'v2', 'v3', 'v4') AND b.id NOT IN ('v1', 'v2', 'v3', 'v4') GROUP BY 1, 2)
        SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) AS rank FROM sm) WHERE rank <= {K}""",
    "tfidf_questions": f"""WITH {HOTELS}, {AMENITY}, {ATTRACTION}, ma AS (SELECT src, string_agg(dst, ' ') AS v FROM am GROUP BY 1), mt AS (SELECT src, string_agg(dst, ' ') AS v FROM att GROUP BY 1),
        d AS (SELECT h.id, false AS asked, concat_ws(' ', h.name, h.description, ma.v, mt.v) AS text FROM h LEFT JOIN ma ON ma.src = h.id LEFT JOIN mt ON mt.src = h.id
            UNION ALL SELECT concat('question:', doc_id), true, min(text) FROM documents WHERE doc_type = 'qa' AND text IS NOT NULL AND doc_id % 20 = 0 GROUP BY doc_id),
        tk AS (SELECT id, asked, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM d), tf AS (SELECT id, asked, term, count(*) AS tf FROM tk WHERE length(term) >= 2 AND term NOT IN {_STOP} GROUP BY 1, 2, 3),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w0 AS (SELECT tf.id, tf.asked, tf.term, tf.tf * (ln((1e0 + (SELECT count(*) FROM d)) / (1 + df.df)) + 1) AS raw FROM tf JOIN df ON df.term = tf.term),
        nn AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM w0 GROUP BY 1), w1 AS (SELECT w0.id, w0.asked, w0.term, w0.raw / nn.norm AS w FROM w0 JOIN nn ON nn.id = w0.id),
        sm AS (SELECT a.id AS query_id, b.id, {rounded('sum(a.w * b.w)', 8)} AS similarity FROM w1 a JOIN w1 b ON a.term = b.term WHERE a.asked AND NOT b.asked GROUP BY 1, 2)
        SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) AS rank FROM sm) WHERE rank <= {K}""",
    "rrf_fusion": f"WITH {_LISTS}, y AS (SELECT query_id, CASE WHEN system = 'graph' THEN 0 ELSE 1 END AS list, 1e0 AS weight, rank, item FROM l), {_FUSED}",
    "adaptive_fusion": f"WITH {_LISTS}, z AS (SELECT city AS query_id, count(*) < 20 AS small FROM c GROUP BY 1), y AS (SELECT l.query_id, CASE WHEN (system = 'graph') = small THEN 1 ELSE 0 END AS list, CASE WHEN (system = 'graph') = small THEN 1e0 ELSE 2e0 END AS weight, rank, item FROM l JOIN z ON z.query_id = l.query_id), {_FUSED}",
    "ranking_metrics": f"WITH {_METRICS} SELECT system, query_id, {', '.join(f'{rounded(n, 6)} AS {n}' for n in NAMES)} FROM m",
    "metrics_by_system": f"WITH {_METRICS} SELECT system, {_AVG} FROM m GROUP BY 1",
    "metrics_by_category": f"WITH {_METRICS} SELECT k.province AS category, m.system, {_AVG} FROM m JOIN city k ON k.name = m.query_id GROUP BY 1, 2",
    "best_system": f"WITH {_METRICS}, b AS (SELECT query_id, system, {rounded('ndcg', 6)} AS ndcg FROM m) SELECT query_id, system AS best, ndcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ndcg DESC, CASE WHEN system = 'graph' THEN 0 ELSE 1 END) AS k FROM b) WHERE k = 1",
    "hybrid_delta": f"WITH {_METRICS}, a AS (SELECT system, avg(ndcg) AS ndcg FROM m GROUP BY 1), g0 AS (SELECT ndcg FROM a WHERE system = 'graph') SELECT system, {rounded('a.ndcg', 6)} AS ndcg, {rounded('(a.ndcg - g0.ndcg) / g0.ndcg * 100', 2)} AS delta FROM a, g0",
    "inspect_query": f"WITH {_LISTS} SELECT l.system, l.query_id, l.rank, l.item, c.km, c.rating5, c.star, gold.item IS NOT NULL AS relevant FROM l LEFT JOIN c ON c.id = l.item LEFT JOIN gold ON gold.query_id = l.query_id AND gold.item = l.item",
    "annotation_pool": f"""WITH {_LISTS}, tp AS (SELECT DISTINCT query_id, item FROM l WHERE rank <= 5), rs AS (SELECT city AS query_id, id AS item FROM c WHERE (city, id) NOT IN (SELECT (query_id, item) FROM tp)),
        dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat('7:', query_id, ':', item)), item) AS k FROM rs), p AS (SELECT query_id, item, false AS drawn FROM tp UNION ALL SELECT query_id, item, true FROM dr WHERE k <= 2)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat('8:', query_id, ':', item)), item) AS place FROM p""",
    "krippendorff_alpha": f"""WITH {_JUDGED}, v AS (SELECT doc_id AS unit, k, value FROM j WHERE value IS NOT NULL AND doc_id IN (SELECT doc_id FROM j WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)), m AS (SELECT unit, count(*) AS m FROM v GROUP BY 1),
        o AS (SELECT sum(pow(a.value - b.value, 2) / (m.m - 1)) AS s FROM v a JOIN v b ON a.unit = b.unit AND a.k <> b.k JOIN m ON m.unit = a.unit), h AS (SELECT value, count(*) AS c FROM v GROUP BY 1),
        e AS (SELECT sum(a.c * b.c * pow(a.value - b.value, 2)) AS s FROM h a, h b), n AS (SELECT cast(count(*) AS DOUBLE) AS n FROM v)
        SELECT {rounded('1 - (o.s / n.n) / (e.s / (n.n * (n.n - 1)))', 6)} AS alpha FROM o, e, n""",
    "majority_vote": f"WITH {_JUDGED} SELECT doc_id, count(value) AS n, CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value >= 1) * 2 > count(value) END AS relevant FROM j GROUP BY 1",
    "judgment_counts": f"WITH {_JUDGED} SELECT doc_type, k, count(value) AS n, {rounded('avg(value)', 6)} AS mean FROM j GROUP BY 1, 2",
    "reasons": f"WITH {_POOL}, {_WEIGHTED} SELECT city, rank, id, coalesce(concat_ws('; ', CASE WHEN spatial > 0.7e0 THEN 'close to the centre' END, CASE WHEN accessibility > 0.7e0 THEN 'quick to reach' END, CASE WHEN facility > 0.5e0 THEN 'well equipped' END, CASE WHEN disruption < 0.5e0 THEN 'disturbed' END, CASE WHEN disruption > 0.85e0 THEN 'undisturbed' END), '') AS reasons FROM wr WHERE rank <= {K}",
}
SQL |= {f.__name__: base.whole_sql(SQL[f.__name__]) for f in WHOLE}
for _k in ("seek", "avoid"):
    _sql = SQL[f"personalized_event_{_k}"].replace(" WHERE city = 'Kolavara'", "").replace("row_number() OVER (ORDER BY", "row_number() OVER (PARTITION BY city ORDER BY").replace("SELECT rank, id,", "SELECT city, rank, id,")
    SQL[f"personalized_event_{_k}"] = _sql.replace("(event_km) OVER ()", "(event_km) OVER (PARTITION BY city)")
