"""The graph's tables as views over the parquet tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import known
from ..functions.text import AMENITIES, ATTRACTIONS, ISLAND_ALIASES, ISLAND_ZONED, amenities, attraction_kinds, island_city
from ..operators.graph import upsert_latest
from ..operators.proximity import lists_of, near_links, near_lists, near_pairs, near_spots, near_sums, near_totals
from ..plans.lineage import cut
from ..sources.tables import table

EVENT_KM = 1.0
#: How far incidents and signals reach; the nearer EVENT_KM stands for callers that ask for it.
WHOLE_KM = 5.0


def hotels(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row per hotel, with ``city``."""
    rows = table(spark, folder, "hotel").withColumn("city", island_city(F.col("city_name")))
    return upsert_latest(rows, ["id"], [F.col("loaded_at").desc_nulls_last(), F.col("last_updated").desc_nulls_last()])


def signals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "traffic_signal")
    return upsert_latest(rows, ["id"], [F.col("signal_ts").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("severity").desc_nulls_last()])


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "graph_event")
    return upsert_latest(rows, ["id"], [F.col(c).desc_nulls_last() for c in ("loaded_at", "title", "start_time")])


def news(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "news_signal")
    return upsert_latest(rows, ["url"], [F.col(c).desc_nulls_last() for c in ("loaded_at", "summary", "published_at")])


def hotel_amenities(h: DataFrame) -> DataFrame:
    return h.select(F.col("id").alias("src"), F.explode(amenities(F.col("description"))).alias("dst"))


def hotel_attractions(h: DataFrame) -> DataFrame:
    return h.select(F.col("id").alias("src"), F.explode(attraction_kinds(F.col("description"))).alias("dst"))


def news_words() -> Column:
    """What of a piece of news is searched for names of cities."""
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))


def keyword_news(n: DataFrame, cities: DataFrame) -> DataFrame:
    """``news_url, news_title`` of the news that names a city of the table ``cities`` in its title or summary."""
    named = F.broadcast(cities.where(F.col("name") != "").select(F.lower("name").alias("word")).distinct())  # 24 rows
    hit = n.select("url", "title", news_words().alias("words")).join(named, F.contains(F.col("words"), F.col("word")), "left_semi")
    return hit.select(F.col("url").alias("news_url"), F.col("title").alias("news_title"))


def keyword_events(e: DataFrame, n: DataFrame, cities: DataFrame) -> DataFrame:
    """``dst, news_url, news_title``: events of such news."""
    return e.where(F.col("news_url").isNotNull()).select(F.col("id").alias("dst"), "news_url").join(keyword_news(n, cities), "news_url")


def keyword_hotels(h: DataFrame, cities: DataFrame) -> DataFrame:
    """``src``: the hotels of all cities of the table; each is affected by every keyword event, as in the reference."""
    return h.select(F.col("id").alias("src"), F.col("city").alias("name")).join(F.broadcast(cities.select("name").distinct()), "name", "left_semi").select("src")


def affected_by_whole(h: DataFrame, e: DataFrame, n: DataFrame, cities: DataFrame) -> DataFrame:
    """``src`` hotel, ``dst`` event: within 5 km, or of news that names a city."""
    return _affected(_marked(h, keyword_hotels(h, cities), "in_city"), _marked(e, keyword_events(e, n, cities).select("dst"), "named"))


def _affected(h: DataFrame, e: DataFrame) -> DataFrame:
    """``affected_by_whole`` of hotels whose ``in_city`` and events whose ``named`` is 1 where keywords link them, else null."""
    near = near_links(h, e, WHOLE_KM, ["in_city"], ["named"]).where(F.col("named").isNull() | F.col("in_city").isNull())
    ids = lambda d, by, name: d.where(F.col(by).isNotNull()).select(F.col("id").alias(name))
    return near.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")).unionByName(ids(h, "in_city", "src").crossJoin(ids(e, "named", "dst")))


def _marked(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: 1 where ``id`` is in the only column of ``ids``, else null."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias("id"), F.lit(1).alias(name)), "id", "left")


def affected_by(h: DataFrame, e: DataFrame, whole: bool = True) -> DataFrame:
    """``src`` hotel, ``dst`` event at most 1 km away (5 km for ``whole``, where keywords link more), ``km``."""
    return near_pairs(h, e, WHOLE_KM if whole else EVENT_KM).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), "km")


def points(s: DataFrame) -> DataFrame:
    """Point signals: those without a hotel."""
    return s.where(F.col("hotel_id").isNull())


def spots(rows: DataFrame, **more: Column) -> DataFrame:
    """Known positions of ``rows``, ``lat, lng``, with the number ``n`` of ids there and the aggregates ``more``."""
    return positioned(rows.where(F.col("id").isNotNull())).groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()])


def point_spots(s: DataFrame) -> DataFrame:
    """Positions of point signals (those without a hotel), ``lat, lng``, with what their signals say together."""
    n = lambda v: F.count(F.when(F.col("severity") == v, 1)).alias(v)
    return positioned(s.where(F.col("hotel_id").isNull())).groupBy("lat", "lng").agg(
        F.count(F.lit(1)).alias("total"), n("heavy"), n("moderate"), n("light"), n("unknown"), F.collect_set("severity").alias("severities"), F.max("eta_change_min").alias("worst"),
    )


def event_counts(h: DataFrame, e: DataFrame, n: DataFrame | None = None, cities: DataFrame | None = None) -> DataFrame:
    """``id`` of every hotel with events and their number ``events``; with ``n`` and ``cities`` over the whole links.

    Events at one position are counted before any pair is made, and those by keyword once for all hotels.
    """
    if n is None or cities is None:
        return affected_by(h, e, False).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("events"))
    named = keyword_events(e, n, cities).select("dst")
    at = spots(_marked(e, named, "named"), other=F.count(F.when(F.col("named").isNull(), 1)))
    near = near_sums(h, at, WHOLE_KM, ["n", "other"]).withColumnRenamed("left_id", "id")
    in_city = keyword_hotels(h, cities).select(F.col("src").alias("id")).crossJoin(named.agg(F.count(F.lit(1)).alias("named")))  # one row
    return near.join(in_city, "id", "full").select("id", F.when(F.col("named").isNull(), F.col("n")).otherwise(F.coalesce("other", F.lit(0)) + F.col("named")).alias("events"))


def has_signal(h: DataFrame, s: DataFrame) -> DataFrame:
    """``src`` hotel, ``dst`` signal: route signals by their hotel, point signals by distance."""
    return routes(h, s).unionByName(near_links(h, points(s), WHOLE_KM).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))


def routes(h: DataFrame, s: DataFrame) -> DataFrame:
    """``src`` hotel, ``dst`` its route signal."""
    return s.where(F.col("hotel_id").isNotNull()).select(F.col("hotel_id").alias("src"), F.col("id").alias("dst")).join(h.select(F.col("id").alias("src")), "src", "left_semi")


def signal_values(h: DataFrame, s: DataFrame, whole: bool = True) -> DataFrame:
    """Per hotel (``id``) the ``severities`` of its signals, whether any is ``heavy`` or ``moderate``, the ``worst`` delay, and the mean ``delay`` of its routes."""
    rows = s.where(F.col("hotel_id").isNotNull()).groupBy(F.col("hotel_id").alias("id")).agg(F.collect_set("severity").alias("severities"), F.max("eta_change_min").alias("worst"), F.avg("eta_change_min").alias("delay"))
    if whole:
        rows = rows.unionByName(near_spots(h, point_spots(s), WHOLE_KM).groupBy(F.col("left_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_set("severities"))).alias("severities"), F.max("worst").alias("worst")).withColumn("delay", F.lit(None).cast("double")))
        rows = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("severities"))).alias("severities"), F.max("worst").alias("worst"), F.max("delay").alias("delay"))  # sets of a few severities
    any_of = lambda v: F.array_contains("severities", v).alias(v)
    return rows.select("id", "severities", any_of("heavy"), any_of("moderate"), "worst", "delay")


def listed_edges(h: DataFrame, s: DataFrame, e: DataFrame, n: DataFrame) -> dict[str, DataFrame]:
    """Edges ``src, dst`` that rows of the tables name: all but those by distance and by keyword."""
    ends = lambda d, a, b: d.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return {
        "LOCATED_IN": ends(h, "id", "city"), "HAS_AMENITY": hotel_amenities(h), "NEAR_ATTRACTION": hotel_attractions(h), "HAS_SIGNAL": routes(h, s).select("src", "dst"),
        "MENTIONED_IN": ends(e, "id", "news_url").join(n.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst"),
    }


def linked_degrees(h: DataFrame, s: DataFrame, e: DataFrame, n: DataFrame, cities: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """How many edges by distance and by keyword each source and each target has, ``id, n``, per type; no edge is made."""
    named, in_city = keyword_events(e, n, cities).select("dst"), keyword_hotels(h, cities)
    count = lambda d, v="n": d.select(F.col("left_id").alias("id"), F.col(v).alias("n"))
    hotels_at = spots(_marked(h, in_city, "in_city"), other=F.count(F.when(F.col("in_city").isNull(), 1)))
    near = near_sums(_marked(e, named, "named"), hotels_at, WHOLE_KM, ["n", "other"], keep=["named"])
    hit = near.select(F.col("left_id").alias("id"), F.when(F.col("named").isNull(), F.col("n")).otherwise(F.col("other")).alias("n"))
    hit = hit.unionByName(named.select(F.col("dst").alias("id")).crossJoin(in_city.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return {
        "HAS_SIGNAL": (count(near_sums(h, spots(points(s)), WHOLE_KM, ["n"])), count(near_sums(points(s), spots(h), WHOLE_KM, ["n"]))),
        "AFFECTED_BY": (event_counts(h, e, n, cities).select("id", F.col("events").alias("n")), hit),
    }


def kept(spark: SparkSession, folder: str, of_lists: Callable[[Column], Column] = lambda c: c) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hotels, events and the news that events mention, each reduced to what links need of it after one shuffle, and kept.

    Hotels have ``in_city`` (1 where their city is of the table, else null) and ``of_lists`` of their ``amenities`` and
    ``attractions``; events have ``named`` (1 where their news names a city, else null). Then come ``id, news_url`` of
    events whose news is known, and ``url`` of all news.
    """
    cities = table(spark, folder, "city")
    in_city = F.broadcast(cities.select(F.col("name").alias("city"), F.lit(1).alias("in_city")).distinct())  # 24 rows
    h = hotels(spark, folder).join(in_city, "city", "left")
    h = cut(h.select("id", "lat", "lng", "city", "in_city", of_lists(amenities(F.col("description"))).alias("amenities"), of_lists(attraction_kinds(F.col("description"))).alias("attractions")))
    words = cities.where(F.col("name") != "").agg(F.collect_set(F.lower("name")).alias("names"))  # one row
    n = cut(news(spark, folder).crossJoin(F.broadcast(words)).select("url", F.exists("names", lambda w: F.contains(news_words(), w)).alias("named")))
    e = cut(events(spark, folder).select("id", "lat", "lng", "news_url"))
    mentioned = cut(e.where(F.col("news_url").isNotNull()).join(n.withColumnRenamed("url", "news_url"), "news_url").select("id", "news_url", "named"))
    return h, _marked(e, mentioned.where("named").select("id"), "named"), mentioned, n


def graph_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``label, n`` of the nodes and ``type, n`` of the edges; edges by distance and by keyword are counted, not made.

    Each table is shuffled once: its latest rows are reduced to what all counts need of them (signals to their hotels
    and positions) and kept. Hotels of one position meet signals and events together.
    """
    cities = table(spark, folder, "city")
    h, e, mentioned, news_kept = kept(spark, folder, lambda c: F.greatest(F.size(c), F.lit(0)).cast("bigint"))
    place = lambda c: F.when(F.col("hotel_id").isNull(), F.col(c)).alias(c)
    s = cut(signals(spark, folder).groupBy("hotel_id", place("lat"), place("lng")).agg(F.count(F.lit(1)).alias("n")))

    hotels_at = spots(h, out=F.count(F.when(F.col("in_city").isNull(), 1)))
    at = lambda d, **n: d.select("lat", "lng", *[n.get(c, F.lit(0)).cast("bigint").alias(c) for c in ("signals", "events", "other")])
    others = spots(e, other=F.count(F.when(F.col("named").isNull(), 1)))
    met = at(positioned(s.where(F.col("hotel_id").isNull())), signals=F.col("n")).unionByName(at(others, events=F.col("n"), other=F.col("other")))
    met = met.groupBy("lat", "lng").agg(*[F.sum(c).alias(c) for c in ("signals", "events", "other")])
    near = hotels_at.join(near_totals(hotels_at, met, WHOLE_KM, ["signals", "events", "other"]), ["lat", "lng"])  # a row per position
    near = near.select((F.col("n") * F.col("signals")).alias("signals"), (F.col("out") * F.col("events") + (F.col("n") - F.col("out")) * F.col("other")).alias("events"))

    count = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    total = lambda d, c: d.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"))
    by_keyword = count(e.where(F.col("named").isNotNull())).withColumnRenamed("n", "a").crossJoin(count(h.where(F.col("in_city").isNotNull()))).select((F.col("a") * F.col("n")).alias("n"))
    routes_of = s.join(h.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi")
    near = cut(near.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("signals", "events")]))  # one row
    nodes = {"Hotel": count(h), "TrafficSignal": total(s, "n"), "Event": count(e), "NewsSignal": count(news_kept), "City": count(cities)}
    types = {
        "LOCATED_IN": [count(h.where(F.col("city").isNotNull()))], "HAS_AMENITY": [total(h, "amenities")], "NEAR_ATTRACTION": [total(h, "attractions")], "MENTIONED_IN": [count(mentioned)],
        "HAS_SIGNAL": [total(routes_of, "n"), near.select(F.col("signals").alias("n"))], "AFFECTED_BY": [by_keyword, near.select(F.col("events").alias("n"))],
    }
    named_rows = lambda name, d: reduce(DataFrame.unionByName, [x.select(F.lit(k).alias(name), "n") for k, x in d])
    return named_rows("label", nodes.items()), named_rows("type", [(k, x) for k, v in types.items() for x in v]).groupBy("type").agg(F.sum("n").alias("n"))


def degrees(spark: SparkSession, folder: str) -> DataFrame:
    """``id, degree`` of the ends of all edges; those by distance and by keyword are counted, not made."""
    h, s, e, n = (f(spark, folder) for f in (hotels, signals, events, news))
    ends = [d.select(F.col(c).alias("id"), F.lit(1).cast("bigint").alias("n")) for d in listed_edges(h, s, e, n).values() for c in ("src", "dst")]
    ends += [d for pair in linked_degrees(h, s, e, n, table(spark, folder, "city")).values() for d in pair]
    return reduce(DataFrame.unionByName, ends).groupBy("id").agg(F.sum("n").alias("degree")).where(F.col("degree") > 0)


def edges(spark: SparkSession, folder: str, whole: bool = True) -> dict[str, DataFrame]:
    if whole:
        return _whole_edges(spark, folder)
    h, s, e, n = (f(spark, folder) for f in (hotels, signals, events, news))
    return listed_edges(h, s, e, n) | {"AFFECTED_BY": affected_by(h, e, False).select("src", "dst")}


def _whole_edges(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All edges from tables that are shuffled once. Signals are listed by hotel or position from one shuffle of their latest rows."""
    h, e, mentioned, _ = kept(spark, folder)
    route = F.col("hotel_id").isNotNull()
    place = lambda c: F.when(route, 0.0).otherwise(F.col(c)).alias(c)
    s = signals(spark, folder).where(route | known(F.col("lat"), F.col("lng"))).select("id", route.alias("route"), F.coalesce("hotel_id", F.lit("")).alias("hotel_id"), place("lat"), place("lng"))
    lists = lists_of(s, ["route", "hotel_id", "lat", "lng"])
    of_routes = lists.where("route").join(h.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi").select(F.col("hotel_id").alias("src"), F.inline("__rows"))
    of_points = near_lists(h, lists.where(~F.col("route")).select("lat", "lng", "__rows"), WHOLE_KM)
    each = lambda c: h.select(F.col("id").alias("src"), F.explode(c).alias("dst"))
    return {
        "LOCATED_IN": h.where(F.col("city").isNotNull()).select(F.col("id").alias("src"), F.col("city").alias("dst")), "HAS_AMENITY": each("amenities"), "NEAR_ATTRACTION": each("attractions"),
        "HAS_SIGNAL": of_routes.withColumnRenamed("right_id", "dst").unionByName(of_points.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))),
        "MENTIONED_IN": mentioned.select(F.col("id").alias("src"), F.col("news_url").alias("dst")), "AFFECTED_BY": _affected(h, e),
    }


def typed_edges(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    out = None
    for name, d in edges(spark, folder, whole).items():
        part = d.select("src", "dst", F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def positioned(d: DataFrame) -> DataFrame:
    return d.where(known(F.col("lat"), F.col("lng")))


# --- the same in SQL


def values(rows: Iterable[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def city_sql(c: str) -> str:
    low = f"trim(regexp_replace(lower(trim(regexp_replace(regexp_replace({c}, '(?i)\\s+city\\s*$', ''), '\\s+', ' ', 'g'))), '[,\\s]+\\d{{4,6}}$', ''))"
    base = f"trim(regexp_extract({low}, '^(.*?)[\\s-]+\\d{{1,3}}$', 1))"
    one = f"(CASE WHEN {base} IN ({', '.join(repr(z) for z in ISLAND_ZONED)}) THEN {base} ELSE {low} END)"
    title = f"array_to_string(list_transform(string_split({one}, ' '), lambda w: concat(upper(w[1:1]), w[2:])), ' ')"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ISLAND_ALIASES.items())
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {c} ELSE CASE {one} {whens} ELSE {title} END END"


def _latest(name: str, source: str, key: str, order: Iterable[str], more: str = "") -> str:
    by = ", ".join(f"{c} DESC NULLS LAST" for c in order)
    return f"{name} AS (SELECT * EXCLUDE (rn){more} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn FROM {source} WHERE {key} IS NOT NULL) WHERE rn = 1)"


KNOWN = "({0}.lat IS NOT NULL AND {0}.lng IS NOT NULL AND {0}.lat <> 0 AND {0}.lng <> 0)"
KM = "(2 * 6371.0e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def km_sql(p: str, q: str) -> str:
    a = f"(pow(sin(radians({q}.lat - {p}.lat) / 2), 2) + cos(radians({p}.lat)) * cos(radians({q}.lat)) * pow(sin(radians({q}.lng - {p}.lng) / 2), 2))"
    return KM.format(a=a)


HOTELS = _latest("h", "hotel", "id", ["loaded_at", "last_updated"], f", {city_sql('city_name')} AS city")
SIGNALS = _latest("s", "traffic_signal", "id", ["signal_ts", "loaded_at", "severity"])
EVENTS = _latest("e", "graph_event", "id", ["loaded_at", "title", "start_time"])
NEWS_ORDER = ["loaded_at", "summary", "published_at"]
NEWS = _latest("n", "news_signal", "url", NEWS_ORDER)
AMENITY = f"am AS (SELECT DISTINCT h.id AS src, a.name AS dst FROM h JOIN (VALUES {values((k, w) for k, ws in AMENITIES.items() for w in ws)}) a(name, word) ON contains(lower(h.description), a.word))"
ATTRACTION = f"att AS (SELECT DISTINCT h.id AS src, a.name AS dst FROM h JOIN (VALUES {values((v, k) for k, v in ATTRACTIONS.items())}) a(name, word) ON contains(lower(h.description), a.word))"
AFFECTED = f"ab AS (SELECT h.id AS src, e.id AS dst, {km_sql('h', 'e')} AS km FROM h JOIN e ON {KNOWN.format('h')} AND {KNOWN.format('e')} AND e.lat BETWEEN h.lat - 0.02 AND h.lat + 0.02 AND {km_sql('h', 'e')} <= {EVENT_KM}e0)"
AFFECTED_WHOLE = f"""{_latest("kr", "news_signal", "url", NEWS_ORDER)}, kn AS (SELECT url FROM kr WHERE EXISTS (SELECT 1 FROM city k WHERE k.name <> '' AND contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))), lower(k.name)))),
    ab AS (SELECT h.id AS src, e.id AS dst FROM h JOIN e ON {KNOWN.format('h')} AND {KNOWN.format('e')} AND e.lat BETWEEN h.lat - 0.1 AND h.lat + 0.1 AND {km_sql('h', 'e')} <= {WHOLE_KM}e0
        UNION SELECT h.id, e.id FROM h, e WHERE h.city IN (SELECT name FROM city) AND e.news_url IN (SELECT url FROM kn))"""
#: Signals with the hotels they are linked to: ``hs`` has a row per link.
SIGNALS_WHOLE = f"""{SIGNALS}, hs AS (SELECT h.id AS src, s.* FROM s JOIN h ON s.hotel_id = h.id UNION ALL SELECT h.id, s.* FROM h JOIN s ON s.hotel_id IS NULL AND {KNOWN.format('h')} AND {KNOWN.format('s')}
    AND s.lat BETWEEN h.lat - 0.1 AND h.lat + 0.1 AND s.lng BETWEEN h.lng - 0.1 AND h.lng + 0.1 WHERE {km_sql('h', 's')} <= {WHOLE_KM}e0)"""
EDGES = f"""{HOTELS}, {SIGNALS}, {EVENTS}, {NEWS}, {AMENITY}, {ATTRACTION}, {AFFECTED},
    edge AS (SELECT id AS src, city AS dst, 'LOCATED_IN' AS type FROM h WHERE city IS NOT NULL
        UNION ALL SELECT src, dst, 'HAS_AMENITY' FROM am UNION ALL SELECT src, dst, 'NEAR_ATTRACTION' FROM att
        UNION ALL SELECT s.hotel_id, s.id, 'HAS_SIGNAL' FROM s SEMI JOIN h ON s.hotel_id = h.id
        UNION ALL SELECT e.id, e.news_url, 'MENTIONED_IN' FROM e SEMI JOIN n ON e.news_url = n.url
        UNION ALL SELECT src, dst, 'AFFECTED_BY' FROM ab)"""


#: Parts of the SQL, and what stands in their place over the whole links.
WHOLE_PARTS = {
    AFFECTED: AFFECTED_WHOLE, SIGNALS: SIGNALS_WHOLE, "SELECT s.hotel_id, s.id, 'HAS_SIGNAL' FROM s SEMI JOIN h ON s.hotel_id = h.id": "SELECT src, id, 'HAS_SIGNAL' FROM hs",
    "g AS (SELECT hotel_id, string_agg(DISTINCT severity, ';' ORDER BY severity) AS v, max(eta_change_min) AS w FROM s WHERE hotel_id IS NOT NULL GROUP BY 1)": "g AS (SELECT src AS hotel_id, string_agg(DISTINCT severity, ';' ORDER BY severity) AS v, max(eta_change_min) AS w FROM hs GROUP BY 1)",
    "avg(eta_change_min) AS delay, bool_or(severity = 'heavy') AS heavy, bool_or(severity = 'moderate') AS moderate, max(eta_change_min) AS worst FROM s WHERE hotel_id IS NOT NULL GROUP BY 1": "avg(eta_change_min) FILTER (WHERE route IS NOT NULL) AS delay, bool_or(severity = 'heavy') AS heavy, bool_or(severity = 'moderate') AS moderate, max(eta_change_min) AS worst FROM (SELECT * EXCLUDE (src, hotel_id), src AS hotel_id, hotel_id AS route FROM hs) GROUP BY 1",
    "SELECT h.city, count(*) AS total": "SELECT h.city, count(DISTINCT s.id) AS total", "count(*) FILTER (WHERE s.severity": "count(DISTINCT s.id) FILTER (WHERE s.severity", "FROM s JOIN h ON s.hotel_id = h.id GROUP BY 1": "FROM hs s JOIN h ON s.src = h.id GROUP BY 1",
}


def whole_sql(sql: str) -> str:
    """The SQL of a query over the whole links."""
    for part, whole in WHOLE_PARTS.items():
        sql = sql.replace(part, whole)
    return sql


def rounded(c: str, digits: int) -> str:
    n = f"1e{digits}"
    return f"(floor(({c}) * {n} + 0.5e0) / {n})"
