"""Questions, names and places in texts; filters, unions and de-duplication of news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.graph import upsert_latest
from ..sources.landed import first_per_url, union_or_fallback
from ..sources.tables import table
from . import base
from .base import EVENTS, HOTELS, NEWS, values

TOWNS = ["kolavara", "hikkala", "negamba"]
MENTIONS = ["harbour", "roundabout", "kolavara"]
QUESTIONS = "q AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE doc_type = 'qa' AND text IS NOT NULL)"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where((F.col("doc_type") == "qa") & F.col("text").isNotNull()).select("doc_id", "text")


def _joined(c: Column) -> Column:
    return F.coalesce(F.array_join(c, ";"), F.lit(""))


def canonical_city(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hotel").select("city_name").distinct().select("city_name", t.island_city(F.col("city_name")).alias("city"))


def intent_price_regex(spark: SparkSession, folder: str) -> DataFrame:
    low, high = t.price_bounds(F.col("text"))
    return _questions(spark, folder).select("doc_id", low.alias("min_price"), high.alias("max_price"))


def intent_rating_regex(spark: SparkSession, folder: str) -> DataFrame:
    rating, star = t.rating_bounds(F.col("text"))
    return _questions(spark, folder).select("doc_id", rating.alias("min_rating"), star.alias("min_star"))


def intent_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("doc_id", t.intent(F.col("text"), F.lit(None).cast("string")).alias("i")).select("doc_id", "i.proximity", "i.access", "i.avoid_traffic", "i.sort")


def intent_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("doc_id", _joined(t.keywords(F.col("text"))).alias("keywords"))


def amenity_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("doc_id", _joined(F.array_sort(t.amenities(F.col("text")))).alias("amenities"), _joined(F.array_sort(t.asked_attractions(F.col("text")))).alias("attractions"))


def question_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per kind and language."""
    return table(spark, folder, "documents").groupBy("doc_type", "lang").agg(F.count(F.lit(1)).alias("n"))


def single_attribute(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that ask for one thing only: price, or quality, and neither access nor attractions."""
    low, high = t.price_bounds(F.col("text"))
    rating, star = t.rating_bounds(F.col("text"))
    dims = F.when(low.isNotNull() | high.isNotNull(), 1).otherwise(0) + F.when(rating.isNotNull() | star.isNotNull(), 1).otherwise(0)
    low_text = F.lower("text")
    more = t.any_of(low_text, t.ACCESS) | t.any_of(low_text, t.TRAFFIC) | t.any_of(low_text, t.QUIET) | (F.size(t.asked_attractions(F.col("text"))) > 0)
    return _questions(spark, folder).select("doc_id", ((dims <= 1) & ~more).alias("single"))


def ner_neighbourhoods(spark: SparkSession, folder: str) -> DataFrame:
    return base.hotels(spark, folder).select("id", _joined(t.neighbourhoods(F.col("address"), F.col("city_name"))).alias("names"))


def ner_landmarks(spark: SparkSession, folder: str) -> DataFrame:
    return base.hotels(spark, folder).select("id", _joined(t.landmarks(F.col("description"))).alias("names"))


def ner_attractions(spark: SparkSession, folder: str) -> DataFrame:
    return base.hotels(spark, folder).select("id", _joined(F.array_sort(t.attraction_kinds(F.col("description")))).alias("kinds"))


def url_host(spark: SparkSession, folder: str) -> DataFrame:
    return base.news(spark, folder).groupBy(t.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def md5_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Event ids from titles: equal titles collapse to one event."""
    n = base.news(spark, folder)
    return n.groupBy(F.md5(F.coalesce("title", F.lit(""))).alias("event_id")).agg(F.min(F.substring("title", 1, 200)).alias("title"), F.count(F.lit(1)).alias("mentions"), F.min("url").alias("first_url"))


def news_keyword_link(spark: SparkSession, folder: str) -> DataFrame:
    """News that mentions any of the keywords is linked to the hotels of all towns of the list, counted per news and town."""
    words = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    hit = base.news(spark, folder).where(t.any_of(words, MENTIONS)).select("url", F.lit(1).alias("one"))
    per_town = base.hotels(spark, folder).where(F.lower("city").isin(TOWNS)).groupBy("city").agg(F.count(F.lit(1)).alias("hotels")).withColumn("one", F.lit(1))
    return hit.join(F.broadcast(per_town), "one").select("url", "city", "hotels")  # one row per town of the list


def news_keyword_link_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the table of cities as both the keywords and the list of towns."""
    cities = table(spark, folder, "city")
    hit = base.keyword_news(base.news(spark, folder), cities).select(F.col("news_url").alias("url"))
    per_town = base.hotels(spark, folder).join(F.broadcast(cities.select(F.col("name").alias("city")).distinct()), "city", "left_semi").groupBy("city").agg(F.count(F.lit(1)).alias("hotels"))
    return hit.crossJoin(F.broadcast(per_town)).select("url", "city", "hotels")  # one row per city of the table


def event_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Incident titles taken apart: kind before the colon, streets after it."""
    e = base.events(spark, folder).where(F.col("event_type") == "traffic_incident")
    kind = F.regexp_extract("title", "^([A-Za-z_]+):", 1)
    rest = F.trim(F.regexp_replace("title", "^[A-Za-z_]+:", ""))
    return e.select("id", F.upper(kind).alias("kind"), F.regexp_extract(rest, "(?i)^(.*?) to ", 1).alias("from_street"), F.length(rest).alias("rest_length"))


def json_slots(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects inside texts, read leniently: severity and eta, or null."""
    d = table(spark, folder, "documents").where(F.col("text").contains("{"))
    j = F.from_json(t.unfenced(F.regexp_extract("text", r"(\{[^{}]*\})", 1)), "severity string, eta double")
    return d.select("doc_id", j.alias("j")).select("doc_id", "j.severity", "j.eta")


def latest_news_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten latest news by the text of their date, as a report."""
    return base.news(spark, folder).select("url", "title", "published_at").orderBy(F.col("published_at").desc_nulls_first(), "url").limit(10)


def top_rated_nulls_first(spark: SparkSession, folder: str) -> DataFrame:
    return base.hotels(spark, folder).select("id", "rating").orderBy(F.col("rating").desc_nulls_first(), "id").limit(25)


def news_dedupe_by_url_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds in priority order, first item per url, at most 100 items (a feed limit)."""
    n = table(spark, folder, "news_signal").select("url", "source", F.when(F.col("source").startswith("newsapi"), 0).when(F.col("source").startswith("gnews"), 1).otherwise(2).alias("priority"), F.concat_ws("|", "id", F.unix_seconds("loaded_at"), F.coalesce("summary", F.lit(""))).alias("ordinal"))
    return first_per_url(n, "priority", "ordinal", 100).select("url", "source", "priority")


def source_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A feed without items falls back to the RSS feeds; one with items does not."""
    n = base.news(spark, folder).select("url", "source")
    rss = n.where(F.col("source").startswith("rss:"))
    empty = union_or_fallback(n.where(F.col("source") == "nosuchfeed"), rss).groupBy("source").count().select("source", F.col("count").alias("n"), F.lit("fallback").alias("case"))
    full = union_or_fallback(n.where(F.col("source").startswith("gnews")), rss).groupBy("source").count().select("source", F.col("count").alias("n"), F.lit("first").alias("case"))
    return empty.unionByName(full)


def union_sources_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the hotel sources with distinct ids, the latest row winning, counted per source and IN-list."""
    h = table(spark, folder, "hotel")
    both = h.where(F.col("source") == "google_places").unionByName(h.where(F.col("source").isin("liteapi", "tripdesk", "lankastay")))
    once = upsert_latest(both, ["id"], [F.col("loaded_at").desc_nulls_last(), F.col("last_updated").desc_nulls_last()])
    return once.groupBy("source", F.col("price_range").isin("Luxury", "Mid-Range").alias("upper")).agg(F.count(F.lit(1)).alias("n"))


def recent_window(spark: SparkSession, folder: str) -> DataFrame:
    """News loaded in the seven days up to the latest load, per day and hour."""
    n = table(spark, folder, "news_signal").withColumn("s", F.unix_seconds("loaded_at"))
    last = n.agg(F.max("s")).scalar()
    return n.where(F.col("s") >= last - 7 * 86_400).groupBy(F.floor(F.col("s") / 86_400).alias("day"), F.pmod(F.floor(F.col("s") / 3600), F.lit(24)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def complete_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that have all they need, by kind."""
    h = table(spark, folder, "hotel").where(F.col("id").isNotNull() & F.col("name").isNotNull() & (F.trim("name") != "") & F.col("lat").isNotNull() & (F.col("lat") != 0) & F.col("lng").isNotNull() & (F.col("lng") != 0))
    n = table(spark, folder, "news_signal").where(F.col("url").isNotNull() & (F.col("url") != "") & F.col("title").isNotNull() & F.col("summary").isNotNull() & (F.col("summary") != ""))
    count = lambda d, k: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(h, "hotel").unionByName(count(n, "news"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_city, intent_price_regex, intent_rating_regex, intent_flags, intent_keywords, amenity_synonyms, question_counts, single_attribute, ner_neighbourhoods, ner_landmarks, ner_attractions, url_host, md5_ids,
        news_keyword_link, news_keyword_link_whole, event_titles, json_slots, latest_news_topk, top_rated_nulls_first, news_dedupe_by_url_capped, source_fallback, union_sources_keep_first, recent_window, complete_items,
    )
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


_T = "replace(t, ',', '')"
_NUM = "try_cast(nullif(regexp_extract({0}, {1}, {2}), '') AS {3})"
_A, _B = _NUM.format(_T, _q(t.BETWEEN), 1, "DOUBLE"), _NUM.format(_T, _q(t.BETWEEN), 2, "DOUBLE")
_MIN = f"CASE WHEN {_A} IS NOT NULL AND {_B} IS NOT NULL THEN least({_A}, {_B}) ELSE {_NUM.format(_T, _q(t.AT_LEAST), 1, 'DOUBLE')} END"
_MAX = f"CASE WHEN {_A} IS NOT NULL AND {_B} IS NOT NULL THEN greatest({_A}, {_B}) ELSE {_NUM.format(_T, _q(t.AT_MOST), 1, 'DOUBLE')} END"
_R = _NUM.format("t", _q(t.RATING), 1, "DOUBLE")
_RATING = f"CASE WHEN {_any('t', t.TOP_RATED)} THEN coalesce(nullif({_R}, 0), 4.0e0) ELSE {_R} END"
_STAR = f"cast(floor({_NUM.format('t', _q(t.STARS), 1, 'DOUBLE')}) AS INTEGER)"
_STOPS = "(" + ", ".join(map(_q, t.QUESTION_STOPS)) + ")"
_FIRSTS = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(address, '[,/|]'), lambda p: trim(p)), lambda p: length(p) >= 4 AND NOT regexp_matches(p, '^[\\d\\s-]+$') AND NOT regexp_matches(p, '^[A-Za-z]{{1,3}}\\.?$') AND lower(p) <> lower(trim(coalesce(city_name, ''))) AND lower(p) NOT IN ({', '.join(map(_q, t.COUNTRIES))}))"
_FOUND = "flatten([" + ", ".join(f"regexp_extract_all(description, {_q(p)}, 1)" for p in t.NEARBY) + "])"
_NAMES = f"list_filter(list_transform({_FOUND}, lambda n: rtrim(trim(n), '.,;')), lambda n: length(n) >= 4 AND regexp_matches(n, '[A-Z]'))"
_AM = f"(VALUES {values((k, w) for k, ws in t.AMENITIES.items() for w in ws)}) a(name, word)"
_AT = f"(VALUES {values((k,) for k in t.ASKED_ATTRACTIONS)}) a(name)"
SQL = {
    "canonical_city": f"SELECT DISTINCT city_name, {base.city_sql('city_name')} AS city FROM hotel",
    "intent_price_regex": f"WITH {QUESTIONS} SELECT doc_id, {_MIN} AS min_price, {_MAX} AS max_price FROM q",
    "intent_rating_regex": f"WITH {QUESTIONS} SELECT doc_id, {_RATING} AS min_rating, {_STAR} AS min_star FROM q",
    "intent_flags": f"""WITH {QUESTIONS}, f AS (SELECT doc_id, {_any('t', t.QUIET)} AS quiet, {_any('t', t.CLOSE)} AS near, {_any('t', t.TRAFFIC)} AS traffic, {_any('t', t.ACCESS)} AS acc, {_any('t', t.CHEAP)} AS cheap, {_any('t', t.LUXURY)} AS lux FROM q)
        SELECT doc_id, CASE WHEN quiet THEN 'far' WHEN near THEN 'close' ELSE 'any' END AS proximity, CASE WHEN acc THEN 'high' ELSE 'normal' END AS access, quiet OR traffic AS avoid_traffic,
        CASE WHEN cheap THEN 'cheapest' WHEN lux THEN 'highest_rated' WHEN acc OR quiet OR traffic THEN 'most_accessible' ELSE 'best_overall' END AS sort FROM f""",
    "intent_keywords": f"WITH {QUESTIONS} SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, '[a-z]{{3,}}'), lambda w: w NOT IN {_STOPS})[1:12], ';') AS keywords FROM q",
    "amenity_synonyms": f"WITH {QUESTIONS}, x AS (SELECT DISTINCT doc_id, a.name FROM q JOIN {_AM} ON contains(q.t, a.word)), y AS (SELECT DISTINCT doc_id, a.name FROM q JOIN {_AT} ON contains(q.t, a.name)), xs AS (SELECT doc_id, string_agg(name, ';' ORDER BY name) AS v FROM x GROUP BY 1), ys AS (SELECT doc_id, string_agg(name, ';' ORDER BY name) AS v FROM y GROUP BY 1) SELECT q.doc_id, coalesce(xs.v, '') AS amenities, coalesce(ys.v, '') AS attractions FROM q LEFT JOIN xs ON xs.doc_id = q.doc_id LEFT JOIN ys ON ys.doc_id = q.doc_id",
    "question_counts": "SELECT doc_type, lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "single_attribute": f"WITH {QUESTIONS} SELECT doc_id, (CASE WHEN ({_MIN}) IS NOT NULL OR ({_MAX}) IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ({_RATING}) IS NOT NULL OR ({_STAR}) IS NOT NULL THEN 1 ELSE 0 END) <= 1 AND NOT {_any('t', t.ACCESS + t.TRAFFIC + t.QUIET + t.ASKED_ATTRACTIONS)} AS single FROM q",
    "ner_neighbourhoods": f"WITH {HOTELS}, p AS (SELECT id, {_PARTS} AS parts FROM h) SELECT id, coalesce(array_to_string(({_FIRSTS.format('parts')})[1:2], ';'), '') AS names FROM p",
    "ner_landmarks": f"WITH {HOTELS}, p AS (SELECT id, {_NAMES} AS parts FROM h) SELECT id, coalesce(array_to_string(({_FIRSTS.format('parts')})[1:6], ';'), '') AS names FROM p",
    "ner_attractions": f"WITH {HOTELS}, {base.ATTRACTION}, g AS (SELECT src, string_agg(dst, ';' ORDER BY dst) AS v FROM att GROUP BY 1) SELECT h.id, coalesce(g.v, '') AS kinds FROM h LEFT JOIN g ON g.src = h.id",
    "url_host": f"WITH {NEWS} SELECT string_split(url, '/')[3] AS host, count(*) AS n FROM n GROUP BY 1",
    "md5_ids": f"WITH {NEWS} SELECT md5(coalesce(title, '')) AS event_id, min(substring(title, 1, 200)) AS title, count(*) AS mentions, min(url) AS first_url FROM n GROUP BY 1",
    "news_keyword_link": f"WITH {HOTELS}, {NEWS}, k AS (SELECT city, count(*) AS hotels FROM h WHERE lower(city) IN ({', '.join(map(_q, TOWNS))}) GROUP BY 1) SELECT n.url, k.city, k.hotels FROM n, k WHERE {_any(chr(108) + 'ower(concat_ws(' + _q(' ') + ', coalesce(n.title, ' + _q('') + '), coalesce(n.summary, ' + _q('') + ')))', MENTIONS)}",
    "news_keyword_link_whole": f"WITH {HOTELS}, {NEWS}, k AS (SELECT city, count(*) AS hotels FROM h WHERE city IN (SELECT name FROM city) GROUP BY 1) SELECT n.url, k.city, k.hotels FROM n, k WHERE EXISTS (SELECT 1 FROM city c WHERE c.name <> '' AND contains(lower(concat_ws(' ', coalesce(n.title, ''), coalesce(n.summary, ''))), lower(c.name)))",
    "event_titles": f"WITH {EVENTS} SELECT id, upper(regexp_extract(title, '^([A-Za-z_]+):', 1)) AS kind, regexp_extract(trim(regexp_replace(title, '^[A-Za-z_]+:', '')), '(?i)^(.*?) to ', 1) AS from_street, length(trim(regexp_replace(title, '^[A-Za-z_]+:', ''))) AS rest_length FROM e WHERE event_type = 'traffic_incident'",
    "json_slots": "WITH j AS (SELECT doc_id, regexp_extract(text, '(\\{[^{}]*\\})', 1) AS o FROM documents WHERE contains(text, '{')), k AS (SELECT doc_id, CASE WHEN json_valid(o) THEN o END AS o FROM j) SELECT doc_id, json_extract_string(o, '$.severity') AS severity, try_cast(json_extract_string(o, '$.eta') AS DOUBLE) AS eta FROM k",
    "latest_news_topk": f"WITH {NEWS} SELECT url, title, published_at FROM n ORDER BY published_at DESC NULLS FIRST, url LIMIT 10",
    "top_rated_nulls_first": f"WITH {HOTELS} SELECT id, rating FROM h ORDER BY rating DESC NULLS FIRST, id LIMIT 25",
    "news_dedupe_by_url_capped": "WITH p AS (SELECT url, source, CASE WHEN starts_with(source, 'newsapi') THEN 0 WHEN starts_with(source, 'gnews') THEN 1 ELSE 2 END AS priority, concat_ws('|', id, cast(epoch(loaded_at) AS BIGINT), coalesce(summary, '')) AS o FROM news_signal WHERE url IS NOT NULL AND url <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, o) AS k FROM p) SELECT url, source, priority FROM f WHERE k = 1 ORDER BY priority, o LIMIT 100",
    "source_fallback": f"WITH {NEWS} SELECT source, count(*) AS n, 'fallback' AS \"case\" FROM n WHERE starts_with(source, 'rss:') GROUP BY 1 UNION ALL SELECT source, count(*), 'first' FROM n WHERE starts_with(source, 'gnews') GROUP BY 1",
    "union_sources_keep_first": f"WITH {HOTELS} SELECT source, price_range IN ('Luxury', 'Mid-Range') AS upper, count(*) AS n FROM h WHERE source IN ('google_places', 'liteapi', 'tripdesk', 'lankastay') GROUP BY 1, 2",
    "recent_window": "WITH n AS (SELECT cast(epoch(loaded_at) AS BIGINT) AS s FROM news_signal) SELECT s // 86400 AS day, (s // 3600) % 24 AS hour, count(*) AS n FROM n WHERE s >= (SELECT max(s) FROM n) - 604800 GROUP BY 1, 2",
    "complete_items": "SELECT 'hotel' AS kind, count(*) AS n FROM hotel WHERE id IS NOT NULL AND name IS NOT NULL AND trim(name) <> '' AND lat <> 0 AND lng <> 0 UNION ALL SELECT 'news', count(*) FROM news_signal WHERE url <> '' AND title IS NOT NULL AND summary <> ''",
}
