"""Landed files of the feeds: rates, places, distance matrices, flow and incident payloads, RSS, annotator sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATES = (
    "data array<struct<hotelId:string,roomTypes:array<struct<roomTypeId:string,offerId:string,name:string,rateType:string,offerRetailRate:array<struct<amount:double>>,"
    "rates:array<struct<name:string,boardName:string,boardType:string,retailRate:struct<total:array<struct<amount:double>>>,cancellationPolicies:struct<refundableTag:string>>>>>>>,"
    "hotels array<struct<id:string,name:string,address:string,latitude:double,longitude:double,rating:double,stars:double,starRating:double,hotelDescription:string,amenities:array<string>,hotelFacilities:array<string>,facilities:array<string>>>"
)
MATRIX = "origins array<string>, destinations array<string>, rows array<struct<elements:array<struct<status:string,distance:struct<value:double>,duration:struct<value:double>,duration_in_traffic:struct<value:double>>>>>"
INCIDENTS = (
    "incidents array<struct<geometry:struct<coordinates:array<array<double>>>,properties:struct<id:string,iconCategory:int,magnitudeOfDelay:int,events:array<struct<description:string>>,"
    "startTime:string,endTime:string,`from`:string,`to`:string,delay:int>>>"
)
#: Incident categories and delay magnitudes of the traffic feed.
CATEGORIES = {
    0: "UNKNOWN", 1: "ACCIDENT", 2: "FOG", 3: "DANGEROUS_CONDITIONS", 4: "RAIN", 5: "ICE", 6: "JAM", 7: "LANE_CLOSED", 8: "ROAD_CLOSURE", 9: "ROAD_WORKS",
    10: "WIND", 11: "FLOODING", 14: "BROKEN_DOWN_VEHICLE",
}
MAGNITUDES = {0: "unknown", 1: "light", 2: "moderate", 3: "heavy", 4: "heavy"}


def lookup(values: dict, key: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def severity(ratio: Column, free: Column) -> Column:
    """Class of a speed ratio: below 0.3 heavy, below 0.7 moderate, else light; unknown without a free speed."""
    return F.when(free.isNull() | (free <= 0), "unknown").when(ratio < 0.3, "heavy").when(ratio < 0.7, "moderate").otherwise("light")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """One row per hotel and room offer: ``hotel_id, room_id, name, price, board, refundable``; unpriced offers are dropped.

    A room's own name comes before that of its first rate (at most 200 characters, else "Room"), its type id before
    the offer's.
    """
    raw = spark.read.schema(RATES).json(path, multiLine=True)
    rooms = raw.select(F.explode("data").alias("d")).select(F.col("d.hotelId").alias("hotel_id"), F.posexplode("d.roomTypes").alias("at", "r"))
    price = F.coalesce(F.nullif(F.get("r.offerRetailRate", F.lit(0))["amount"], F.lit(0.0)), F.get(F.get("r.rates", F.lit(0))["retailRate"]["total"], F.lit(0))["amount"])
    first = F.get("r.rates", F.lit(0))
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    return rooms.select(
        "hotel_id", F.concat_ws(":", "hotel_id", some(F.col("r.roomTypeId"), F.col("r.offerId"))).alias("room_id"), F.substring(F.coalesce(some(F.col("r.name"), first["name"]), F.lit("Room")), 1, 200).alias("name"), price.alias("price"),
        some(first["boardName"], first["boardType"]).alias("board"), F.coalesce(first["cancellationPolicies"]["refundableTag"] == "RFN", F.lit(False)).alias("refundable"),
    ).where((F.col("price") > 0) & F.col("hotel_id").isNotNull())


#: Amenities that every hotel of the rates feed has.
RATE_DEFAULTS = ["Air Conditioning", "24h Front Desk"]


def read_rate_hotels(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, address, lat, lng, rating, star_rating, description, amenities`` of the hotels of a rates payload, one row per id."""
    h = spark.read.schema(RATES).json(path, multiLine=True).select(F.explode("hotels").alias("h")).select("h.*").where(F.col("id").isNotNull())
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    listed = F.coalesce(some("amenities"), some("hotelFacilities"), some("facilities"), F.array().cast("array<string>"))
    named = F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(listed, F.array(*map(F.lit, RATE_DEFAULTS))), lambda x: F.trim(x)), lambda x: x != "")))
    rows = h.select("id", "name", "address", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), halved_rating(F.col("rating")).alias("rating"), F.coalesce("stars", "starRating").alias("star_rating"), F.col("hotelDescription").alias("description"), named.alias("amenities"))
    return rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("r")).select("id", "r.*")


def cheapest_rooms(rooms: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` cheapest rooms of each hotel (a top-k report)."""
    order = Window.partitionBy("hotel_id").orderBy("price", "room_id")
    return rooms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rate_rollup(rooms: DataFrame, nights: int = 1, k: int = 5) -> DataFrame:
    """Per hotel, over its ``k`` cheapest rooms, the least price a night, whether any room is refundable, and the sorted distinct boards."""
    kept = cheapest_rooms(rooms, k)
    return kept.groupBy("hotel_id").agg((F.min("price") / nights).alias("price"), F.bool_or(F.coalesce("refundable", F.lit(False))).alias("refundable"), F.array_sort(F.collect_set("board")).alias("boards"))


PLACES = "status string, results array<struct<place_id:string,name:string,rating:double,formatted_address:string,types:array<string>,geometry:struct<location:struct<lat:double,lng:double>>>>"
DETAILS = "result struct<place_id:string,name:string,formatted_address:string,formatted_phone_number:string,website:string,rating:double,user_ratings_total:bigint,price_level:int,geometry:struct<location:struct<lat:double,lng:double>>,types:array<string>,editorial_summary:struct<overview:string>>"
ARTICLES = "status string, articles array<struct<title:string,description:string,url:string,publishedAt:string,source:struct<name:string>>>"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, rating, types, address, lat, lng`` of landed pages of a place search; pages whose status is not OK are left out."""
    p = spark.read.schema(PLACES).json(path, multiLine=True).where(F.col("status") == "OK").select(F.explode("results").alias("p")).select("p.*")
    return p.where(F.col("place_id").isNotNull()).select(F.col("place_id").alias("id"), "name", "rating", "types", F.col("formatted_address").alias("address"), F.col("geometry.location.lat").alias("lat"), F.col("geometry.location.lng").alias("lng"))


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Landed details of places, one row per file that has a result: what ``read_places`` gives, and phone, website and summary."""
    r = spark.read.schema(DETAILS).json(path, multiLine=True).where(F.col("result.place_id").isNotNull()).select("result.*")
    return r.select(F.col("place_id").alias("id"), "name", "rating", "types", F.col("formatted_address").alias("address"), F.col("geometry.location.lat").alias("lat"), F.col("geometry.location.lng").alias("lng"), F.col("formatted_phone_number").alias("phone"), "website", F.col("editorial_summary.overview").alias("description"))


def read_articles(spark: SparkSession, path: str, provider: str, now: Column | None = None) -> DataFrame:
    """``id, title, summary, published_at, url, source`` of landed pages of a news or headline feed.

    Pages with a status other than ok and articles without a url are left out; an article without a time gets that of
    reading. The source is ``provider:name``. Repeats stay: ``first_per_url`` keeps one.
    """
    a = spark.read.schema(ARTICLES).json(path, multiLine=True).where(F.coalesce("status", F.lit("ok")) == "ok").select(F.explode("articles").alias("a")).select("a.*").where(F.coalesce("url", F.lit("")) != "")
    read_at = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return a.select(F.md5("url").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("summary"), F.coalesce("publishedAt", read_at).alias("published_at"), "url", F.concat(F.lit(f"{provider}:"), F.coalesce("source.name", F.lit("unknown"))).alias("source"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``origin, destination, distance_km, duration_min, traffic_min`` of the elements of distance matrices that are OK."""
    raw = spark.read.schema(MATRIX).json(path, multiLine=True)
    each = raw.select("origins", "destinations", F.posexplode("rows").alias("i", "row")).select("origins", "destinations", "i", F.posexplode("row.elements").alias("j", "e")).where(F.col("e.status") == "OK")
    return each.select(F.get("origins", F.col("i")).alias("origin"), F.get("destinations", F.col("j")).alias("destination"), (F.col("e.distance.value") / 1000).alias("distance_km"), (F.col("e.duration.value") / 60).alias("duration_min"), (F.col("e.duration_in_traffic.value") / 60).alias("traffic_min"))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of the traffic feed with category, severity, title and first coordinate; unknown positions are 0.0."""
    p = spark.read.schema(INCIDENTS).json(path, multiLine=True).select(F.explode("incidents").alias("i")).select("i.geometry.coordinates", "i.properties.*")
    point = F.get("coordinates", F.lit(0))
    kind = lookup(CATEGORIES, F.col("iconCategory"), "UNKNOWN")
    where = F.concat_ws(" to ", "from", "to")
    return p.where(F.col("id").isNotNull()).select(
        "id", F.regexp_replace(F.concat_ws(": ", kind, F.when(where != "", where)), r"^[: ]+|[: ]+$", "").alias("title"), kind.alias("incident_type"), lookup(MAGNITUDES, F.col("magnitudeOfDelay"), "unknown").alias("severity"),
        F.get("events", F.lit(0))["description"].alias("description"), F.coalesce(F.get(point, F.lit(1)), F.lit(0.0)).alias("lat"), F.coalesce(F.get(point, F.lit(0)), F.lit(0.0)).alias("lng"),
        F.col("startTime").alias("start_time"), F.col("endTime").alias("end_time"), F.col("delay").alias("delay_seconds"),
    )


def read_rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``id, title, summary, published_at, url, source`` of RSS items that have a link."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return items.where(F.col("link").isNotNull() & (F.trim("link") != "")).select(F.md5("link").alias("id"), "title", F.substring("description", 1, 500).alias("summary"), F.col("pubDate").alias("published_at"), F.col("link").alias("url"), F.lit(source).alias("source"))


def read_sheets(spark: SparkSession, glob: str) -> DataFrame:
    """``query_id, hotel_id, annotator, score`` of annotator sheets; blank scores are null, others than 0, 1, 2 raise an error."""
    raw = spark.read.csv(glob, header=True).withColumn("annotator", F.regexp_extract(F.input_file_name(), r"annotator_([^/]+)\.csv$", 1))
    score = F.when(F.trim("relevance") == "", None).otherwise(F.trim("relevance"))
    checked = F.when(score.isNull() | score.isin("0", "1", "2"), score.cast("double")).otherwise(F.raise_error(F.concat(F.lit("no such score: "), score)).cast("double"))
    return raw.select("query_id", "hotel_id", "annotator", checked.alias("score"))


def union_or_fallback(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """``first``, or ``fallback`` where it is empty, as one plan without looking at the data on the driver."""
    some = first.limit(1).select(F.lit(1).alias("__one"))  # at most one row
    return first.unionByName(fallback.withColumn("__one", F.lit(1)).join(F.broadcast(some), "__one", "left_anti").drop("__one"), allowMissingColumns=True)


def first_per_url(items: DataFrame, priority: str, ordinal: str, most: int | None = None) -> DataFrame:
    """Items with a url, the first per url by priority and ordinal; at most ``most`` in that order where given."""
    order = [F.col(priority), F.col(ordinal)]
    once = items.where(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("__k", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where(F.col("__k") == 1).drop("__k")
    return once if most is None else once.orderBy(*order).limit(most)


QUERYSET = "description string, city string, k int, queries array<struct<id:string,question:string,category:string,gold:struct<max_price:double,min_price:double,min_rating:double,min_star:int,max_travel_time:double,required_amenities:array<string>>>>"
#: Amenities that a map service implies for every place of lodging, and those of its place types.
PLACE_DEFAULTS = ["wifi", "parking", "restaurant"]
PLACE_TYPES = {"spa": "spa", "gym": "gym", "restaurant": "restaurant", "bar": "bar"}


def read_queryset(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, question, category, city, k`` and the gold bounds (null: no bound) of an evaluation set."""
    raw = spark.read.schema(QUERYSET).json(path, multiLine=True)
    return raw.select("city", "k", F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), "q.question", "q.category", "city", "k", "q.gold.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, item`` of human gold (a JSON map of lists under ``relevant``); a null list is no gold."""
    return spark.read.schema("relevant map<string,array<string>>").json(path, multiLine=True).select(F.explode("relevant").alias("query_id", "items")).select("query_id", F.explode("items").alias("item"))


def resolved_gold(human: DataFrame, rules: DataFrame) -> DataFrame:
    """Gold with ``gold_source``: human labels supersede the rules of a query as a whole."""
    kept = rules.join(human.select("query_id").distinct(), "query_id", "left_anti")
    return human.withColumn("gold_source", F.lit("human")).unionByName(kept.withColumn("gold_source", F.lit("rules")))


def with_metadata(rows: DataFrame, hotels: DataFrame, key: str = "hotel_id") -> DataFrame:
    """``rows`` beside the hotels' metadata, null where a hotel has none."""
    return rows.join(hotels.withColumnRenamed("id", key).dropDuplicates([key]), key, "left")


def route_signals(distances: DataFrame) -> DataFrame:
    """Signals made of route times (``origin, destination, duration_min, traffic_min, ts``): ratio, severity and delay.

    Routes without a time in traffic give none. The id holds the route and the hour, so one signal per route and hour
    survives an upsert.
    """
    known = distances.where((F.col("traffic_min") > 0) & F.col("duration_min").isNotNull())
    ratio = F.col("duration_min") / F.col("traffic_min")
    return known.select(
        F.md5(F.concat_ws("|", "origin", "destination", F.substring("ts", 1, 13))).alias("id"), F.col("destination").alias("hotel_id"), F.concat_ws(" to ", "origin", "destination").alias("location_name"), "ts",
        ratio.alias("congestion_ratio"), severity(ratio, F.lit(1.0)).alias("severity"), F.greatest(F.lit(0.0), F.col("traffic_min") - F.col("duration_min")).alias("eta_change_min"),
    )


def normalise_places(places: DataFrame) -> DataFrame:
    """Places (``id, name, rating, types``) as hotels: unknown rating 0.0, amenities of the types and the defaults, estimated price."""
    implied = F.array_compact(F.transform("types", lambda x: F.try_element_at(F.create_map(*[F.lit(v) for kv in PLACE_TYPES.items() for v in kv]), x)))
    return places.where(F.col("id").isNotNull()).select("id", "name", F.coalesce("rating", F.lit(0.0)).alias("rating"), F.array_sort(F.array_distinct(F.concat(F.coalesce(implied, F.array().cast("array<string>")), F.array(*map(F.lit, PLACE_DEFAULTS))))).alias("amenities"), F.lit(True).alias("price_estimated"))


def halved_rating(rating: Column) -> Column:
    """A rating over 5 is out of ten."""
    return F.when(rating > 5, rating / 2).otherwise(rating)
