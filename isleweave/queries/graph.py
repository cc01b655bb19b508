"""Nodes, edges, upserts, expiry, neighbourhoods and city statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_km
from ..functions.text import island_city
from ..operators import graph as g
from ..operators.proximity import near_first, near_links, near_pairs, near_spots, near_sums, near_totals
from ..operators.scoring import half_up
from ..plans.lineage import cut
from ..sources.landed import severity
from ..sources.tables import table
from . import base
from .base import AFFECTED, AMENITY, ATTRACTION, EDGES, EVENTS, HOTELS, KNOWN, NEWS, SIGNALS, km_sql, rounded

LINK_KM = 5.0
#: Edges that ``network_first`` shows.
FIRST = 180


def node_upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return base.hotels(spark, folder).select("id", "name", "city", "source", F.unix_seconds("loaded_at").alias("loaded_s"))


def node_merge_batches(spark: SparkSession, folder: str) -> DataFrame:
    """News merged in two batches (before and after mid 2025) is as if merged at once."""
    rows = table(spark, folder, "news_signal").withColumn("seq", F.concat_ws("|", F.unix_seconds("loaded_at"), F.coalesce("summary", F.lit("")), F.coalesce("published_at", F.lit(""))))
    early = F.unix_seconds("loaded_at") < 1_748_736_000
    old = g.merge_nodes(rows.limit(0), rows.where(early), ["url"], "seq")
    return g.merge_nodes(old, rows.where(~early), ["url"], "seq").select("url", "title", F.length("seq").alias("seq_length"))


def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Amenity dimension: seeded categories stay, amenities met in descriptions are added as General."""
    seed = spark.createDataFrame([(a, "Comfort") for a in ("pool", "spa", "gym")], "name string, category string")
    met = base.hotel_amenities(base.hotels(spark, folder)).select(F.col("dst").alias("name"), F.lit("General").alias("category")).distinct()
    return g.insert_absent(seed, met, ["name"])


def edge_upsert_semi(spark: SparkSession, folder: str) -> DataFrame:
    s = base.signals(spark, folder)
    batch = s.where(F.col("hotel_id").isNotNull()).select(F.col("hotel_id").alias("src"), F.col("id").alias("dst"), "severity", F.col("signal_ts").alias("seq"))
    return g.merge_edges(None, batch, base.hotels(spark, folder), s, "seq").select("src", "dst", "severity")


def edge_property_update(spark: SparkSession, folder: str) -> DataFrame:
    """LOCATED_IN edges with the mean delay of the hotel's route signals; edges without signals keep their default 0.5."""
    h = base.hotels(spark, folder).where(F.col("city").isNotNull()).select(F.col("id").alias("src"), F.col("city").alias("dst"), F.lit(0.5).alias("delay_min"))
    delays = base.signals(spark, folder).where(F.col("hotel_id").isNotNull()).groupBy(F.col("hotel_id").alias("src")).agg(half_up(F.avg("eta_change_min"), 4).alias("delay_min"))
    return g.update_edges(h, delays, ["src"], ["delay_min"]).select("src", "dst", "delay_min")


def ttl_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of the last 30 days of the table, and how many edges they keep."""
    s = base.signals(spark, folder).withColumn("ts", F.try_to_timestamp("signal_ts"))
    left = g.unexpired(s, "ts", 24 * 30)
    edges = s.where(F.col("hotel_id").isNotNull()).select(F.col("hotel_id").alias("src"), F.col("id").alias("dst"))
    kept = g.cascade(edges, left, "dst")
    return left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("signals").alias("what"), "n").unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "n"))


def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that more than one row holds, per table before merging."""
    parts = [table(spark, folder, t).groupBy(k).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t, k in (("hotel", "id"), ("news_signal", "url"), ("graph_event", "id"), ("traffic_signal", "id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def graph_overview_labels(spark: SparkSession, folder: str) -> DataFrame:
    t = {"Hotel": base.hotels(spark, folder), "TrafficSignal": base.signals(spark, folder), "Event": base.events(spark, folder), "NewsSignal": base.news(spark, folder), "City": table(spark, folder, "city")}
    return g.label_counts(t, "label")


def graph_overview_rels(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    return base.graph_counts(spark, folder)[1] if whole else g.label_counts(base.edges(spark, folder, whole), "type")


def edge_list(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    return base.typed_edges(spark, folder, whole)


def graph_network(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    return base.degrees(spark, folder) if whole else g.network_nodes(base.typed_edges(spark, folder, whole))


def node_neighbours(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """All neighbours of hotels counted, the first 40 shown."""
    if whole:
        return _whole_neighbours(spark, folder)
    d = g.node_details(base.typed_edges(spark, folder, whole)).join(base.hotels(spark, folder).select(F.col("id").alias("node")), "node", "left_semi")
    return d.select("node", "total", F.array_join(F.transform("neighbours", lambda x: F.concat_ws(">", x["type"], x["neighbour"])), ";").alias("shown"))


def _whole_neighbours(spark: SparkSession, folder: str, limit: int = 40) -> DataFrame:
    """Totals are degrees; of the links by distance and by keyword only those that may be among the first are made."""
    h, s, e, n = (f(spark, folder) for f in (base.hotels, base.signals, base.events, base.news))
    cities, ids = table(spark, folder, "city"), h.select(F.col("id").alias("node"))
    pairs = lambda d: d.select(F.col("left_id").alias("src"), F.inline(F.transform("ids", lambda x: F.struct(x.alias("dst")))))
    named = base.keyword_events(e, n, cities).select("dst").orderBy("dst").limit(limit)
    affected = pairs(near_first(h, e, base.WHOLE_KM, limit)).unionByName(base.keyword_hotels(h, cities).crossJoin(F.broadcast(named))).distinct()
    affected = cut(affected.select("src", "dst"))
    enough = affected.groupBy("src").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= limit).select(F.col("src").alias("id"))  # signals come after events
    signals = pairs(near_first(h.join(enough, "id", "left_anti"), base.points(s), base.WHOLE_KM, limit))
    listed = base.listed_edges(h, s, e, n)
    typed = lambda d, k: d.select("src", "dst", F.lit(k).alias("type"))
    mine = lambda d: d.join(h.select("id"), "id", "left_semi")  # hotels whose id an event or a signal has too
    back = typed(base.has_signal(h, mine(base.points(s))), "HAS_SIGNAL").unionByName(typed(base.affected_by_whole(h, mine(e), n, cities), "AFFECTED_BY"))
    ends = g.both_directions(reduce(DataFrame.unionByName, [typed(d, k) for k, d in listed.items()])).unionByName(g.both_directions(back).where(F.col("direction") == "in"))
    out = typed(affected, "AFFECTED_BY").unionByName(typed(signals, "HAS_SIGNAL"))
    ends = ends.join(ids, "node", "left_semi").unionByName(g.both_directions(out).where(F.col("direction") == "out"))
    first = F.row_number().over(Window.partitionBy("node").orderBy("type", "neighbour", "direction"))
    shown = ends.withColumn("k", first).where(F.col("k") <= limit).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(">", "type", "neighbour").alias("x")))).alias("l"))
    total = base.degrees(spark, folder).withColumnsRenamed({"id": "node", "degree": "total"})
    return total.join(shown, "node").select("node", "total", F.array_join("l.x", ";").alias("shown"))


def hotel_city_join(spark: SparkSession, folder: str) -> DataFrame:
    h, c = base.hotels(spark, folder), table(spark, folder, "city")
    return h.join(c, F.lower(h["city"]) == F.lower(c["name"])).select(h["id"], c["name"].alias("city"), "district", "province")


def candidate_pool(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """One row per hotel with its amenities, attractions, severities, worst delay and number of events."""
    h, s, e = (f(spark, folder) for f in (base.hotels, base.signals, base.events))
    listed = lambda d, name: d.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ";").alias(name))
    sig = base.signal_values(h, s, whole).select("id", F.array_join(F.array_sort("severities"), ";").alias("severities"), F.col("worst").alias("worst_delay"))
    ev = base.event_counts(h, e, *((base.news(spark, folder), table(spark, folder, "city")) if whole else ())).withColumnRenamed("events", "event_count")
    out = h.select("id", "name", "city", "rating").join(listed(base.hotel_amenities(h), "amenities"), "id", "left").join(listed(base.hotel_attractions(h), "attractions"), "id", "left").join(sig, "id", "left").join(ev, "id", "left")
    return out.select("id", "name", "city", "rating", *[F.coalesce(c, F.lit("")).alias(c) for c in ("amenities", "attractions", "severities")], "worst_delay", F.coalesce("event_count", F.lit(0)).alias("event_count"))


def event_news_chain(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    h, e, n = (f(spark, folder) for f in (base.hotels, base.events, base.news))
    if whole:
        return _whole_chain(h, e, n, table(spark, folder, "city"))
    near = base.affected_by(h, e, False).select(F.col("src").alias("hotel_id"), F.col("dst").alias("event_id"))
    chain = h.select(F.col("id").alias("hotel_id")).join(near, "hotel_id", "left").join(e.select(F.col("id").alias("event_id"), "news_url"), "event_id", "left").join(n.select(F.col("url").alias("news_url"), F.col("title").alias("news_title")), "news_url", "left")
    return chain.groupBy("hotel_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("news_title").alias("titles"), F.min("news_title").alias("first_title"))


def _whole_chain(h: DataFrame, e: DataFrame, n: DataFrame, cities: DataFrame) -> DataFrame:
    """The chain over events within 5 km and those by keyword; the latter are the same for all their hotels, so they are counted once.

    Events are counted without a row per pair. Only positions that have titles meet hotels, each title of a position once.
    """
    named = base.keyword_events(e, n, cities)
    titled = base.positioned(e).join(n.select(F.col("url").alias("news_url"), F.col("title").alias("news_title")), "news_url").where(F.col("news_title").isNotNull())
    titled = titled.groupBy("lat", "lng", "news_title").agg(F.min("id").alias("id"))
    titled = titled.join(named.select("news_title", F.lit(1).alias("old")).distinct(), "news_title", "left")
    met = near_links(h, titled, base.WHOLE_KM, [], ["news_title", "old"]).groupBy(F.col("left_id").alias("hotel_id")).agg(
        F.countDistinct("news_title").alias("titles"), F.countDistinct(F.when(F.col("old").isNull(), F.col("news_title"))).alias("new_titles"), F.min("news_title").alias("first"),
    )
    all_named = named.agg(F.countDistinct("news_title").alias("n_titles"), F.min("news_title").alias("n_first"))  # one row
    in_city = base.keyword_hotels(h, cities).withColumnRenamed("src", "hotel_id").crossJoin(all_named)
    counts = base.event_counts(h, e, n, cities).withColumnRenamed("id", "hotel_id")
    rows = h.select(F.col("id").alias("hotel_id")).join(counts, "hotel_id", "left").join(met, "hotel_id", "left").join(in_city, "hotel_id", "left")
    titles = F.when(F.col("n_titles").isNotNull(), F.coalesce("new_titles", F.lit(0)) + F.col("n_titles")).otherwise(F.coalesce("titles", F.lit(0)))
    return rows.select("hotel_id", F.coalesce("events", F.lit(0)).alias("events"), titles.alias("titles"), F.least("first", "n_first").alias("first_title"))


def radius_link_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Point signals within 5 km of each hotel, counted."""
    near = near_sums(base.hotels(spark, folder), base.spots(base.points(base.signals(spark, folder))), LINK_KM, ["n"], nearest=True)
    return near.select(F.col("left_id").alias("hotel_id"), F.col("n").alias("signals"), half_up(F.col("km"), 6).alias("nearest_km"))


def radius_link_incidents(spark: SparkSession, folder: str) -> DataFrame:
    inc = base.events(spark, folder).where(F.col("event_type") == "traffic_incident")
    return near_pairs(base.hotels(spark, folder), inc, LINK_KM).select(F.col("left_id").alias("hotel_id"), F.col("right_id").alias("event_id"), half_up(F.col("km"), 6).alias("km"))


def route_signal_link(spark: SparkSession, folder: str) -> DataFrame:
    """Route signals by their hotel id, point signals by distance: how many of each kind are linked."""
    h, s = base.hotels(spark, folder), base.signals(spark, folder)
    routes = base.routes(h, s).select(F.lit("route").alias("kind"), F.lit(1).alias("signals"), F.lit(1).alias("links"))  # a signal has one hotel
    spots = base.spots(base.points(s))
    near = spots.withColumnRenamed("n", "signals").join(near_totals(spots, base.spots(h), LINK_KM, ["n"]), ["lat", "lng"])  # a row per position
    points = near.select(F.lit("point").alias("kind"), "signals", (F.col("signals") * F.col("n")).alias("links"))
    return routes.unionByName(points).groupBy("kind").agg(F.sum("signals").alias("signals"), F.sum("links").alias("links"))


def nearest_city(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every hotel from every city, reduced to the nearest; cities are a fixed table of 24 rows."""
    h = base.positioned(base.hotels(spark, folder)).select("id", "lat", "lng", F.lit(1).alias("one"))
    c = base.positioned(table(spark, folder, "city")).select(F.col("name").alias("city"), F.col("lat").alias("clat"), F.col("lng").alias("clng"), F.lit(1).alias("one"))
    km = half_up(distance_km(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng")), 6)
    return h.join(F.broadcast(c), "one").groupBy("id").agg(F.min(F.struct(km.alias("km"), "city")).alias("m")).select("id", "m.city", "m.km")


def orphan_city_anti(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "city").join(base.hotels(spark, folder).select(F.col("city").alias("name")), "name", "left_anti").select("name", "district")


def city_stats(spark: SparkSession, folder: str) -> DataFrame:
    h = base.hotels(spark, folder)
    return h.groupBy("city").agg(
        F.count(F.lit(1)).alias("hotels"), half_up(F.coalesce(F.avg("rating"), F.lit(0.0)), 4).alias("avg_rating"), F.coalesce(F.min("star_rating"), F.lit(0.0)).alias("min_star"),
        F.coalesce(F.max("star_rating"), F.lit(0.0)).alias("max_star"), F.array_join(F.array_sort(F.collect_set("price_range")), ";").alias("ranges"),
    )


def hotels_per_city(spark: SparkSession, folder: str) -> DataFrame:
    return base.hotels(spark, folder).groupBy("city").count().select("city", F.col("count").alias("n"))


def traffic_status_global(spark: SparkSession, folder: str) -> DataFrame:
    n = base.signals(spark, folder).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).scalar()
    return n.select("severity", "n", F.floor(F.col("n") * 100 / F.greatest(total, F.lit(1)) + 0.5).alias("percent"))


def traffic_status_city(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Route signals (for ``whole`` point signals too) of each city's hotels by severity, each signal once."""
    h, s = base.hotels(spark, folder), base.signals(spark, folder)
    per = s.where(F.col("hotel_id").isNotNull()).join(h.select(F.col("id").alias("hotel_id"), "city"), "hotel_id").dropDuplicates(["id", "city"])
    n = lambda v: F.count(F.when(F.col("severity") == v, 1)).alias(v)
    routes = per.groupBy("city").agg(F.count(F.lit(1)).alias("total"), n("heavy"), n("moderate"), n("light"), n("unknown"))
    if not whole:
        return routes
    counts = ("total", "heavy", "moderate", "light", "unknown")
    met = near_spots(h, base.point_spots(s), base.WHOLE_KM, ["city"]).groupBy("city", "lat", "lng").agg(*[F.max(c).alias(c) for c in counts])  # each spot once per city
    return routes.unionByName(met.select("city", *counts)).groupBy("city").agg(*[F.sum(c).alias(c) for c in counts])


def travel_coverage(spark: SparkSession, folder: str) -> DataFrame:
    s = base.signals(spark, folder)
    return s.where(F.col("current_speed").isNotNull()).agg(F.count(F.lit(1)).alias("n"), half_up(F.coalesce(F.avg("current_speed"), F.lit(0.0)), 1).alias("speed"), half_up(F.coalesce(F.avg("free_flow_speed"), F.lit(0.0)), 1).alias("free"), half_up(F.coalesce(F.avg("congestion_ratio"), F.lit(0.0)), 3).alias("ratio"))


def incident_count(spark: SparkSession, folder: str) -> DataFrame:
    return base.events(spark, folder).where(F.col("event_type") == "traffic_incident").groupBy("incident_type").agg(F.count(F.lit(1)).alias("n"))


def city_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The city's own position, else the mean of its hotels' known latitudes and longitudes."""
    some = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    mean = base.hotels(spark, folder).groupBy(F.col("city").alias("name")).agg(some("lat").alias("mlat"), some("lng").alias("mlng"))
    c = table(spark, folder, "city").join(mean, "name", "left")
    return c.select("name", half_up(F.coalesce("lat", "mlat"), 6).alias("lat"), half_up(F.coalesce("lng", "mlng"), 6).alias("lng"))


def bounding_box(spark: SparkSession, folder: str) -> DataFrame:
    h = base.positioned(base.hotels(spark, folder))
    edge = lambda f, c, d, n: half_up(f(c) + F.lit(d), 6).alias(n)
    return h.groupBy("city").agg(edge(F.min, "lat", -0.05, "south"), edge(F.max, "lat", 0.05, "north"), edge(F.min, "lng", -0.05, "west"), edge(F.max, "lng", 0.05, "east"))


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return g.duplicate_groups(base.hotels(spark, folder), {"name_key": F.lower(F.trim("name")), "city": F.col("city")})


def dedupe_keep_best(spark: SparkSession, folder: str) -> DataFrame:
    h = base.hotels(spark, folder)
    priced = F.coalesce(F.col("price_per_night_lkr") > 0, F.lit(False))
    order = [priced.desc(), (F.col("source") == "liteapi").desc(), F.col("id").asc()]
    return g.keep_best(h, [F.lower(F.trim("name")), F.col("city")], order).select("id", "kept")


def city_alias_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Written city names by the city they stand for: variants, and edges after the merge."""
    rows = table(spark, folder, "hotel").where(F.col("id").isNotNull()).select("id", "city_name", island_city(F.col("city_name")).alias("city"))
    return rows.groupBy("city").agg(F.countDistinct("city_name").alias("variants"), F.countDistinct("id").alias("edges"))


def city_alias_edges(spark: SparkSession, folder: str) -> DataFrame:
    """LOCATED_IN edges after every written city name is merged into the city it stands for."""
    rows = table(spark, folder, "hotel").where(F.col("id").isNotNull() & F.col("city_name").isNotNull())
    edges = rows.select(F.col("id").alias("src"), F.col("city_name").alias("dst")).distinct()
    return g.merge_aliases(rows.select(F.col("city_name").alias("name")).distinct(), edges, island_city(F.col("name")))[1]


def traffic_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct severities and places of each hotel's route signals, those without a severity left out."""
    s = base.signals(spark, folder).where(F.col("hotel_id").isNotNull())
    maps = g.collected_maps(s, "hotel_id", ["severity", "location_name"], "severity", "maps")
    return maps.select("hotel_id", F.array_join(F.transform("maps", lambda m: F.concat_ws("@", m["severity"], m["location_name"])), ";").alias("maps"))


def network_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first 180 edges by type and ends (a display limit).

    Types are taken in order until there are enough. The first 180 edges of a type belong to its first 180 sources at
    most, so that edges of hotels are made for those only.
    """
    h, s, e, n = (f(spark, folder) for f in (base.hotels, base.signals, base.events, base.news))
    cities, listed = table(spark, folder, "city"), base.listed_edges(h, s, e, n)
    first = lambda d: h.join(F.broadcast(d.select("id").distinct().orderBy("id").limit(FIRST)), "id", "left_semi")
    parts, found = [], 0
    for kind in sorted({*listed, "AFFECTED_BY"}):
        if kind == "AFFECTED_BY":
            edges = base.affected_by_whole(first(base.event_counts(h, e, n, cities).where(F.col("events") > 0)), e, n, cities)
        elif kind == "HAS_SIGNAL":
            near = near_sums(h, base.spots(base.points(s)), base.WHOLE_KM, ["n"]).select(F.col("left_id").alias("id"))
            edges = base.has_signal(first(near.unionByName(listed[kind].select(F.col("src").alias("id")))), s)
        else:
            edges = listed[kind]
        parts.append(cut(g.network(edges.select("src", "dst", F.lit(kind).alias("type")), limit=FIRST)))
        found += parts[-1].count()
        if found >= FIRST:
            break
    return g.network(reduce(DataFrame.unionByName, parts), limit=FIRST)


def severity_classify(spark: SparkSession, folder: str) -> DataFrame:
    s = base.signals(spark, folder)
    free, now = F.col("free_flow_speed"), F.col("current_speed")
    ratio = F.when(free.isNull() | (free <= 0), 1.0).otherwise(now / F.when(free > 0, free))
    delay = F.when((now > 0) & (free > 0), F.greatest(F.lit(0.0), (1 / F.when(now > 0, now) - 1 / F.when(free > 0, free)) * 60))
    return s.groupBy(severity(ratio, free).alias("class")).agg(F.count(F.lit(1)).alias("n"), half_up(F.max(ratio), 4).alias("max_ratio"), half_up(F.max(delay), 4).alias("max_delay"))


def hourly_signal_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """One signal per place and hour, the last one winning."""
    s = table(spark, folder, "traffic_signal").withColumn("hour", F.substring("signal_ts", 1, 13))
    last = F.max(F.struct("signal_ts", "id", "severity"))
    return s.groupBy("location_name", "hour").agg(last.alias("m"), F.count(F.lit(1)).alias("n")).select("location_name", "hour", "m.id", "m.severity", "n")


def clear_counts(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """What clearing the graph would delete."""
    nodes, edges = base.graph_counts(spark, folder) if whole else (graph_overview_labels(spark, folder), graph_overview_rels(spark, folder, whole))
    all_of = lambda d, k: d.agg(F.sum("n").alias("n")).select(F.lit(k).alias("what"), "n")
    return all_of(nodes, "nodes").unionByName(all_of(edges, "edges"))


def placeholder_fix(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated prices nulled out and flagged; other rows unchanged."""
    h = base.hotels(spark, folder)
    fake = F.coalesce("price_estimated", F.lit(False))
    return h.select("id", F.when(fake, None).otherwise(F.col("price_per_night_lkr")).alias("price"), fake.alias("nulled"))


QUERIES = {
    f.__name__: f
    for f in (
        node_upsert_latest, node_merge_batches, insert_if_absent, edge_upsert_semi, edge_property_update, ttl_cleanup, unique_keys, graph_overview_labels, graph_overview_rels, edge_list, graph_network,
        node_neighbours, hotel_city_join, candidate_pool, event_news_chain, radius_link_signals, radius_link_incidents, route_signal_link, nearest_city, orphan_city_anti, city_stats, hotels_per_city,
        traffic_status_global, traffic_status_city, travel_coverage, incident_count, city_centroid, bounding_box, duplicate_groups, dedupe_keep_best, city_alias_merge, city_alias_edges, traffic_maps, network_first, severity_classify,
        hourly_signal_upsert, clear_counts, placeholder_fix,
    )
}
#: Queries on links by distance and by keyword; their SQL is made of that of the nearer links.
WHOLE = (graph_overview_rels, edge_list, graph_network, node_neighbours, candidate_pool, event_news_chain, clear_counts, network_first, traffic_status_city)

_NEAR = f"SELECT h.id AS hotel_id, p.id AS other_id, {km_sql('h', 'p')} AS km FROM h JOIN p ON {KNOWN.format('h')} AND {KNOWN.format('p')} AND p.lat BETWEEN h.lat - 0.1 AND h.lat + 0.1 AND p.lng BETWEEN h.lng - 0.1 AND h.lng + 0.1 WHERE {km_sql('h', 'p')} <= {LINK_KM}e0"
_COUNT = "SELECT '{0}' AS {1}, count(*) AS n FROM {2}"
_LABELS = " UNION ALL ".join(_COUNT.format(a, "label", b) for a, b in (("Hotel", "h"), ("TrafficSignal", "s"), ("Event", "e"), ("NewsSignal", "n"), ("City", "city")))
_TYPES = "(VALUES ('LOCATED_IN'), ('HAS_AMENITY'), ('NEAR_ATTRACTION'), ('HAS_SIGNAL'), ('MENTIONED_IN'), ('AFFECTED_BY')) t(type)"
_MEET = "UNION ALL SELECT dst AS node, src AS neighbour, type, 'in' AS direction FROM edge"
SQL = {
    "node_upsert_latest": f"WITH {HOTELS} SELECT id, name, city, source, cast(epoch(loaded_at) AS BIGINT) AS loaded_s FROM h",
    "node_merge_batches": f"WITH {NEWS} SELECT url, title, length(concat_ws('|', cast(epoch(loaded_at) AS BIGINT), coalesce(summary, ''), coalesce(published_at, ''))) AS seq_length FROM n",
    "insert_if_absent": f"WITH {HOTELS}, {AMENITY} SELECT * FROM (VALUES ('pool', 'Comfort'), ('spa', 'Comfort'), ('gym', 'Comfort')) t(name, category) UNION ALL SELECT DISTINCT dst, 'General' FROM am WHERE dst NOT IN ('pool', 'spa', 'gym')",
    "edge_upsert_semi": f"WITH {HOTELS}, {SIGNALS} SELECT s.hotel_id AS src, s.id AS dst, s.severity FROM s SEMI JOIN h ON s.hotel_id = h.id",
    "edge_property_update": f"WITH {HOTELS}, {SIGNALS}, d AS (SELECT hotel_id, {rounded('avg(eta_change_min)', 4)} AS m FROM s WHERE hotel_id IS NOT NULL GROUP BY 1) SELECT h.id AS src, h.city AS dst, CASE WHEN d.hotel_id IS NULL THEN 0.5e0 ELSE d.m END AS delay_min FROM h LEFT JOIN d ON h.id = d.hotel_id WHERE h.city IS NOT NULL",
    "ttl_cleanup": f"WITH {SIGNALS}, t AS (SELECT id, hotel_id, try_cast(signal_ts AS TIMESTAMP) AS ts FROM s), k AS (SELECT * FROM t WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM t) - INTERVAL 720 HOUR) SELECT 'signals' AS what, count(*) AS n FROM k UNION ALL SELECT 'edges', count(hotel_id) FROM k",
    "unique_keys": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in (("hotel", "id"), ("news_signal", "url"), ("graph_event", "id"), ("traffic_signal", "id"))),
    "graph_overview_labels": f"WITH {HOTELS}, {SIGNALS}, {EVENTS}, {NEWS} {_LABELS}",
    "graph_overview_rels": f"WITH {EDGES} SELECT t.type, count(edge.type) AS n FROM {_TYPES} LEFT JOIN edge ON edge.type = t.type GROUP BY t.type",
    "edge_list": f"WITH {EDGES} SELECT src, dst, type FROM edge",
    "graph_network": f"WITH {EDGES}, b AS (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) SELECT node AS id, count(*) AS degree FROM b GROUP BY 1",
    "node_neighbours": f"WITH {EDGES}, b AS (SELECT src AS node, dst AS neighbour, type, 'out' AS direction FROM edge {_MEET}), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY type, neighbour, direction) AS k FROM b SEMI JOIN h ON b.node = h.id) SELECT node, count(*) AS total, string_agg(concat(type, '>', neighbour), ';' ORDER BY k) FILTER (WHERE k <= 40) AS shown FROM r GROUP BY node",
    "hotel_city_join": f"WITH {HOTELS} SELECT h.id, c.name AS city, c.district, c.province FROM h JOIN city c ON lower(h.city) = lower(c.name)",
    "candidate_pool": f"""WITH {HOTELS}, {SIGNALS}, {EVENTS}, {AMENITY}, {ATTRACTION}, {AFFECTED},
        a AS (SELECT src, string_agg(dst, ';' ORDER BY dst) AS v FROM am GROUP BY 1), t AS (SELECT src, string_agg(dst, ';' ORDER BY dst) AS v FROM att GROUP BY 1),
        g AS (SELECT hotel_id, string_agg(DISTINCT severity, ';' ORDER BY severity) AS v, max(eta_change_min) AS w FROM s WHERE hotel_id IS NOT NULL GROUP BY 1), x AS (SELECT src, count(DISTINCT dst) AS c FROM ab GROUP BY 1)
        SELECT h.id, h.name, h.city, h.rating, coalesce(a.v, '') AS amenities, coalesce(t.v, '') AS attractions, coalesce(g.v, '') AS severities, g.w AS worst_delay, coalesce(x.c, 0) AS event_count
        FROM h LEFT JOIN a ON a.src = h.id LEFT JOIN t ON t.src = h.id LEFT JOIN g ON g.hotel_id = h.id LEFT JOIN x ON x.src = h.id""",
    "event_news_chain": f"WITH {HOTELS}, {EVENTS}, {NEWS}, {AFFECTED} SELECT h.id AS hotel_id, count(DISTINCT ab.dst) AS events, count(DISTINCT n.title) AS titles, min(n.title) AS first_title FROM h LEFT JOIN ab ON ab.src = h.id LEFT JOIN e ON e.id = ab.dst LEFT JOIN n ON n.url = e.news_url GROUP BY 1",
    "radius_link_signals": f"WITH {HOTELS}, {SIGNALS}, p AS (SELECT * FROM s WHERE hotel_id IS NULL), r AS ({_NEAR}) SELECT hotel_id, count(*) AS signals, min({rounded('km', 6)}) AS nearest_km FROM r GROUP BY 1",
    "radius_link_incidents": f"WITH {HOTELS}, {EVENTS}, p AS (SELECT * FROM e WHERE event_type = 'traffic_incident'), r AS ({_NEAR}) SELECT hotel_id, other_id AS event_id, {rounded('km', 6)} AS km FROM r",
    "route_signal_link": f"WITH {HOTELS}, {SIGNALS}, p AS (SELECT * FROM s WHERE hotel_id IS NULL), r AS ({_NEAR}) SELECT 'point' AS kind, count(DISTINCT other_id) AS signals, count(*) AS links FROM r UNION ALL SELECT 'route', count(DISTINCT s.id), count(*) FROM s SEMI JOIN h ON s.hotel_id = h.id",
    "nearest_city": f"WITH {HOTELS}, d AS (SELECT h.id, c.name AS city, {rounded(km_sql('h', 'c'), 6)} AS km FROM h JOIN city c ON {KNOWN.format('h')} AND {KNOWN.format('c')}) SELECT id, city, km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, city) AS k FROM d) WHERE k = 1",
    "orphan_city_anti": f"WITH {HOTELS} SELECT c.name, c.district FROM city c ANTI JOIN h ON h.city = c.name",
    "city_stats": f"WITH {HOTELS} SELECT city, count(*) AS hotels, {rounded('coalesce(avg(rating), 0)', 4)} AS avg_rating, coalesce(min(star_rating), 0) AS min_star, coalesce(max(star_rating), 0) AS max_star, coalesce(string_agg(DISTINCT price_range, ';' ORDER BY price_range), '') AS ranges FROM h GROUP BY 1",
    "hotels_per_city": f"WITH {HOTELS} SELECT city, count(*) AS n FROM h GROUP BY 1",
    "traffic_status_global": f"WITH {SIGNALS} SELECT severity, count(*) AS n, cast(floor(count(*) * 100 / greatest(sum(count(*)) OVER (), 1) + 0.5e0) AS BIGINT) AS percent FROM s GROUP BY 1",
    "traffic_status_city": f"WITH {HOTELS}, {SIGNALS} SELECT h.city, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE s.severity = {v!r}) AS {v}' for v in ('heavy', 'moderate', 'light', 'unknown'))} FROM s JOIN h ON s.hotel_id = h.id GROUP BY 1",
    "travel_coverage": f"WITH {SIGNALS} SELECT count(*) AS n, {rounded('coalesce(avg(current_speed), 0)', 1)} AS speed, {rounded('coalesce(avg(free_flow_speed), 0)', 1)} AS free, {rounded('coalesce(avg(congestion_ratio), 0)', 3)} AS ratio FROM s WHERE current_speed IS NOT NULL",
    "incident_count": f"WITH {EVENTS} SELECT incident_type, count(*) AS n FROM e WHERE event_type = 'traffic_incident' GROUP BY 1",
    "city_centroid": f"WITH {HOTELS}, m AS (SELECT city, avg(lat) FILTER (WHERE lat <> 0) AS a, avg(lng) FILTER (WHERE lng <> 0) AS b FROM h GROUP BY 1) SELECT c.name, {rounded('coalesce(c.lat, m.a)', 6)} AS lat, {rounded('coalesce(c.lng, m.b)', 6)} AS lng FROM city c LEFT JOIN m ON m.city = c.name",
    "bounding_box": f"WITH {HOTELS} SELECT city, {rounded('min(lat) - 0.05e0', 6)} AS south, {rounded('max(lat) + 0.05e0', 6)} AS north, {rounded('min(lng) - 0.05e0', 6)} AS west, {rounded('max(lng) + 0.05e0', 6)} AS east FROM h WHERE {KNOWN.format('h')} GROUP BY 1",
    "duplicate_groups": f"WITH {HOTELS} SELECT lower(trim(name)) AS name_key, city, count(*) AS n, min(id) AS first_id FROM h GROUP BY 1, 2 HAVING count(*) > 1",
    "dedupe_keep_best": f"WITH {HOTELS} SELECT id, row_number() OVER (PARTITION BY lower(trim(name)), city ORDER BY coalesce(price_per_night_lkr > 0, false) DESC, source = 'liteapi' DESC, id) = 1 AS kept FROM h",
    "city_alias_merge": f"SELECT city, count(DISTINCT city_name) AS variants, count(DISTINCT id) AS edges FROM (SELECT id, city_name, {base.city_sql('city_name')} AS city FROM hotel WHERE id IS NOT NULL) GROUP BY 1",
    "city_alias_edges": f"SELECT DISTINCT id AS src, {base.city_sql('city_name')} AS dst FROM hotel WHERE id IS NOT NULL AND city_name IS NOT NULL",
    "traffic_maps": f"WITH {SIGNALS}, m AS (SELECT DISTINCT hotel_id, severity, location_name FROM s WHERE hotel_id IS NOT NULL) SELECT hotel_id, coalesce(string_agg(concat_ws('@', severity, location_name), ';' ORDER BY severity, location_name NULLS FIRST) FILTER (WHERE severity IS NOT NULL), '') AS maps FROM m GROUP BY 1",
    "network_first": f"WITH {EDGES} SELECT src, dst, type FROM edge ORDER BY type, src, dst LIMIT 180",
    "severity_classify": f"""WITH {SIGNALS}, r AS (SELECT free_flow_speed AS f, current_speed AS c, CASE WHEN free_flow_speed IS NULL OR free_flow_speed <= 0 THEN 1e0 ELSE current_speed / free_flow_speed END AS q FROM s)
        SELECT CASE WHEN f IS NULL OR f <= 0 THEN 'unknown' WHEN q < 0.3e0 THEN 'heavy' WHEN q < 0.7e0 THEN 'moderate' ELSE 'light' END AS class, count(*) AS n, {rounded('max(q)', 4)} AS max_ratio,
        {rounded('max(CASE WHEN c > 0 AND f > 0 THEN greatest(0e0, (1 / c - 1 / f) * 60) END)', 4)} AS max_delay FROM r GROUP BY 1""",
    "hourly_signal_upsert": "SELECT location_name, hour, id, severity, n FROM (SELECT location_name, substring(signal_ts, 1, 13) AS hour, id, severity, row_number() OVER (PARTITION BY location_name, substring(signal_ts, 1, 13) ORDER BY signal_ts DESC NULLS LAST, id DESC NULLS LAST, severity DESC NULLS LAST) AS k, count(*) OVER (PARTITION BY location_name, substring(signal_ts, 1, 13)) AS n FROM traffic_signal) WHERE k = 1",
    "clear_counts": f"WITH {EDGES} SELECT 'nodes' AS what, cast(sum(n) AS BIGINT) AS n FROM ({_LABELS}) UNION ALL SELECT 'edges', count(*) FROM edge",
    "placeholder_fix": f"WITH {HOTELS} SELECT id, CASE WHEN coalesce(price_estimated, false) THEN NULL ELSE price_per_night_lkr END AS price, coalesce(price_estimated, false) AS nulled FROM h",
}
SQL |= {f.__name__: base.whole_sql(SQL[f.__name__]) for f in WHOLE}
