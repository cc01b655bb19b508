"""Text functions, scoring, evaluation, graph tables, landed files and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from isleweave.functions import text as t
from isleweave.operators import evaluation as ev
from isleweave.operators import graph as g
from isleweave.operators import scoring as sc
from isleweave.plans.answer import Cache, answer
from isleweave.sources import landed, sinks
from isleweave.streaming import signals as st


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


CITIES = [
    ("Colombo", "Colombo"), ("colombo", "Colombo"), ("Colombo 03", "Colombo"), ("colombo 7", "Colombo"), ("Colombo, 00300", "Colombo"), ("Galle 80000", "Galle"), ("  Piliyandala  ", "Piliyandala"), ("Mt Lavinia", "Mount Lavinia"),
    ("mount-lavinia", "Mount Lavinia"), ("nuwara-eliya", "Nuwara Eliya"), ("NUWARA ELIYA", "Nuwara Eliya"), ("Kandy City", "Kandy"), ("trinco", "Trincomalee"), (None, None), ("", ""), ("matara", "Matara"),
]


@pytest.mark.parametrize("raw,want", CITIES)
def test_canonical_city(spark, raw, want):
    assert one(spark, t.canonical_city, raw) == want


def intent(spark, question):
    return one(spark, lambda c: t.intent(c, F.lit("Kolavara")), question)


def test_intents(spark):
    i = intent(spark, "hotels under 20,000 LKR")
    assert (i.max_price, i.min_price, i.city) == (20000.0, None, "Kolavara")
    i = intent(spark, "something between Rs 5000 and 12000")
    assert (i.min_price, i.max_price) == (5000.0, 12000.0)
    i = intent(spark, "4 star hotels with rating above 4.2")
    assert (i.min_star, i.min_rating) == (4, 4.2)
    i = intent(spark, "top-rated hotels")
    assert (i.min_rating, i.sort) == (4.0, "highest_rated")
    assert intent(spark, "budget friendly hotels").sort == "cheapest"
    i = intent(spark, "a quiet peaceful hotel")
    assert (i.proximity, i.avoid_traffic, i.sort) == ("far", True, "most_accessible")
    i = intent(spark, "easy access and stable eta")
    assert i.avoid_traffic and i.sort == "most_accessible"
    assert intent(spark, "accessible with good transport links").access == "high"
    assert set(intent(spark, "with pool and wifi").amenities) == {"pool", "wifi"}
    assert "beach" in intent(spark, "near the beach").attractions
    assert intent(spark, None).sort == "best_overall"


def test_places_in_texts(spark):
    row = spark.createDataFrame([("12 Main Road, Fort, Colombo 01, Sri Lanka", "Colombo", "Near the Galle Fort, 5 minutes from City Park. near nothing")], "a string, c string, d string")
    got = row.select(t.neighbourhoods(F.col("a"), F.col("c")).alias("n"), t.landmarks(F.col("d")).alias("l"), t.attraction_kinds(F.col("d")).alias("k")).first()
    assert got.n == ["12 Main Road", "Fort"] and got.l == ["City Park"] and {"Park", "Fort"} <= set(got.k)
    assert one(spark, t.url_host, "https://a.example/b/c") == "a.example" and one(spark, t.url_host, "nothing") is None
    assert json.loads(one(spark, t.unfenced, '```json\n{"a": 1}\n```')) == {"a": 1}


def test_weights():
    w = sc.normalised(sc.WEIGHTS)
    assert math.isclose(sum(w.values()), 1) and sc.normalised(dict.fromkeys(sc.WEIGHTS, 0.0)) == sc.WEIGHTS


def test_personas():
    seek, quiet = sc.persona_weights("Event_Seeker", True), sc.persona_weights("quiet_seeker", False)
    assert math.isclose(sum(seek.values()), 1) and seek["event"] > 0 and quiet["event"] == 0 and sc.persona_weights("x", True) is None and sc.persona_weights(None, True) is None
    assert max(sc.persona_weights("budget_traveler", True), key=sc.persona_weights("budget_traveler", True).get) == "economic"


def test_more_landed_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"city": "C", "k": 5, "queries": [{"id": "q1", "question": "?", "category": "c", "gold": {"max_price": 5}}]}))
    q = landed.read_queryset(spark, str(tmp_path / "q.json")).first()
    assert (q.query_id, q.k, q.max_price, q.min_star) == ("q1", 5, 5.0, None)
    (tmp_path / "g.json").write_text(json.dumps({"relevant": {"q1": ["a"], "q2": None}}))
    human = landed.read_gold(spark, str(tmp_path / "g.json"))
    rules = spark.createDataFrame([("q1", "z"), ("q2", "y")], "query_id string, item string")
    assert {tuple(r) for r in landed.resolved_gold(human, rules).collect()} == {("q1", "a", "human"), ("q2", "y", "rules")}
    d = spark.createDataFrame([("o", "h", 10.0, 40.0, "2025-01-01T10:11:12"), ("o", "i", 10.0, None, "2025-01-01T10:11:12")], "origin string, destination string, duration_min double, traffic_min double, ts string")
    s = landed.route_signals(d).collect()
    assert [(r.hotel_id, r.severity, r.eta_change_min) for r in s] == [("h", "heavy", 30.0)]
    p = landed.normalise_places(spark.createDataFrame([("a", "n", None, ["spa", "lodging"]), (None, "n", 1.0, None), ("b", "n", 4.0, None)], "id string, name string, rating double, types array<string>"))
    assert {r.id: (r.rating, r.amenities) for r in p.collect()} == {"a": (0.0, ["parking", "restaurant", "spa", "wifi"]), "b": (4.0, ["parking", "restaurant", "wifi"])}
    rooms = spark.createDataFrame([("h",), ("x",)], "hotel_id string")
    assert {(r.hotel_id, r.name) for r in landed.with_metadata(rooms, spark.createDataFrame([("h", "H")], "id string, name string")).collect()} == {("h", "H"), ("x", None)}


def test_scores(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("b", 3.0, None), ("c", None, 2.0)], "id string, v double, w double").withColumn("g", F.lit(1))
    only = F.when(F.col("v") == 1, F.col("v"))
    ranged, ends = sc.with_ranges(rows, ["g"], {"v": F.col("v"), "only": only}), lambda k: (F.col(f"low_{k}"), F.col(f"high_{k}"))
    got = {r.id: (r.s, r.one) for r in ranged.select("id", sc.lower_is_better(F.col("v"), *ends("v")).alias("s"), sc.lower_is_better(only, *ends("only")).alias("one")).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, 0.5), "c": (0.5, 0.5)}
    far = {r.id: (r.s, r.a) for r in ranged.select("id", sc.event_affinity(F.col("v"), 1.5, "seek", *ends("v")).alias("s"), sc.event_affinity(F.col("v"), 1.5, "avoid", *ends("v")).alias("a")).collect()}
    assert far == {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.5, 0.5)}
    kept = sc.relaxed(rows, F.col("v") > 5, ["g"]).collect()
    assert len(kept) == 3 and all(r.filters_relaxed for r in kept)
    assert [r.id for r in rows.where(sc.passes_softly(F.col("v"), least=2)).collect()] == ["b", "c"] and [r.id for r in rows.where(sc.passes_strictly(F.col("v"), least=2)).collect()] == ["b"]
    assert rows.select(sc.half_up(F.lit(1.00005), 4).alias("x")).first().x == 1.0001


METRICS = [({"a", "b", "c"}, 3, (1, 1, 1, 1)), ({"x"}, 5, (0, 0, 0, 0)), (set(), 5, (0, 0, 0, 0)), ({"b", "d"}, 2, (0.5, 0.5, None, 0.5)), ({"a"}, 0, (0, 0, 0, 1))]


@pytest.mark.parametrize("relevant,k,want", METRICS)
def test_metrics(spark, relevant, k, want):
    ranked = spark.createDataFrame([("s", "q", i + 1, x) for i, x in enumerate("abcde")], "system string, query_id string, rank bigint, item string")
    gold = spark.createDataFrame([("q", x) for x in relevant], "query_id string, item string")
    r = ev.ranking_metrics(ranked, gold, k).first()
    for name, value in zip(("precision", "recall", "ndcg", "mrr"), want):
        assert value is None or math.isclose(r[name], value), name


ALPHAS = [([[2, 2, 2], [0, 0, 0], [1, 1, 1]], 1.0), ([[1, 1], [1, 1]], 1.0), ([[2, 2, None], [0, None, 0], [1]], 1.0), ([], 1.0), ([[None, None], [2]], 1.0)]


@pytest.mark.parametrize("units,want", ALPHAS)
def test_alpha_fixed(spark, units, want):
    assert ev.krippendorff_alpha(judged(spark, units)).first().alpha == want


def judged(spark, units):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, u in enumerate(units) for v in u], "unit int, value double")


def test_alpha_ranges(spark):
    assert ev.krippendorff_alpha(judged(spark, [[0, 2], [2, 0], [0, 2], [2, 0]])).first().alpha < 0
    units = [[2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 0, 0]]
    assert 0 < ev.krippendorff_alpha(judged(spark, units)).first().alpha < 1


def test_majority(spark):
    got = {r.unit: r.relevant for r in ev.majority(judged(spark, [[2, 1, 0], [0, 0, 2], [1, 0], [None, None], [None, 2]]), ["unit"]).collect()}
    assert got == {0: True, 1: False, 2: False, 3: None, 4: True}


def test_fusion(spark):
    lists = [("q", 0, 1.0, 1, "a"), ("q", 0, 1.0, 2, "b"), ("q", 1, 1.0, 1, "b"), ("q", 1, 1.0, 2, "c")]
    got = [r.item for r in ev.fused(spark.createDataFrame(lists, "query_id string, list int, weight double, rank int, item string")).orderBy("position").collect()]
    assert got == ["b", "a", "c"]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seq int, v string")
    batch = spark.createDataFrame([("a", 2, None), ("c", 1, "z"), (None, 9, "n"), ("b", 0, "late")], "id string, seq int, v string")
    new = g.merge_nodes(old, batch, ["id"], "seq")
    want = {("a", 2, None), ("b", 1, "y"), ("c", 1, "z")}
    assert {tuple(r) for r in new.collect()} == want
    assert {tuple(r) for r in g.merge_nodes(new, batch, ["id"], "seq").collect()} == want  # applied twice is applied once
    assert {tuple(r) for r in g.insert_absent(old, batch.where("id is not null"), ["id"]).collect()} == {("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")}
    edges = spark.createDataFrame([("a", "c", 1), ("a", "c", 2), ("a", "q", 1)], "src string, dst string, seq int")
    assert [tuple(r) for r in g.merge_edges(None, edges, new, new, "seq").select("src", "dst", "seq").collect()] == [("a", "c", 2)]
    upd = g.update_edges(edges.where("seq = 1").withColumn("w", F.lit(0.5)), spark.createDataFrame([("a", "c", None), ("z", "z", 1.0)], "src string, dst string, w double"), ["src", "dst"], ["w"])
    assert {(r.dst, r.w) for r in upd.collect()} == {("c", None), ("q", 0.5)}


def test_expiry_and_neighbours(spark):
    s = spark.sql("select * from values ('a', timestamp'2025-01-01 00:00:00'), ('b', timestamp'2025-01-01 05:00:00'), ('c', timestamp'2025-01-01 07:00:00'), ('d', null) t(id, ts)")
    left = g.unexpired(s, "ts", 6)
    assert {r.id for r in left.collect()} == {"b", "c", "d"}
    edges = spark.createDataFrame([("h", "a", "S"), ("h", "b", "S"), ("g", "b", "T")], "src string, dst string, type string")
    assert {r.dst for r in g.cascade(edges, left, "dst").collect()} == {"b"}
    d = {r.node: (r.total, len(r.neighbours)) for r in g.node_details(edges, 1).collect()}
    assert d == {"h": (2, 1), "a": (1, 1), "b": (2, 1), "g": (1, 1)}


def test_landed_files(spark, tmp_path):
    rates = {"data": [{"hotelId": "h1", "roomTypes": [{"roomTypeId": f"r{i}", "name": "n", "offerRetailRate": [{"amount": a}] if a is not None else [], "rates": [{"name": "N", "boardName": "BB", "retailRate": {"total": [{"amount": 50.0}]}, "cancellationPolicies": {"refundableTag": "RFN" if i else "NRFN"}}]} for i, a in enumerate([100.0, None, 0.0, 70.0])]}], "hotels": []}
    (tmp_path / "rates.json").write_text(json.dumps(rates))
    rooms = landed.read_rates(spark, str(tmp_path / "rates.json"))
    assert {(r.room_id, r.price) for r in rooms.collect()} == {("h1:r0", 100.0), ("h1:r1", 50.0), ("h1:r2", 50.0), ("h1:r3", 70.0)}
    r = landed.rate_rollup(rooms).first()
    assert (r.price, r.refundable, r.boards) == (50.0, True, ["BB"]) and [x.room_id for x in landed.cheapest_rooms(rooms, 2).orderBy("rank").collect()] == ["h1:r1", "h1:r2"]
    matrix = {"origins": ["o"], "destinations": ["d", "e"], "rows": [{"elements": [{"status": "OK", "distance": {"value": 1500}, "duration": {"value": 120}}, {"status": "NOT_FOUND"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(matrix))
    m = landed.read_matrix(spark, str(tmp_path / "m.json")).collect()
    assert [tuple(x) for x in m] == [("o", "d", 1.5, 2.0, None)]
    inc = {"incidents": [{"geometry": {"coordinates": [[80.0, 6.0]]}, "properties": {"id": "i", "iconCategory": 6, "magnitudeOfDelay": 3, "from": "A", "to": "B", "delay": 9}}, {"geometry": {}, "properties": {"id": "j"}}]}
    (tmp_path / "i.json").write_text(json.dumps(inc))
    got = {r.id: (r.title, r.severity, r.lat) for r in landed.read_incidents(spark, str(tmp_path / "i.json")).collect()}
    assert got == {"i": ("JAM: A to B", "heavy", 6.0), "j": ("UNKNOWN", "unknown", 0.0)}
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>https://a.example/1</link></item><item><title>no link</title></item></channel></rss>")
    assert [r.url for r in landed.read_rss(spark, str(tmp_path / "feed.xml"), "rss").collect()] == ["https://a.example/1"]


def test_sheets_and_sinks(spark, tmp_path):
    (tmp_path / "annotator_x.csv").write_text("query_id,hotel_id,relevance\nq,h,2\nq,i,\n")
    got = {(r.hotel_id, r.annotator, r.score) for r in landed.read_sheets(spark, str(tmp_path / "annotator_*.csv")).collect()}
    assert got == {("h", "x", 2.0), ("i", "x", None)}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "annotator_y.csv").write_text("query_id,hotel_id,relevance\nq,h,5\n")
    with pytest.raises(Exception, match="no such score"):
        landed.read_sheets(spark, str(tmp_path / "bad" / "annotator_*.csv")).collect()
    rows = spark.createDataFrame([("q", "h", "x"), ("q", "i", "y")], "query_id string, hotel_id string, annotator string")
    sinks.write_sheets(rows, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets")).count() == 2
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_streams(spark, tmp_path):
    rows = [("p", f"2025-01-01 0{h}:{m:02d}:00", s, float(m)) for h in range(4) for m, s in ((5, "light"), (50, "heavy"))]
    batch = spark.createDataFrame(rows, "place string, t string, severity string, eta double").select("place", F.to_timestamp("t").alias("ts"), "severity", "eta")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = st.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in st.hourly(batch).collect()} and spark.table("hours").count() == 4
    merge = lambda old, new: g.merge_nodes(old, new, ["place", "ts"], "eta")
    run = st.upsert_each_batch(merge, str(tmp_path / "out"))
    for k in (0, 1, 1):
        run(batch, k)
    assert spark.read.parquet(str(tmp_path / "out" / "v1")).count() == len(rows)


def test_answers_and_cache():
    asked = []

    def retrieve(question, city):
        asked.append(question)
        return f"context of {question}"

    now = [0.0]
    cache = Cache(900, lambda: now[0])
    assert answer("q", "c", retrieve, cache=cache)["context"] == "context of q" and len(asked) == 2  # the default grade asks once more
    assert answer("q", "c", retrieve, cache=cache)["cached"] and len(asked) == 2
    now[0] = 901.0
    assert not answer("q", "c", retrieve, cache=cache)["cached"]
    assert len([answer("z", "c", retrieve, grade=lambda q, x: 0.9)]) == 1 and asked[-1] == "z"


def test_first_write_wins_whatever_the_partitions(spark):
    old = spark.createDataFrame([("a", 9, "x")], "id string, seq int, v string")
    batch = spark.createDataFrame([("b", 2, "late"), ("b", 1, "first"), ("a", 0, "no"), ("b", 1, "zz")], "id string, seq int, v string")
    for n in (1, 3, 7):
        assert {tuple(r) for r in g.insert_absent(old, batch.repartition(n), ["id"], [F.col("seq").asc(), F.col("v").asc()]).collect()} == {("a", 9, "x"), ("b", 1, "first")}
    assert g.insert_absent(old.select("id"), batch.select("id"), ["id"]).count() == 2


def test_rates_prefer_the_room(spark, tmp_path):
    rooms = [
        {"offerId": "o9", "name": "Sea view " + "x" * 300, "rates": [{"name": "Rate", "boardType": "RO", "retailRate": {"total": [{"amount": 90.0}]}}]},
        {"roomTypeId": "r1", "name": "", "rates": [{"name": "From rate", "boardName": "BB", "retailRate": {"total": [{"amount": 40.0}]}, "cancellationPolicies": {"refundableTag": "RFN"}}]},
        {"roomTypeId": "r2", "offerRetailRate": [{"amount": 30.0}], "rates": []},
    ]
    many = [{"roomTypeId": f"m{i}", "offerRetailRate": [{"amount": 10.0 + i}], "rates": [{"cancellationPolicies": {"refundableTag": "RFN" if i == 6 else "NRFN"}}]} for i in range(7)]
    hotels = [{"id": "h1", "name": "H", "rating": 8.4, "starRating": 4.0, "facilities": [" Pool ", ""]}, {"id": "h1", "name": "H", "rating": 8.4, "starRating": 4.0, "facilities": [" Pool ", ""]}, {"id": None, "name": "lost"}]
    (tmp_path / "r.json").write_text(json.dumps({"data": [{"hotelId": "h1", "roomTypes": rooms}, {"hotelId": "h2", "roomTypes": many}], "hotels": hotels}))
    got = landed.read_rates(spark, str(tmp_path / "r.json"))
    own = {r.room_id: r for r in got.where("hotel_id = 'h1'").collect()}
    assert set(own) == {"h1:o9", "h1:r1", "h1:r2"} and len(own["h1:o9"].name) == 200 and own["h1:r1"].name == "From rate" and own["h1:r2"].name == "Room" and own["h1:o9"].board == "RO"
    roll = {r.hotel_id: r for r in landed.rate_rollup(got, nights=2).collect()}
    assert roll["h1"].price == 15.0 and roll["h2"].price == 5.0 and not roll["h2"].refundable  # the seventh plan is not kept
    meta = landed.read_rate_hotels(spark, str(tmp_path / "r.json")).collect()
    assert [(m.id, m.rating, m.star_rating, m.amenities) for m in meta] == [("h1", 4.2, 4.0, ["24h Front Desk", "Air Conditioning", "Pool"])]


def test_landed_pages_of_places_and_news(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"status": "OK", "results": [{"place_id": "p1", "name": "A", "rating": 4.1, "types": ["spa"], "geometry": {"location": {"lat": 6.5, "lng": 80.5}}}, {"name": "no id"}]}))
    (tmp_path / "over.json").write_text(json.dumps({"status": "OVER_QUERY_LIMIT", "results": [{"place_id": "p2"}]}))
    assert [(r.id, r.lat) for r in landed.read_places(spark, str(tmp_path / "*.json")).collect()] == [("p1", 6.5)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"result": {"place_id": "p1", "formatted_phone_number": "1", "editorial_summary": {"overview": "Nice"}}}))
    (tmp_path / "d" / "b.json").write_text(json.dumps({}))
    assert [(r.id, r.phone, r.description) for r in landed.read_details(spark, str(tmp_path / "d")).collect()] == [("p1", "1", "Nice")]
    (tmp_path / "n").mkdir()
    articles = [{"title": "T", "description": "d" * 600, "url": "u1", "source": {"name": "Bay"}}, {"title": None, "url": ""}, {"url": "u2", "publishedAt": "2025-01-01T00:00:00Z"}]
    (tmp_path / "n" / "a.json").write_text(json.dumps({"status": "ok", "articles": articles}))
    (tmp_path / "n" / "b.json").write_text(json.dumps({"status": "error", "articles": articles}))
    rows = {r.url: r for r in landed.read_articles(spark, str(tmp_path / "n"), "gnews", F.lit("2025-02-01").cast("timestamp")).collect()}
    assert set(rows) == {"u1", "u2"} and rows["u1"].source == "gnews:Bay" and len(rows["u1"].summary) == 500 and rows["u1"].published_at == "2025-02-01T00:00:00Z" and rows["u2"].source == "gnews:unknown" and rows["u2"].title == ""


def test_views_and_cleaning_of_the_graph(spark):
    rows = spark.createDataFrame([("h", "heavy", "A"), ("h", "heavy", "A"), ("h", None, "B"), ("i", None, "C")], "id string, severity string, road string")
    assert {r.id: [tuple(m) for m in r.maps] for r in g.collected_maps(rows, "id", ["severity", "road"], "severity", "maps").collect()} == {"h": [("heavy", "A")], "i": []}
    plain = g.sanitised(spark.sql("select 'a' id, array(1.0) embedding, map('k', 1) m, timestamp'2025-01-01 00:00:00' t, 3 n")).first().asDict()
    assert plain == {"id": "a", "m": '{"k":1}', "t": "2025-01-01 00:00:00", "n": 3}
    slots = spark.createDataFrame([(["Pool ", "wifi"], ["POOL", "", None, "Bar"]), (None, None)], "a array<string>, b array<string>")
    assert [r.s for r in slots.select(g.merged_slots(F.col("a"), F.col("b")).alias("s")).collect()] == [["bar", "pool", "wifi"], []]
    nodes = spark.createDataFrame([("trinco",), ("Trincomalee",), ("Galle",)], "name string")
    edges = spark.createDataFrame([("h", "trinco", 1.0), ("h", "Trincomalee", 2.0), ("i", "trinco", 3.0), ("j", "Galle", 4.0)], "src string, dst string, km double")
    new, moved = g.merge_aliases(nodes, edges, F.when(F.col("name") == "trinco", "Trincomalee"))
    assert {r.name for r in new.collect()} == {"Trincomalee", "Galle"} and {tuple(r[c] for c in ("src", "dst", "km")) for r in moved.collect()} == {("h", "Trincomalee", 1.0), ("i", "Trincomalee", 3.0), ("j", "Galle", 4.0)}
    with pytest.raises(ValueError):
        g.cleared({"City": nodes}, "delete all")
    empty, counts = g.cleared({"City": nodes}, "DELETE ALL")
    assert empty["City"].count() == 0 and [tuple(r) for r in counts.collect()] == [("City", 3)]
    typed = spark.createDataFrame([("h1", "Galle", "L"), ("h2", "Galle", "L"), ("h3", "Kandy", "L"), ("e", "h1", "M")], "src string, dst string, type string")
    assert {(r.src, r.dst) for r in g.network(typed, typed.where("type = 'L'"), "Galle", 1).collect()} == {("h1", "Galle"), ("e", "h1")}
    assert g.network(typed, limit=2).count() == 2


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from isleweave.plans import lineage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    with pytest.raises(RuntimeError):
        lineage.cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))))
