"""The whole links: what the queries on links must do on small made-up tables."""

import pytest

from isleweave.queries import base, graph, ranking, texts

HOTEL = "id string, name string, description string, rating double, star_rating double, price_range string, price_per_night_lkr double, address string, city_name string, lat double, lng double, source string, last_updated string, loaded_at timestamp"
EVENT = "id string, title string, event_type string, start_time string, lat double, lng double, news_url string, loaded_at timestamp"
SIGNAL = "id string, hotel_id string, severity string, eta_change_min double, lat double, lng double, signal_ts string, loaded_at timestamp"
NEWS = "id string, url string, title string, summary string, published_at string, source string, loaded_at timestamp"
CITY = "name string, lat double, lng double"
#: 0.01 degrees of latitude are 1.11 km.
HOTELS = [("h1", 6.0, 80.0, "Kolavara"), ("h2", 6.1, 80.0, "Elsewhere"), ("h3", None, None, "Hikkala")]


@pytest.fixture()
def made(spark, tmp_path):
    def write(events=(), signals=(), news=()):
        rows = {
            "hotel": ([(i, i, None, None, None, None, None, None, c, a, b, "s", None, None) for i, a, b, c in HOTELS], HOTEL), "graph_event": ([(i, i, k, None, a, b, u, None) for i, k, a, b, u in events], EVENT),
            "traffic_signal": ([(i, h, v, d, a, b, None, None) for i, h, v, d, a, b in signals], SIGNAL), "news_signal": ([(u, u, t, s, None, "s", None) for u, t, s in news], NEWS),
            "city": ([("Kolavara", 6.0, 80.0), ("Hikkala", 6.2, 80.1)], CITY),
        }
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_incidents_within_five_km(spark, made):
    folder = made(events=[("near", "traffic_incident", 6.005, 80.0, None), ("mid", "traffic_incident", 6.04, 80.0, None), ("far", "traffic_incident", 6.05, 80.0, None)])
    assert {(r.src, r.dst) for r in base.edges(spark, folder, whole=True)["AFFECTED_BY"].collect()} == {("h1", "near"), ("h1", "mid")}
    assert {r.id: r.event_count for r in graph.QUERIES["candidate_pool"](spark, folder).collect()} == {"h1": 2, "h2": 0, "h3": 0}


def test_point_signals_within_five_km(spark, made):
    routes = [("r1", "h1", "light", 2.0, 6.9, 80.0), ("r2", "gone", "heavy", 9.0, 6.9, 80.0)]
    points = [("p1", None, "heavy", 7.0, 6.03, 80.0), ("p2", None, "moderate", 1.0, 6.03, 80.0), ("p3", None, "heavy", 30.0, 6.05, 80.0), ("p4", None, "heavy", 50.0, 0.0, 80.0), ("p5", None, None, None, 6.13, 80.0)]
    folder = made(signals=routes + points)
    assert {(r.src, r.dst) for r in base.edges(spark, folder, whole=True)["HAS_SIGNAL"].collect()} == {("h1", "r1"), ("h1", "p1"), ("h1", "p2"), ("h2", "p5")}
    assert {r.id: (r.severities, r.worst_delay) for r in graph.QUERIES["candidate_pool"](spark, folder).collect()} == {"h1": ("heavy;light;moderate", 7.0), "h2": ("", None), "h3": ("", None)}
    assert {r.id: (r.heavy, r.moderate, r.worst, r.delay) for r in ranking.pool(spark, folder, whole=True).collect() if r.id == "h1"} == {"h1": (True, True, 7.0, 2.0)}
    assert {tuple(r) for r in graph.QUERIES["traffic_status_city"](spark, folder).collect()} == {("Kolavara", 3, 1, 1, 1, 0), ("Elsewhere", 1, 0, 0, 0, 0)}


def test_news_that_names_a_city(spark, made):
    events = [("i", "traffic_incident", 6.01, 80.0, None), ("a", "news", None, None, "u1"), ("b", "news", 6.01, 80.0, "u2"), ("c", "news", None, None, "u3"), ("d", "news", None, None, "u4")]
    news = [("u1", "Strike in KOLAVARA", "x"), ("u2", "A title", "near Hikkala"), ("u3", "Harbour", None), ("u4", None, "kolavara")]
    folder = made(events=events, news=news)
    want = {("h1", "i")} | {(h, e) for h in ("h1", "h3") for e in "abd"}
    assert sorted((r.src, r.dst) for r in base.edges(spark, folder, whole=True)["AFFECTED_BY"].collect()) == sorted(want)
    chain = {r.hotel_id: (r.events, r.titles, r.first_title) for r in graph.QUERIES["event_news_chain"](spark, folder).collect()}
    assert chain == {"h1": (4, 2, "A title"), "h2": (0, 0, None), "h3": (3, 2, "A title")}
    assert {r.id: r.event_count for r in graph.QUERIES["candidate_pool"](spark, folder).collect()} == {"h1": 4, "h2": 0, "h3": 3}
    assert {r.id: r.events for r in ranking.pool(spark, folder, whole=True).collect()} == {"h1": 4, "h2": 0, "h3": 3}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("hotel", "graph_event", "traffic_signal", "news_signal", "city"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    for query in ("event_news_chain", "candidate_pool", "edge_list"):
        rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
        assert rows(graph.QUERIES[query](spark, folder).toPandas()) == rows(con.sql(graph.SQL[query]).df())
    assert {tuple(r) for r in texts.QUERIES["news_keyword_link_whole"](spark, folder).collect()} == {(u, c, 1) for u in ("u1", "u2", "u4") for c in ("Kolavara", "Hikkala")}


def test_questions_are_searched_by_name_too(spark, made):
    folder = made()
    docs = [(i, k, x) for i, k, x in ((20, "qa", "what of h1?"), (40, "qa", "h3 or h2"), (41, "qa", "h1"), (60, "news", "h1"), (80, "qa", None))]
    spark.createDataFrame(docs, "doc_id long, doc_type string, text string").write.parquet(f"{folder}/documents.parquet")
    got = {(r.query_id, r.id) for r in ranking.QUERIES["tfidf_questions"](spark, folder).collect()}
    assert got == {("question:20", "h1"), ("question:40", "h2"), ("question:40", "h3")}


def test_personal_rankings_of_every_city(spark, made):
    folder = made()
    for name in ("personalized_event_seek", "personalized_event_avoid"):
        assert {(r.city, r.rank, r.id) for r in ranking.QUERIES[name](spark, folder).collect()} == {("Kolavara", 1, "h1"), ("Elsewhere", 1, "h2"), ("Hikkala", 1, "h3")}
