"""Queries on links must not shuffle a row per pair: their scratch space follows the inputs, not the pairs."""

import random

import pytest

import __spark_entry__ as entry
from isleweave.operators import proximity

from test_whole import CITY, EVENT, HOTEL, NEWS, SIGNAL

N = 600
#: Rows that a query may shuffle over N hotels, N signals and N events that all lie close together, where links by distance are 2 * N * N.
MOST = 60 * N
NAMES = ["radius_link_signals", "route_signal_link", "graph_overview_rels", "clear_counts", "graph_network", "event_news_chain", "network_first", "tfidf_questions", "node_neighbours", "edge_list"]


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """N hotels, point signals and incidents within a kilometre, some at one position."""
    folder, r = tmp_path_factory.mktemp("crowd"), random.Random(5)
    at = lambda n: (6.0, 80.0) if n % 3 == 0 else (6 + r.random() / 200, 80 + r.random() / 200)
    rows = {
        "hotel": ([(f"h{n:04d}", f"Hotel {n}", "a pool by the beach", None, None, None, None, None, "Kolavara", *at(n), "s", None, None) for n in range(N)], HOTEL),
        "graph_event": ([(f"e{n:04d}", f"t{n}", "traffic_incident", None, *at(n), f"u{n}" if n % 50 == 0 else None, None) for n in range(N)], EVENT),
        "traffic_signal": ([(f"s{n:04d}", None if n % 10 else "h0001", "heavy", 1.0, *at(n), None, None) for n in range(N)], SIGNAL),
        "news_signal": ([(f"u{n}", f"u{n}", f"Title {n % 4}", "x", None, "s", None) for n in range(0, N, 50)], NEWS),
        "city": ([("Kolavara", 6.0, 80.0), ("Hikkala", 6.2, 80.1)], CITY),
        "documents": ([(20 * n, "qa", f"a pool by the beach under {n % 7 + 1}000", "Kolavara") for n in range(N)], "doc_id long, doc_type string, text string, city_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def shuffled(spark, run):
    """What ``run`` gives, and how many rows it shuffled or wrote to checkpoints' lineage."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    out = run()
    return out, sum(n for k, n in total().items() if k not in before)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_not_shuffled(spark, crowd, name):
    got, n = shuffled(spark, lambda: entry.queries()[name](spark, crowd).toPandas())
    assert n < MOST
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("hotel", "graph_event", "traffic_signal", "news_signal", "city", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{crowd}/{table}.parquet/*.parquet'")
    if name in entry.oracle_sql():
        assert rows(got) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_near_sums_equal_pairs(spark):
    r = random.Random(2)
    at = lambda: r.choice([(6.0, 80.0), (89.97, 10.0), (89.98, -170.0), (0.0, 80.0), (None, 1.0), (6 + r.random() / 20, 80 + r.random() / 20), (-1 + r.random() / 20, 179.99), (-1.0, -179.99)])
    left, right = ([(f"{side}{n}", *at()) for n in range(900)] for side in "ab")
    left, right = (spark.createDataFrame(x, "id string, lat double, lng double") for x in (left, right))
    spots = right.where("lat != 0 and lat is not null").groupBy("lat", "lng").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    want = {}
    for x in proximity.near_pairs(left, right, 2.0).collect():
        n, km = want.get(x.left_id, (0, 9.0))
        want[x.left_id] = (n + 1, min(km, x.km))
    got = {x.left_id: (x.n, x.km) for x in proximity.near_sums(left, spots, 2.0, ["n"], nearest=True).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - km) < 1e-9 for k, (_, km) in want.items())
