"""Queries on links must shuffle large tables once, however many kinds of links they meet in."""

import pytest

import __spark_entry__ as entry
from isleweave.operators import proximity

from test_pairs import rows, shuffled
from test_whole import CITY, EVENT, HOTEL, NEWS, SIGNAL

#: Signals, at few positions, of few hotels; one in 50 has an older row too.
N = 6000


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("busy")
    at = lambda n: (None, 1.0) if n % 10 == 0 else (6 + n % 20 / 400, 80.0)
    signals = [(f"s{n:04d}", None if n % 7 else f"h{n % 11}", "heavy", 1.0, *at(n), "2025", None) for n in range(N)]
    data = {
        "hotel": ([(f"h{n}", f"Hotel {n}", "a pool by the beach" if n % 2 else None, None, None, None, None, None, (None, "Kolavara", "Elsewhere")[n % 3], *at(n), "s", None, None) for n in range(10)], HOTEL),
        "graph_event": ([(f"e{n}", f"t{n}", "traffic_incident", None, *at(n), f"u{n}" if n % 5 == 0 else None, None) for n in range(40)], EVENT),
        "traffic_signal": (signals + [(i, "h1" if h is None else None, v, d, 6.0, 80.0, "2024", None) for i, h, v, d, *_ in signals[::50]], SIGNAL),
        "news_signal": ([(f"u{n}", f"u{n}", "Strike in KOLAVARA" if n % 2 else None, None, None, "s", None) for n in range(0, 30, 5)], NEWS),
        "city": ([("Kolavara", 6.0, 80.0), ("Hikkala", 6.2, 80.1), ("", None, None)], CITY),
    }
    for name, (made, schema) in data.items():
        spark.createDataFrame(made, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "most"), [("clear_counts", 1.5 * N), ("graph_overview_rels", 1.5 * N), ("edge_list", 1.5 * N)])
def test_signals_are_shuffled_once(spark, busy, name, most):
    got, n = shuffled(spark, lambda: entry.queries()[name](spark, busy).toPandas())
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("hotel", "graph_event", "traffic_signal", "news_signal", "city"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{busy}/{table}.parquet/*.parquet'")
    assert rows(got) == rows(con.sql(entry.oracle_sql()[name]).df())
    assert n < most


def test_lists_of_a_crowded_position_are_split(spark):
    right = spark.range(3000).selectExpr("concat('b', id) AS id", "6.0D AS lat", "80.0D AS lng").unionByName(spark.sql("SELECT 'far' AS id, 7.0D AS lat, 80.0D AS lng"))
    left = spark.sql("SELECT * FROM VALUES ('a', 6.0D, 80.0D), ('c', 6.01D, 80.0D), ('d', 7.0D, 80.0D) t(id, lat, lng)")
    assert proximity.lists_of(right, ["lat", "lng"]).where("lat = 6").count() > 1
    got = [tuple(r) for r in proximity.near_lists(left, proximity.lists_of(right, ["lat", "lng"]), 5.0).collect()]
    assert len(got) == 6001 and set(got) == {(i, f"b{n}") for i in "ac" for n in range(3000)} | {("d", "far")}
