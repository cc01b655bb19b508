"""Proximity, units, instants, skew: against brute force and fixed cases."""

import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from isleweave.functions.geo import distance_km
from isleweave.operators import instants as inst
from isleweave.operators.instants import normalise_instants
from isleweave.operators.proximity import near_pairs, points_in_regions
from isleweave.operators.units import hotel_units, not_in_common_unit, tidy_unit, unit_dictionary
from isleweave.plans.skew import join_small, salted_join

POINT = "id string, lat double, lng double"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, x)))


@pytest.mark.parametrize("radius", [0.08, 5.0, 300.0])
def test_near_pairs_equals_brute_force(spark, radius):
    r = random.Random(radius)
    spread = radius / 111
    centres = [(6.0, 80.0), (0.5, 179.999), (89.95, 10.0), (-89.99, -170.0), (45.0, -0.001)]
    make = lambda n, p: [(f"{p}{i}", min(90.0, max(-90.0, c[0] + r.uniform(-2, 2) * spread)), (c[1] + r.uniform(-2, 2) * spread / max(0.01, math.cos(math.radians(c[0]))) + 180) % 360 - 180) for i in range(n) for c in [r.choice(centres)]]
    a, b = make(60, "a"), make(120, "b")
    want = {(x[0], y[0]) for x in a for y in b if km(x[1:], y[1:]) <= radius and all(x[1:]) and all(y[1:])}
    got = {(x.left_id, x.right_id) for x in near_pairs(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), radius).collect()}
    assert got == want and (want or radius < 1)


def test_near_pairs_nulls_repeats_and_clashing_columns(spark):
    a = spark.createDataFrame([("h", 1.0, 1.0, "x"), ("h", 1.0, 1.0, "y"), (None, 1.0, 1.0, "x"), ("z", 0.0, 1.0, "x"), ("n", None, 1.0, "x"), ("nan", float("nan"), 1.0, "x")], POINT + ", km string")
    b = spark.createDataFrame([("s", 1.0, 1.0, 1), ("s", 1.0, 1.0, 2), ("t", 1.0, 0.0, 1)], POINT + ", left_id int")
    assert [tuple(r) for r in near_pairs(a, b, 1.0).collect()] == [("h", "s", 0.0)]
    assert near_pairs(a.limit(0), b, 1.0).count() == 0 and near_pairs(a, b.limit(0), 1.0).count() == 0


def test_distance(spark):
    row = spark.sql("select 6.9271D a, 79.8612D b, 7.2906D c, 80.6337D d").select(distance_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k"), distance_km(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("z"), distance_km(F.col("a"), F.col("b"), F.lit(None).cast("double"), F.col("d")).alias("n")).first()
    assert 85 < row.k < 105 and row.z == 0 and row.n is None


def test_regions(spark):
    rings = [("tri", [(0.5, 0.5), (0.5, 3.5), (3.5, 0.5)]), ("tiny", [(1.0, 1.0), (1.0, 1.001), (1.001, 1.001), (1.001, 1.0)]), ("line", [(1.0, 1.0), (2.0, 2.0)]), ("none", None)]
    regions = spark.createDataFrame([(k, None if v is None else [{"lat": a, "lng": b} for a, b in v]) for k, v in rings], "region_id string, ring array<struct<lat:double,lng:double>>")
    r = random.Random(1)
    points = [(f"p{i}", r.uniform(0, 4), r.uniform(0, 4)) for i in range(300)] + [("q", 1.0005, 1.0005), ("q", 1.0005, 1.0005), (None, 1.0, 1.0), ("u", None, 1.0)]
    want = {(k, "tri") for k, y, x in points if k and y is not None and y > 0.5 and x > 0.5 and x + y < 4.0} | {(k, "tiny") for k, y, x in points if k and y is not None and 1 < y < 1.001 and 1 < x < 1.001}
    got = [tuple(x) for x in points_in_regions(spark.createDataFrame(points, POINT), regions).collect()]
    assert set(got) == want and len(got) == len(want)
    assert points_in_regions(spark.createDataFrame(points, POINT), regions.limit(0)).count() == 0


def test_salted_join_equals_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("v"))
    left = left.unionByName(spark.sql("select cast(null as int) k, -1L v"))
    right = spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w")).unionByName(spark.sql("select 7 k, 99L w"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["k"], how).select("k", "v", "w").collect()))
        assert sorted(map(str, salted_join(left, right, ["k"], how=how, share=20, least=10).select("k", "v", "w").collect())) == want
        assert sorted(map(str, join_small(left, right, ["k"], how).select("k", "v", "w").collect())) == want


FX = [("LKR", "Sri Lankan rupee", 1.0), ("USD", "US dollar", 300.0), ("EUR", "Euro", 330.0), ("GBP", "Pound sterling", 380.0), ("INR", "Indian rupee", 3.6)]


def test_unit_dictionary(spark):
    canon = spark.createDataFrame([(a, c) for c, n, _ in FX for a in (c, n)], "alias string, unit string")
    words = ["usd", "us dollars", "us dolar", "euros", "pounds sterling", "indian rupees", "sri lankan rupes", "bananas", None, "eur", "rupee"]
    got = {r.spelling: r.unit for r in unit_dictionary(spark.createDataFrame([(w,) for w in words], "spelling string"), canon).collect()}
    assert got == {"usd": "USD", "us dollars": "USD", "us dolar": "USD", "euros": "EUR", "pounds sterling": "GBP", "indian rupees": "INR", "sri lankan rupes": "LKR", "eur": "EUR"}
    assert [r[0] for r in spark.createDataFrame([(" Rs. ",), ("",), (None,)], "u string").select(tidy_unit(F.col("u"))).collect()] == ["rs", None, None]


HOTEL = "id string, source string, rating double, price_per_night double, price_per_night_lkr double, price_currency string, description string, rates string"


def test_hotel_units(spark):
    rows = [
        ("a", "s5", 4.0, 100.0, 30000.0, "usd ", None, "x"), ("a", "s5", 4.0, 100.0, 30000.0, "usd ", None, "y"), ("b", "s5", 4.2, 100.0, 100.0, None, "Rates are quoted in euros.", None), ("c", "s10", 7.7, 20000.0, 20.0, "Rs.", "x", None),
        ("d", "s10", 4.1, None, None, None, "Rated 4.1 of 5 by guests.", None), ("e", "s5", 3.9, 0.0, 0.0, None, "Guests score it 8 out of 10.", None), ("f", "s5", 82.0, 20000.0, 20100.0, "zzz", "82% of guests were satisfied.", None), ("g", "s5", None, None, None, None, None, None),
        ("h", "s10", 8.0, 30000.0, 100.0, "LKR", "", None), ("i", "s5", 4.4, 50.0, None, None, "About £50 nightly.", None), ("j", "s5", 4.1, None, 9.0, None, None, None), ("k", "s10", 7.1, 21000.0, 21000.0, "LKR", None, None), ("l", "s5", 8.0, None, None, None, "On a ten-point scale visitors gave it 8.", None),
    ]
    hotels, fx = spark.createDataFrame(rows, HOTEL), spark.createDataFrame(FX, "currency string, currency_name string, lkr_per_unit double")
    got = {tuple(r) for r in not_in_common_unit(hotel_units(hotels, fx)).collect()}
    assert got == {
        ("a", "price_per_night", "USD"), ("b", "price_per_night", "EUR"), ("b", "price_per_night_lkr", "EUR"), ("c", "rating", "of_10"), ("c", "price_per_night_lkr", "LKR_thousand"), ("f", "rating", "of_100"), ("h", "rating", "of_10"),
        ("h", "price_per_night_lkr", "USD"), ("i", "price_per_night", "GBP"), ("j", "price_per_night_lkr", "LKR_thousand"), ("k", "rating", "of_10"), ("l", "rating", "of_10"),
    }
    assert hotel_units(hotels.limit(0), fx).count() == 0


FEEDS = [("berlin", "Europe/Berlin", "dmy"), ("ny", "America/New_York", "mdy"), ("utc", "UTC", "dmy"), ("sydney", "Australia/Sydney", "dmy")]
VALUE = "field_name string, id string, source string, value string, loaded_at timestamp, utc_s string"


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


CASES = [
    ("berlin", "2025-07-01T12:00:00", utc(2025, 7, 1, 10)), ("berlin", "2025-01-01 12:00:00.987", utc(2025, 1, 1, 11)), ("ny", "03/04/2025 10:00", utc(2025, 3, 4, 15)), ("berlin", "03/04/2025 10:00", utc(2025, 4, 3, 8)),
    ("ny", "25/03/2025 10:00", utc(2025, 3, 25, 14)), ("utc", "20240718T122011Z", utc(2024, 7, 18, 12, 20, 11)), ("utc", "Fri, 12 Jan 2024 03:56:02 +0530", utc(2024, 1, 11, 22, 26, 2)), ("ny", "Sun, 03 Nov 2024 01:32:07 -0400", utc(2024, 11, 3, 5, 32, 7)),
    ("utc", "Sun, 27 Oct 2024 02:13:43 CEST", utc(2024, 10, 27, 0, 13, 43)), ("sydney", "Mon, 06 Jan 2025 10:00:00 EST", utc(2025, 1, 6, 15)), ("utc", "9 December 2024, 12:06 am", utc(2024, 12, 9, 0, 6)), ("utc", "9 December 2024, 12:06 pm", utc(2024, 12, 9, 12, 6)),
    ("utc", "1738828249", 1738828249), ("utc", "1738828249999", 1738828249), ("berlin", "2025-03-30T02:30:00", utc(2025, 3, 30, 1, 30)), ("utc", "2025-08-04T07:45:48+05:30", utc(2025, 8, 4, 2, 15, 48)), ("utc", "2025-02-30T00:00:00", None), ("utc", "2025-02-03", None),
    ("utc", "pending", None), ("utc", "", None), ("utc", None, None), ("utc", "0000-00-00 00:00:00", None), ("nowhere", "2025-01-01T00:00:00", utc(2025, 1, 1)), ("utc", "December 9, 2024 3:00 pm", utc(2024, 12, 9, 15)),
]


def test_instants(spark):
    rows = [("f", f"i{k}", s, v, None if w is None else datetime.fromtimestamp(w + 600, timezone.utc), "clash") for k, (s, v, w) in enumerate(CASES)] + [("f", None, "utc", "1738828249", None, None)]
    feeds = spark.createDataFrame(FEEDS, "source string, home_zone string, date_order string")
    got = {r.id: r.utc_s for r in normalise_instants(spark.createDataFrame(rows, VALUE), feeds).collect()}
    assert got == {f"i{k}": w for k, (_, _, w) in enumerate(CASES) if w is not None}
    assert normalise_instants(spark.createDataFrame(rows, VALUE).limit(0), feeds).count() == 0


def test_repeated_hour_is_chosen_by_the_load(spark):
    feeds = spark.createDataFrame(FEEDS, "source string, home_zone string, date_order string")
    at = lambda *a: datetime(*a, tzinfo=timezone.utc)
    rows = [("f", "first", "berlin", "2025-10-26T02:10:00", at(2025, 10, 26, 0, 20), None), ("f", "second", "berlin", "2025-10-26T02:40:00", at(2025, 10, 26, 1, 50), None)]
    got = {r.id: r.utc_s for r in normalise_instants(spark.createDataFrame(rows, VALUE), feeds).collect()}
    assert got == {"first": utc(2025, 10, 26, 0, 10), "second": utc(2025, 10, 26, 1, 40)}


def _mixed_feed(n, seed):
    """Values of one source that are mostly ambiguous: all-number dates and abbreviations of two meanings, over days."""
    r = random.Random(seed)
    rows, t = [], 1_735_600_000
    for k in range(n):
        t += r.randrange(600, 9000)
        at = datetime.fromtimestamp(t, timezone.utc)
        kind = r.random()
        text = at.strftime("%d/%m/%Y %H:%M") if kind < 0.5 else at.strftime("%a, %d %b %Y %H:%M:%S IST") if kind < 0.9 else at.strftime("%Y-%m-%dT%H:%M:%S+00:00")
        rows.append(("f", f"i{k:04d}", r.choice(["s", "s", "s", "q"]), text, datetime.fromtimestamp(t + r.randrange(60, 90_000), timezone.utc), None))
    return rows


@pytest.mark.parametrize("block", [1, 3, 40])
def test_instants_in_blocks_equal_one_search(spark, monkeypatch, block):
    monkeypatch.setattr(inst, "ORDER_COST", 0.4)  # so that the search, not the source's order, decides
    monkeypatch.setattr(inst, "ZONE_COST", 0.3)
    values = spark.createDataFrame(_mixed_feed(240, 5), VALUE)
    feeds = spark.createDataFrame([("s", "Asia/Colombo", "dmy"), ("q", "Europe/London", "mdy")], "source string, home_zone string, date_order string")
    zones = feeds.withColumnRenamed("source", "src")
    read = inst.with_readings(values.join(zones, values["source"] == zones["src"]).withColumn("s", F.unix_seconds("loaded_at")), "value", "home_zone", "date_order").select("id", "source", "s", "readings").collect()
    want = {}
    for source in ("s", "q"):
        chain = sorted((x for x in read if x.source == source), key=lambda x: (x.s, x.id))
        best = [(0.0, ())]
        for k, x in enumerate(chain):  # every path that may still win, one per last reading
            lag = lambda u: x.s - u
            own = [y.cost + (inst.EARLY_COST if lag(y.utc_s) < -inst.SKEW_S else math.log1p(max(lag(y.utc_s), 0) / 3600)) for y in x.readings]
            go = lambda p, y: 0 if p is None else min(max(p.utc_s - y.utc_s, 0) / 3600, 10) * inst.BACK_COST + inst.SWITCH_COST * (p.form != y.form)
            best = [min((c + o + go(p[-1] if p else None, y), (*p, y)) for c, p in best) for y, o in zip(x.readings, own)]
        want |= {x.id: y.utc_s for x, y in zip(chain, min(best)[1])}
    assert sum(len(x.readings) > 1 for x in read) > 150
    assert {x.id: x.utc_s for x in normalise_instants(values, feeds, block).collect()} == want


def test_a_spelling_no_dictionary_places_is_reported(spark):
    fx = spark.createDataFrame([("LKR", "Sri Lankan rupee", 1.0), ("USD", "US dollar", 300.0)], "currency string, currency_name string, lkr_per_unit double")
    rows = [("a", "zorkmid", 50.0, None), ("b", None, 50.0, None), ("c", "zorkmid", 50.0, "Rates are quoted in US dollar"), ("d", "US dolar", 50.0, None), ("e", " ", 50.0, "Rated 8.4 out of tenn."), ("f", None, None, "8.4 out of 10")]
    hotels = spark.createDataFrame([(i, "s", 8.4, p, None, c, t) for i, c, p, t in rows], "id string, source string, rating double, price_per_night double, price_per_night_lkr double, price_currency string, description string")
    got = {r.id: r for r in hotel_units(hotels, fx).collect()}
    assert (got["a"].currency, got["a"].price_lkr, got["a"].unplaced) == (None, None, "zorkmid")
    assert [got[i].currency for i in "bcde"] == ["LKR", "USD", "USD", "LKR"] and all(got[i].unplaced is None for i in "bcde")
    assert got["e"].rating_scale == got["f"].rating_scale == 10 and got["f"].unplaced is None


def test_a_crowded_cell_is_split(spark):
    from isleweave.plans import skew

    r = random.Random(8)
    spots = [(f"s{i}", 6.0 + r.uniform(0, 3e-4), 80.0 + r.uniform(0, 3e-4)) for i in range(600)] + [(f"t{i}", r.uniform(-60, 60), r.uniform(-170, 170)) for i in range(600)]
    hotels = [("h", 6.0001, 80.0001), ("far", 50.0, 50.0)]
    a, b = spark.createDataFrame(hotels, POINT), spark.createDataFrame(spots, POINT)
    counts = b.groupBy(F.lit(1).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    assert skew.hot_keys(counts, ["cell"], "n", least=100).first()["__salts"] == 12
    want = {("h", i) for i, y, x in spots if km((6.0001, 80.0001), (y, x)) <= 0.02}
    assert {(x.left_id, x.right_id) for x in near_pairs(a, b, 0.02).collect()} == want and len(want) > 100
