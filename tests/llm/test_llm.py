"""Operators on text: against brute force, public encoders, exact round trips and held-out labels."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("isleweave.llm")

from isleweave.llm import addresses as ad  # noqa: E402
from isleweave.llm import entity_matching as em  # noqa: E402
from isleweave.llm import mixing as mx  # noqa: E402
from isleweave.llm import near_duplicates as nd  # noqa: E402
from isleweave.llm import personal as pe  # noqa: E402
from isleweave.llm import tokenise as tk  # noqa: E402
from isleweave.llm import truncation as tr  # noqa: E402
from isleweave.llm import personal_labels as pl  # noqa: E402
from isleweave.llm.personal_labels import labelled_texts  # noqa: E402

from held_out import HELD_OUT  # noqa: E402

ODD = "'sdmtlvreLVE  \n\t\r 　xyzäé09,!\"漢½²٠👍‍﻿<|endoftext|>''"


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(120))) for _ in range(n)] + ["", None, "don't we'll I'VE x's''s", "a" * 5000, "  \n\n  x", "\n", "word " * 3000]


def test_ids_equal_the_public_encoder():
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = tk.read_ranks(tk.vocabulary_path())
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = texts(1500, 1)
    assert list(tk.Encoder(ranks).encode(given)) == [encoding.encode_ordinary(x or "") for x in given]


def test_round_trip_and_spans(spark):
    given = texts(60, 2)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id bigint, text string, ids string")
    rows = docs.select("doc_id", "text", tk.token_ids(spark, F.col("text")).alias("i"), tk.token_spans(spark, F.col("text")).alias("s"), tk.token_count(spark, F.col("text")).alias("n"))
    rows = rows.withColumn("back", tk.decoded(spark, F.col("i"))).collect()
    for r in rows:
        assert r.back == (r.text or "") and r.n == len(r.i) == len(r.s) and [x.id for x in r.s] == r.i
        assert not r.s or (r.s[0].start == 0 and r.s[-1].end == len(r.text.encode()) and all(a.end == b.start for a, b in zip(r.s, r.s[1:])))
    assert tk.encode_documents(docs).columns == ["doc_id", "ids"] and tk.encode_documents(docs.limit(0)).count() == 0


def test_mix(spark):
    r = random.Random(3)
    sizes = {"big": 900, "mid": 300, "small": 40, "none": 50}
    docs = [(i, s, " ".join(["word"] * r.randrange(5, 30))) for s, n in sizes.items() for i in range(n)] + [(1, None, "x"), (2, "big", None), (3, "big", "")]
    docs = spark.createDataFrame([(k, s, t) for k, (_, s, t) in enumerate(docs)], "doc_id bigint, source string, text string")
    mix = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 5), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    rows = {x.source: x for x in mx.reached_shares(docs, mix).collect()}
    assert rows["absent"].rate == 0 and rows["none"].mixed_tokens == 0 and rows[None].mixed_tokens == 0
    for s, cap in (("big", 1), ("mid", 2), ("small", 5)):
        assert rows[s].rate <= cap and rows[s].most_copies <= cap and abs(rows[s].share_reached + rows[s].short - rows[s].share) < 0.06
    assert rows["small"].rate == 5 and rows["small"].short > 0.01  # its cap forbids its share
    few = {x.source: x for x in mx.reached_shares(docs, mix, total=8000).collect()}
    assert all(few[s].short < 0.03 and abs(few[s].mixed_tokens / 8000 - few[s].share) < 0.05 for s in ("big", "mid", "small"))
    tiny = spark.createDataFrame([(i, "huge", "word " * 50) for i in range(400)] + [(1000, "tiny", "word")], "doc_id bigint, source string, text string")
    halves = spark.createDataFrame([("huge", 0.5, 1), ("tiny", 0.5, 3)], "source string, target_share double, max_repeats int")
    rows = {x.source: x for x in mx.reached_shares(tiny, halves).collect()}
    assert rows["huge"].rate > 0.49 and rows["tiny"].rate == 3 and rows["tiny"].short > 0.49  # a tiny source leaves the others alone
    used = mx.mixed(docs, mix).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(x.n == x.m for x in used)
    assert mx.mixed(docs.limit(0), mix).count() == 0 and mx.mixed(docs, mix.limit(0)).count() == 0


CUT = [("He said (and", "open"), ("A full one. The next is torn of", None), ("It went on … [+123 chars]", "mark"), ("It went on [...]", "mark"), ("Broken �", "broken"), ("Fish &am", "broken"), ("“Is it", "open"), ("Costs were Rs.", None), ("Torn <b", "open")]
WHOLE = ["All done.", "Done! ☀️", "Done. — the owners", "Done. (IH/desk)", "Done. [video]", "Done. #a #b", "Done. Read on at https://a.example/more", "Done. Photo: staff", "Done. « Ayubo! »", "“Who pays?”", "3 < 4 holds.", "", "  "]


@pytest.mark.parametrize("text,evidence", CUT)
def test_cut_structure(text, evidence):
    assert tr.read_structure(text)[:2] == (evidence, False)


@pytest.mark.parametrize("text", WHOLE)
def test_whole_structure(text):
    assert tr.read_structure(text)[:2] == (None, True)


def test_cut_texts(spark):
    whole = [("summary", f"w{i}", "s", f"Story {i} ended well. Next came rain.", 1) for i in range(20)]
    torn = [("summary", "t1", "s", "Story 3 ended well. Next ca", 1), ("summary", "t1", "s", "Story 3 ended well. Next ca", 1), ("summary", "t2", None, "Story (four", 1), ("summary", None, "s", None, 1), ("summary", "e", "s", "", 1)]
    titles = [("title", f"n{i}", "s", f"Why the old bridge of Town{i} was closed", 1) for i in range(40)] + [("title", "x1", "s", "Why the old brid", 1), ("title", "x2", "s", "Why the old bridge of", 1)]
    rows = spark.createDataFrame(whole + torn + titles, "field_name string, id string, source string, value string, evidence int")
    got = {(r.field_name, r.id) for r in tr.cut_texts(rows).where(~F.col("doubt")).collect()}
    assert got == {("summary", "t1"), ("summary", "t2"), ("title", "x1"), ("title", "x2")}
    assert tr.cut_texts(rows.limit(0)).count() == 0
    found = spark.createDataFrame([("title", "a", "Why the", False), ("title", "b", "Why", False), ("title", "c", "Odd", True), ("title", "d", "Old bri", True)], "field_name string, id string, value string, doubt boolean")
    links = spark.createDataFrame([("title", "a", "Why the old"), ("title", "b", "Why"), ("title", "d", "Old bridge")], "field_name string, id string, whole string")
    assert {r.id for r in tr.confirmed(found, links).collect()} == {"a", "d"}


def _found(spark, rows):
    return {r.id for r in tr.cut_texts(spark.createDataFrame(rows, "field_name string, id string, source string, value string")).where(~F.col("doubt")).collect()}


NOUNS = "harbour kitchen veranda lantern market museum garden bridge shuttle pavilion orchard lagoon balcony courtyard workshop ferry".split()


def _sentences(r, n):
    return " ".join(f"The {r.choice(NOUNS)} of the {r.choice(NOUNS)} was {r.choice(['rebuilt', 'repainted', 'widened', 'closed'])} after the {r.choice(NOUNS)} {r.choice(['flooded', 'burned', 'collapsed'])}." for _ in range(n))


@pytest.mark.parametrize("share", [0.1, 0.6, 0.9])
def test_cuts_are_found_whatever_their_share(spark, share):
    r = random.Random(11)
    rows, want = [], set()
    for i in range(100):
        text = _sentences(r, 3)
        if i < share * 100:
            text = text[: 80 + r.randrange(30)].rstrip(" .")
            want.add(f"a{i}")
        rows.append(("f", f"a{i}", "s", text))
    assert _found(spark, rows) == want


@pytest.mark.parametrize("share", [0.2, 0.4, 0.7])
def test_limits_are_found_per_source_whatever_their_share(spark, share):
    r = random.Random(12)
    rows, want = [], set()
    title = lambda: f"Why the {r.choice(NOUNS)} of {''.join(r.choice('aeioubcdmnrst') for _ in range(r.randrange(4, 9))).title()} beside the {r.choice(NOUNS)} {r.choice(['reopened', 'vanished', 'burned', 'mattered'])} {r.choice(['today', 'again', 'early', 'quietly'])}"
    for s, limit in (("long", 900), ("short", 40)):  # one source cuts at 40 code points, the other not
        for i in range(200):
            text = title()
            if s == "short" and i < share * 200:
                text = text[:limit]
                want.add(f"{s}{i}")
            elif s == "short":
                text = f"{r.choice(NOUNS).title()} {r.choice(NOUNS)}s {r.choice(['reopened', 'burned'])} {r.choice(['today', 'again', 'early'])}"
            rows.append(("t", f"{s}{i}", s, text))
    assert _found(spark, rows) >= want and len(_found(spark, rows) - want) <= 4


@pytest.mark.parametrize("threshold,least,split", [(0.7, 12, 50_000), (0.7, 12, 3), (0.8, 1, 50_000), (0.5, 3, 50_000)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, threshold, least, split):
    monkeypatch.setattr(nd, "SPLIT", split)  # a small one salts most buckets
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "a", "of"] * 5
    base = [sorted({r.choice(words) for _ in range(r.randrange(1, 60))}) for _ in range(60)]
    sets = list(base)
    for b in base:
        for _ in range(3):
            s = set(b)
            for _ in range(r.randrange(0, 8)):
                s ^= {r.choice(words)}
            sets.append(sorted(s))
    rows = [(f"i{k}", s) for k, s in enumerate(sets)] + [("i0", sets[0]), ("dup", sets[1]), (None, sets[2]), ("empty", [])]
    docs = spark.createDataFrame(rows, "id string, words array<string>")
    _, members, pairs = nd.near_duplicates(docs, threshold, least)
    got = {(p.id_a, p.id_b) for p in nd.expanded_pairs(members, pairs).collect()}
    named = {(i, tuple(s)) for i, s in rows if i and len(s) >= least}
    want = {tuple(sorted((a, b))) for (a, s), (b, q) in itertools.combinations(sorted(named), 2) if a != b and len(set(s) & set(q)) / len(set(s) | set(q)) >= threshold}
    assert got == want and want


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "id string, words array<string>")
    _, members, pairs = nd.near_duplicates(none, 0.7, 12)
    assert nd.expanded_pairs(members, pairs).count() == 0
    row = spark.createDataFrame([("The  ÄB-c d3", None), (None, None)], "t string, s string").select(nd.distinct_tokens(F.col("t"), F.col("s")).alias("w")).collect()
    assert [x.w for x in row] == [["b", "c", "d3", "the"], []]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (200, 50)]
    nodes = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p} | {999}], "rec bigint")
    got = {r.rec: r.root for r in nd.components(nodes, spark.createDataFrame(pairs, "rec_a bigint, rec_b bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and got[200] == got[50] == 50 and got[999] == 999


ADDRESSES = [
    ("a", "12 Mahobegama Road, Hikkala 07700, Sri Lanka", "Hikkala"), ("b", "No. 12, Mahobegama Rd., Hikkala", "hikkala city"), ("c", "Mahobegma Rd 12, 07700 Hikkala", "Hikkala"), ("d", "Level 3, Sri Lanka, Hikkala 07700, Mahobegama Road, No.12", "Hikkala, 07700"),
    ("e", "12A Mahobegama Road, Hikkala", "Hikkala"), ("f", "12 Mahobegama Lane, Hikkala", "Hikkala"), ("g", "12 Mahobegama Road, Galmoya", "Galmoya"), ("h", "Mahobegama Road, Hikkala", "Hikkala"), ("i", None, "Hikkala"), ("j", "", None), ("k", "c/o Main Office, #12 A, Mahobegama Road, Hikkala", "Hikkala"),
    ("l", "7 / 9 Old Customs Lane, Hikkala", "Hikkala"), ("m", "7/9 Old Customs Ln Hikkala LK", "Hikkala"), ("b", "No. 12, Mahobegama Rd., Hikkala", "hikkala city"), ("n", "12 Mahobegama Road", "Hikkala"),
]


def test_addresses(spark):
    # other houses of the same streets are what the rewrites are mined from
    more = [(f"x{i}{v}", f"{i} {s} {k}, Hikkala", "Hikkala") for i in range(20, 40) for s in ("Mahobegama", "Old Customs", "Clock Tower") for v, k in enumerate(("Road", "Rd") if i % 2 else ("Lane", "Ln"))]
    rows = spark.createDataFrame([(*r, "clash") for r in ADDRESSES + more], "id string, address string, city_name string, town string")
    towns = spark.createDataFrame([("Hikkala",), ("Galmoya",)], "name string")
    houses, rewrites = ad.mined(ad.parsed(rows, towns))
    new = {(r.word, r.better) for r in rewrites.collect()}
    assert {("rd", "road"), ("ln", "lane"), ("mahobegma", "mahobegama")} <= new
    got = {(p.id_a, p.id_b) for p in ad.same_house(houses).collect() if not p.id_a.startswith("x")}
    assert got == {*itertools.combinations("abcdn", 2), ("e", "k"), ("l", "m")}
    assert ad.same_house(ad.mined(ad.parsed(rows.limit(0), towns))[0]).count() == 0


def test_entities(spark):
    r = random.Random(9)
    brands = [f"{a} {b}" for a in ("Amber", "Coral", "Heron", "Velvet", "Lotus", "Jade") for b in ("Ridge", "Haven", "Lantern", "Falls", "Grove")]
    rows, want = [], set()
    for k in range(120):
        name, town, lat, lng = r.choice(brands), r.choice(["Hikkala", "Galmoya", "Negamba"]), 6 + r.random(), 80 + r.random()
        street = f"{r.randrange(1, 900)} Street{k} Road"
        ids = []
        for s in r.sample(["p", "q", "w"], r.choice([1, 2, 3])):
            i = f"{s}{k:03d}"
            ids.append(i)
            known = r.random() < 0.8
            rows.append((i, s, r.choice([f"{name} Hotel", f"Hotel {name}", name.upper() + " HOTEL"]), f"{street}, {town}", town, lat + r.uniform(-1e-4, 1e-4) if known else None, lng if known else 0.0, f"https://{name.replace(' ', '').lower()}.example/{k}" if r.random() < 0.7 else None, "x"))
        want |= {tuple(sorted(p)) for p in itertools.combinations(ids, 2)}
    hotels = spark.createDataFrame(rows + rows[:5], "id string, source string, name string, address string, city_name string, lat double, lng double, website string, brand string")
    houses = ad.parsed(hotels, spark.createDataFrame([("Hikkala",)], "name string"))
    found = em.matches(hotels, houses)
    got = {(m.id_a, m.id_b) for m in found.collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(got)
    assert found.where("confidence < 0 or confidence > 1").count() == 0
    assert em.matches(hotels.limit(0), houses.limit(0)).count() == 0
    empty = spark.createDataFrame([("a", "p", None, None, None, None, None, None), ("b", "q", None, None, None, None, None, None)], "id string, source string, name string, address string, city_name string, lat double, lng double, website string")
    assert em.matches(empty).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_retrieval_equals_brute_force_top_k(spark, k):
    r = random.Random(4)
    rare, often = [f"t{i}" for i in range(40)], [f"c{i}" for i in range(6)]
    rows = [(f"r{n:03d}", r.choice("stu"), None, None, "", ["x"], sorted({(r.randrange(2), t) for t in {r.choice(rare) if r.random() < r.choice([0.0, 0.3, 0.7]) else r.choice(often) for _ in range(r.randrange(2, 10))}})) for n in range(150)]
    rows += [(f"l{n}{s}", s, None, None, "", ["x"], [(0, f"p{n}{j}") for j in range(4)] + [(1, f"q{n}{s}{j}") for j in range(6)]) for n in range(5) for s in "st"]
    records = em.weighted(spark.createDataFrame(rows, "id string, source string, lat double, lng double, site string, brand array<string>, terms array<struct<kind:int,term:string>>")).cache()
    all_ = {x.rec: x for x in records.collect()}
    weight = lambda ps: sum((p >> 1) & 8191 for p in ps)
    share = {(q.rec, d.rec): weight(set(q.packed) & set(d.packed)) for q in all_.values() for d in all_.values() if q.source != d.source}
    sure = {(q, d) for (q, d), x in share.items() if x >= em.FLOOR * min(all_[q].own, all_[d].own)}
    held = {q for q, _ in sure}
    fit = {(q, d): x for (q, d), x in share.items() if (q, d) in sure or any(r not in held and x >= em.LOWER * all_[r].own for r in (q, d))}
    want = set()
    for q, s in itertools.product(all_, "stu"):
        best = sorted((-x * all_[d].length, d) for (a, d), x in fit.items() if a == q and all_[d].source == s)[:k]
        want |= {(q, d, share[q, d]) for _, d in best}
    assert {(x.q, x.d, x.score) for x in em.retrieved(records, k).collect()} == want and len(want) > 100
    assert any((q, d) not in sure for q, d, _ in want)  # some records had to look further


@pytest.fixture(scope="module")
def tagger():
    return pe.Tagger(pe.read_model())


def _pieces(tagger, pieces):
    """Pieces found, pieces marked."""
    text, want = "", set()
    for part, kind in pieces:
        if kind:
            want.add((len(text), len(text) + len(part), kind))
        text += part
    return set(tagger.spans([text])[0]), want


def test_training_learns_and_the_file_belongs_to_the_table():
    small = pe.Tagger(pe.trained(texts=600, passes=6))
    pairs = [_pieces(small, p) for p in labelled_texts(200, seed=99)]
    hit, gold, found = sum(len(g & w) for g, w in pairs), sum(len(w) for _, w in pairs), sum(len(g) for g, _ in pairs)
    assert hit / gold > 0.8 and hit / found > 0.8
    import numpy as np

    with np.load(pe.FILE) as kept:
        assert int(kept["fingerprint"]) == pe.fingerprint(), "run python -m isleweave.llm.personal"


def test_tagger_on_held_out_contexts_and_names(tagger):
    """Recall and precision per kind on sentences that share neither context nor name with the labelled table."""
    from collections import Counter

    hit, gold, found = Counter(), Counter(), Counter()
    for line in HELD_OUT.strip().split("\n"):
        parts = [(m.group(3) or m.group(4), m.group(2)) for m in re.finditer(r"(⟦(\w+)\|([^⟧]*)⟧)|([^⟦]+)", line)]
        got, want = _pieces(tagger, parts)
        gold.update(k for *_, k in want), found.update(k for *_, k in got), hit.update(k for *_, k in got & want)
    for kind in pe.KIND_NAMES:
        assert hit[kind] / gold[kind] > 0.85 and hit[kind] / found[kind] > 0.85, (kind, hit, gold, found)
    assert sum(hit.values()) >= 0.9 * sum(gold.values()) and sum(hit.values()) >= 0.9 * sum(found.values())


def test_no_label_stands_in_the_tables():
    import glob

    import pandas as pd

    texts = {t for f in glob.glob("/root/testdata/*/documents.parquet") for t in pd.read_parquet(f, columns=["text"])["text"].dropna()}
    blob = "\n".join(texts)
    slot = re.compile(r"\{\{|\}\}|\{\w+\}|<\w+>")
    for row in [x for part in pl.rows() for x in part]:
        for fixed in slot.split(row):
            assert len(fixed.strip()) < 12 or fixed.strip() not in blob, (row, fixed)


def test_tagger_on_odd_texts(tagger):
    odd = ["", None, "   ", "\x00<|endoftext|>\n", "a" * 20000, "x. " * 5000, "Write to ann-b@mail.example.net for the lamp."]
    got = tagger.spans(odd)
    assert [len(g) for g in got] == [0, 0, 0, 0, 0, 0, 1] and odd[-1][slice(*got[-1][0][:2])] == "ann-b@mail.example.net"
    together = tagger.spans(odd * 3)
    assert together == got * 3  # decoding a batch is decoding each


def test_viterbi_is_best(tagger):
    import numpy as np

    model = pe.Model()
    rng = np.random.default_rng(0)
    model.links[model.links > -1e3] = rng.normal(size=(model.links > -1e3).sum())
    scores = rng.normal(size=(3, 4, len(pe.LABELS))).astype(np.float32)
    sizes = np.array([4, 3, 1])
    for row, (s, n) in enumerate(zip(pe._viterbi(scores, sizes, model), sizes)):
        value = lambda path: scores[row, 0, path[0]] + model.first[path[0]] + sum(model.links[a, b] + scores[row, t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))
        best = max(itertools.product(range(len(pe.LABELS)), repeat=int(n)), key=value)
        assert abs(value(list(s)) - value(best)) < 1e-3


def test_personal_queries(spark):
    docs = spark.createDataFrame([(1, "Tel +94 79 555 3004 (evenings only). Write to ann.b@mail.example.net for the lamp.", "c"), (2, None, "c"), (3, "", "c"), (1, "Nothing here.", "c")], "doc_id bigint, text string, kind string")
    rows = {(r.doc_id, r.kind, r.found_text) for r in pe.personal_spans(docs).collect()}
    assert rows == {(1, "phone", "+94 79 555 3004"), (1, "email", "ann.b@mail.example.net")}
    out = [r.text for r in pe.redacted("text", docs).collect()]
    assert out == ["Tel [PHONE] (evenings only). Write to [EMAIL] for the lamp.", None, "", "Nothing here."]
    assert pe.personal_spans(docs.limit(0)).count() == 0


def test_nothing_outside_imports_this_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "isleweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", "\n".join(x for x in p.read_text().splitlines() if "import" in x)), p


def test_classes_of_a_crowded_house(spark):
    rows = [(f"i{k:03d}", "t", "1", ["main", "road"]) for k in range(150)] + [(f"j{k}", "t", str(k), ["side", "lane"]) for k in range(10)] + [("i000", "t", "3", ["side", "lane"])]
    got = {(r.id, r.house_id, r.records) for r in ad.house_classes(spark.createDataFrame(rows, "id string, town string, number string, words array<string>")).collect()}
    assert {x for x in got if x[1] == "i000" and x[2] == 150} == {(f"i{k:03d}", "i000", 150) for k in range(150)} and ("j3", "i000", 2) in got and len(got) == 161


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAST", 10)  # spreads the links of every node
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 430)]
    nodes = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p}], "rec bigint")
    got = {r.rec: r.root for r in nd.components(nodes, spark.createDataFrame(pairs, "rec_a bigint, rec_b bigint")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == 400 for i in range(400, 431))
