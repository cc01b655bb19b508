"""Explained retrieval for many asks at once: filters, weighted sub-scores, reasons and the context of an answer.

An ask is one row: a city, bounds, wishes, weights and, where one is active, an event with the asker's preference.
Questions with equal intents are one ask, so that its candidates are scored once. No pair of an ask and a candidate is a
row: blocks of asks meet blocks of their city's candidates as matrices, first for the ranges of values, then for the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_km
from ..plans.lineage import cut
from ..plans.shipping import ship
from ..plans.skew import join_small
from . import scoring as sc

#: What an event inside its zone takes from the disruption score of those who avoid it, by its severity.
EVENT_PENALTY = {"high": 0.45, "medium": 0.30, "low": 0.15}
OTHER_PENALTY = 0.30
EVENT = "struct<name:string,lat:double,lng:double,radius_km:double,severity:string>"
#: What an ask is made of, besides ``ask_id``: the fields of an intent that ranking reads.
ASKED = ("city", "amenities", "attractions", "min_price", "max_price", "min_rating", "min_star", "proximity", "access", "avoid_traffic", "sort")
RANGES = {"km": "km", "travel": "delay", "price": "price", "event_km": "event_km"}
#: Candidates and asks in a block, and asks of it that are compared at once.
CANDIDATES, ASKS, AT_ONCE = 2048, 1024, 64
BOUNDS = ("min_rating", "min_star", "min_price", "max_price")


def asks_of(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct asks (``ask_id`` and the fields of an intent), and ``question_id, ask_id``.

    ``questions`` has ``question_id, i`` (a struct of ``functions.text.intent``). Rows with a null id or without a
    city ask nothing.
    """
    fields = F.struct(*[F.col(f"i.{c}").alias(c) for c in ASKED])
    rows = questions.where(F.col("question_id").isNotNull() & (F.coalesce("i.city", F.lit("")) != "")).select("question_id", fields.alias("f")).withColumn("ask_id", F.md5(F.to_json("f")))
    return rows.groupBy("ask_id").agg(F.first("f").alias("f")).select("ask_id", "f.*"), rows.select("question_id", "ask_id").distinct()


def with_weights(asks: DataFrame, persona: str | None = None, event: dict | None = None) -> DataFrame:
    """``asks`` with ``weights``, ``event`` and ``preference``: of each intent, or of a persona, which also sets a proximity that it has a preference for.

    An unknown persona counts as none. ``event`` has ``name, lat, lng, radius_km, severity``; it carries weight only
    for a persona that seeks or avoids events.
    """
    known = sc.PERSONAS.get((persona or "").lower())
    if known is None:
        weights, preference = sc.intent_weights({c: F.col(c) for c in ASKED}) | {"event": F.lit(0.0)}, "neutral"
    else:
        weights, preference = {k: F.lit(w) for k, w in sc.persona_weights(persona, event is not None).items()}, known[1]
        if known[2] != "any":
            asks = asks.withColumn("proximity", F.lit(known[2]))
    happens = F.lit(None) if event is None else F.struct(*[F.lit(event[k]).alias(k) for k in ("name", "lat", "lng", "radius_km", "severity")])
    return asks.withColumn("weights", F.struct(*[w.alias(k) for k, w in weights.items()])).withColumn("event", happens.cast(EVENT)).withColumn("preference", F.lit(preference))


def blocks(candidates: DataFrame, asks: DataFrame, key: str) -> DataFrame:
    """``c, a``: blocks (lists of rows) of ``candidates`` (``id``) beside blocks of ``asks`` (``ask_id``) of the same ``key``; each pair meets in one row."""
    ship(candidates.sparkSession)
    many = lambda rows, n, name: rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = cut(many(candidates, CANDIDATES, "__cs").join(many(asks, ASKS, "__as"), key))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    c = join_small(candidates, sizes, [key]).groupBy(key, block("id", "__cs").alias("__c")).agg(F.collect_list(F.struct(*candidates.columns)).alias("c"))
    a = join_small(asks, sizes, [key]).groupBy(key, "__cs", block("ask_id", "__as").alias("__a")).agg(F.collect_list(F.struct(*asks.columns)).alias("a"))
    return c.join(a.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__cs") - 1))), [key, "__c"]).select("c", "a")


class Block:
    """Both sides of a row of ``blocks`` as arrays; candidates in the order of their ids."""

    def __init__(self, c, a) -> None:
        import numpy as np

        ids = c.field("id").to_pylist()
        self.order = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=np.int64)
        self.ids, self.asks, self.c, self.a = [ids[i] for i in self.order], a.field("ask_id").to_pylist(), c, a

    def of(self, name: str, unknown: float = float("nan")):
        """A number of each candidate."""
        import numpy as np

        v = self.c.field(name).to_numpy(zero_copy_only=False).astype(float)[self.order]
        return np.where(np.isnan(v), unknown, v)

    def asked(self, name: str, unknown: float = float("nan")):
        """A number of each ask, as a column."""
        import numpy as np

        v = self.a.field(name).to_numpy(zero_copy_only=False).astype(float)[:, None]
        return np.where(np.isnan(v), unknown, v)

    def bounds(self):
        """A row of the four bounds per ask; those it does not have let everything pass."""
        import numpy as np

        return np.hstack([self.asked(b, np.inf if b == "max_price" else -np.inf) for b in BOUNDS])

    def passing(self, strict: bool):
        """From rows of bounds to which candidates pass; unknown values pass unless ``strict``, then only where nothing is bound."""
        import numpy as np

        low = -np.inf if strict else np.inf
        rating, star, price, cost = self.of("rating5", low), self.of("star", low), self.of("price", low), self.of("price", -low)
        return lambda b: (rating >= b[:, :1]) & (star >= b[:, 1:2]) & (price >= b[:, 2:3]) & (cost <= b[:, 3:])

    def matched(self, wanted: str, have: str):
        """From a slice of asks to how many of the words of ``wanted`` are part of any word in ``have``, per ask and candidate."""
        import numpy as np

        def counts(column):
            words = column.flatten().to_pylist()
            place = {w: i for i, w in enumerate(dict.fromkeys(w for w in words if w is not None))}
            rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
            out = np.zeros((len(column), len(place)))
            known = [i for i, w in enumerate(words) if w is not None]
            np.add.at(out, (rows[known], np.array([place[words[i]] for i in known], dtype=np.int64)), 1.0)
            return out, list(place)

        (n, asked), (m, own) = counts(self.a.field(wanted)), counts(self.c.field(have))
        parts = np.array([[float(w in x) for w in asked] for x in own]).reshape(len(own), len(asked))
        hit = ((m[self.order] @ parts) > 0).astype(float).T
        return lambda at: n[at] @ hit


def each(batches: Iterator, work: Callable[[Block], Iterator[tuple]], names: list[str]) -> Iterator:
    """Rows that ``work`` makes of every row of ``blocks``, as batches of Arrow."""
    import numpy as np
    import pyarrow as pa

    with np.errstate(all="ignore"):  # what divides by nothing is not taken
        for batch in batches:
            for c, a in zip(batch.column("c"), batch.column("a")):
                for columns in work(Block(c.values, a.values)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


ENDS = [f"{x}_{n}" for n in RANGES for x in ("low", "high")]


def _ends(batches: Iterator) -> Iterator:
    """Per ask: how many candidates of a block pass, and the ends of their values."""
    import numpy as np
    import pyarrow as pa

    def work(b: Block) -> Iterator[tuple]:
        every, back = np.unique(b.bounds(), axis=0, return_inverse=True)
        passes, out = b.passing(False), []
        ends = [(f, v) for n in RANGES for f, v in ((np.min, b.of(n, np.inf)), (np.max, b.of(n, -np.inf)))] + [(np.max, b.of("n_amen", -np.inf))]
        for i in range(0, len(every), AT_ONCE):
            ok = passes(every[i : i + AT_ONCE])
            edge = [f(np.where(ok, v, np.inf if f is np.min else -np.inf), axis=1) if np.isfinite(v).any() else np.full(len(ok), np.inf) for f, v in ends]
            out.append(np.vstack([ok.sum(axis=1), *edge]))
        found = np.hstack(out)[:, back.reshape(-1)]
        empty = [np.isinf(x) for x in found[1:]]
        yield b.asks, found[0].astype(np.int64), *[pa.array(x, mask=m) for x, m in zip(found[1:], empty)]

    return each(batches, work, ["ask_id", "passing", *ENDS, "high_amen"])


def _first(limit: int) -> Callable[[Iterator], Iterator]:
    """Per ask: the best of a block, by the score of ``retrieve`` in the same order of operations, in ten-thousandths."""

    def work(b: Block) -> Iterator[tuple]:
        import numpy as np

        passes, bounds, count = b.passing(False), b.bounds(), len(b.ids)
        rating, star, calm, n_amen = 0.20 * b.of("rating5", 0.0) / 5, 0.20 * b.of("star", 0.0) / 5, b.of("calm"), b.of("n_amen")
        amenities, attractions = b.matched("amenities", "amen"), b.matched("attractions", "attr")
        value = {n: b.of(n) for n in RANGES}
        back = np.arange(count)[::-1]
        for i in range(0, len(b.asks), AT_ONCE):
            at = slice(i, i + AT_ONCE)
            of = lambda name, unknown=np.nan: b.asked(name, unknown)[at]

            def better(n):
                low, high = of(f"low_{n}"), of(f"high_{n}")
                return np.where(np.isnan(value[n]), 0.5, np.where(high <= low, 1.0, 1 - (value[n] - low) / (high - low)))

            near, wanted, sights, most = better("km"), of("n_amenities"), of("n_attractions"), of("high_amen")
            amen = np.where(wanted > 0, amenities(at) / wanted, np.where(most > 0, n_amen / most, 0.5))
            facility = 0.40 * amen + 0.20 * np.where(sights > 0, attractions(at) / sights, 0.0) + rating + star
            active, km, event, calmer = of("active") > 0, value["event_km"], 0.0, calm
            if active.any():
                low, high, seeks, avoids = of("low_event_km"), of("high_event_km"), of("seeks") > 0, of("avoids") > 0
                inside = km <= of("radius")
                far = np.where(high <= low, 0.5, (km - low) / (high - low))
                event = np.where(np.isnan(km), 0.5, np.where(seeks, np.minimum(1.0, 1 - far + np.where(inside, 0.15, 0.0)), np.where(avoids, far, 0.5)))
                event = np.where(active, event, 0.0)
                calmer = np.where(active & inside & avoids, np.maximum(0.0, calm - of("penalty")), calm)
            parts = {"spatial": np.where(of("far") > 0, 1 - near, near), "accessibility": better("travel"), "facility": facility, "economic": better("price"), "disruption": calmer}
            score = event * of("w_event")
            for k in sc.WEIGHTS:
                score = score + parts[k] * of(f"w_{k}")
            n = np.clip(np.nan_to_num(np.floor(score * 1e4 + 0.5), posinf=2.0**40, neginf=-(2.0**40)), -(2.0**40), 2.0**40)
            key = np.where(passes(bounds[at]) | (of("filters_relaxed") > 0), n * count + back, -np.inf)
            best = np.argpartition(-key, limit - 1, axis=1)[:, :limit] if count > limit else np.broadcast_to(np.arange(count), key.shape)
            rows = np.repeat(np.arange(len(key)), best.shape[1])
            cols = best.reshape(-1)
            kept = np.isfinite(key[rows, cols])
            rows, cols = rows[kept], cols[kept]
            if len(rows):
                yield [b.asks[i + x] for x in rows], [b.ids[x] for x in cols], n[rows, cols]

    return lambda batches: each(batches, work, ["ask_id", "id", "n"])


def _matched(asked: Column, have: Column) -> Column:
    """How many of the asked words are part of any element of ``have``."""
    return F.size(F.filter(asked, lambda a: F.exists(have, lambda x: F.contains(F.lower(x), F.lower(a)))))


def _penalty() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_PENALTY.items() for x in kv]), F.col("event.severity")), F.lit(OTHER_PENALTY))


def _calm() -> Column:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return sc.disruption(flag("heavy"), flag("moderate"), F.col("events"), F.col("worst"))


def _event_km() -> Column:
    return F.when(F.col("known") & F.col("event").isNotNull(), distance_km(F.col("event.lat"), F.col("event.lng"), F.col("lat"), F.col("lng")))


def _ready(candidates: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asks`` with ``filters_relaxed`` and the ends of the values that they compare; and what ranking needs of the candidates per city and event (``__at``)."""
    asks = cut(asks.where(F.col("city").isNotNull()).withColumn("__at", F.md5(F.to_json(F.struct("city", "event")))))
    near = join_small(candidates, asks.select("__at", "city", "event").dropDuplicates(["__at"]), ["city"])
    double = lambda c, name: c.cast("double").alias(name)
    near = near.withColumn("event_km", _event_km()).select("__at", "id", *[double(F.col(c), n) for n, c in RANGES.items()], *[double(F.col(c), c) for c in ("rating5", "star")], double(F.size("amen"), "n_amen"), double(_calm(), "calm"), *[F.transform(c, F.lower).alias(c) for c in ("amen", "attr")])
    near = cut(near)
    end = lambda c: F.min(c) if c.startswith("low") else F.max(c)
    whole = near.groupBy("__at").agg(*[(F.min if x == "low" else F.max)(n).alias(f"all_{x}_{n}") for n in RANGES for x in ("low", "high")], F.max("n_amen").alias("all_high_amen"))
    found = blocks(near.drop("amen", "attr", "calm"), asks.select("__at", "ask_id", *BOUNDS), "__at").mapInArrow(_ends, f"ask_id string, passing bigint, {', '.join(f'{c} double' for c in (*ENDS, 'high_amen'))}")
    found = found.groupBy("ask_id").agg(F.sum("passing").alias("passing"), *[end(c).alias(f"ok_{c}") for c in (*ENDS, "high_amen")])
    none = F.col("passing") == 0
    return cut(asks.join(whole, "__at").join(found, "ask_id").select(*asks.columns, none.alias("filters_relaxed"), *[F.when(none, F.col(f"all_{c}")).otherwise(F.col(f"ok_{c}")).alias(c) for c in (*ENDS, "high_amen")])), near


def retrieve(candidates: DataFrame, asks: DataFrame, limit: int = 10) -> DataFrame:
    """``ask_id, city, rank, id, score``, the sub-scores, ``reasons``, ``filters_relaxed`` and the candidate's values: the best of each ask.

    ``candidates`` has ``id, city, lat, lng, known, km, delay, heavy, moderate, worst, events, rating5, star, price,
    amen, attr``; ``asks`` comes from ``with_weights``. Where no candidate passes an ask's bounds, all of its city are
    kept and ``filters_relaxed`` is true. Unknown values count as middling. Ties go to the lesser id. Asks of cities
    without candidates give no row.

    Scale: an ask meets the candidates of its city only, block by block, once for the ends of values and once for the
    best; only the best become rows.
    """
    ready, near = _ready(candidates, asks)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    weights = [F.col(f"weights.{k}").alias(f"w_{k}") for k in (*sc.WEIGHTS, "event")]
    lower = lambda c: F.transform(c, F.lower).alias(c)
    number = lambda c, name: F.coalesce(c, F.lit(False)).cast("double").alias(name)
    slim = ready.select(
        "__at", "ask_id", *BOUNDS, lower("amenities"), lower("attractions"), F.size("amenities").alias("n_amenities"), F.size("attractions").alias("n_attractions"), *ENDS, "high_amen", number(F.col("filters_relaxed"), "filters_relaxed"), number(F.col("proximity") == "far", "far"), *weights,
        number(F.col("event").isNotNull() & (F.col("weights.event") > 0), "active"), number(F.col("preference") == "seek", "seeks"), number(F.col("preference") == "avoid", "avoids"), F.col("event.radius_km").alias("radius"), _penalty().alias("penalty"),
    )
    found = blocks(near, slim, "__at").mapInArrow(_first(limit), "ask_id string, id string, n double")
    best = sc.top_k(found, ["ask_id"], [F.col("n").desc(), F.col("id").asc()], limit).select("ask_id", "id").distinct()
    rows = best.join(ready, "ask_id").join(candidates, ["city", "id"])
    rows = rows.withColumn("event_km", _event_km())
    better = lambda n: sc.lower_is_better(F.col(RANGES[n]), F.col(f"low_{n}"), F.col(f"high_{n}"))
    near = better("km")
    amen, attr = F.size("amenities"), F.size("attractions")
    rows = rows.withColumn("n_amen", _matched(F.col("amenities"), F.col("amen"))).withColumn("n_attr", _matched(F.col("attractions"), F.col("attr")))
    amen_match = F.when(amen > 0, F.col("n_amen") / amen).when(F.col("high_amen") > 0, F.size("amen") / F.col("high_amen")).otherwise(0.5)
    facility = 0.40 * amen_match + 0.20 * F.when(attr > 0, F.col("n_attr") / attr).otherwise(0.0) + 0.20 * F.coalesce("rating5", F.lit(0.0)) / 5 + 0.20 * F.coalesce("star", F.lit(0.0)) / 5
    in_zone = F.coalesce(F.col("event_km") <= F.col("event.radius_km"), F.lit(False))
    active = F.col("event").isNotNull() & (F.col("weights.event") > 0)
    far = F.when(F.col("high_event_km") <= F.col("low_event_km"), 0.5).otherwise((F.col("event_km") - F.col("low_event_km")) / (F.col("high_event_km") - F.col("low_event_km")))
    affinity = F.when(~active, 0.0).when(F.col("event_km").isNull(), 0.5).when(F.col("preference") == "seek", F.least(F.lit(1.0), 1 - far + F.when(in_zone, 0.15).otherwise(0.0))).when(F.col("preference") == "avoid", far).otherwise(0.5)
    rows = rows.withColumn("avoided", active & in_zone & (F.col("preference") == "avoid")).withColumn("calm", _calm())
    rows = rows.withColumn("spatial", F.when(F.col("proximity") == "far", 1 - near).otherwise(near)).withColumn("accessibility", better("travel")).withColumn("facility", facility).withColumn("economic", better("price"))
    rows = rows.withColumn("disruption", F.when(F.col("avoided"), F.greatest(F.lit(0.0), F.col("calm") - _penalty())).otherwise(F.col("calm"))).withColumn("event_score", affinity)
    score = sum((F.col(k) * F.col(f"weights.{k}") for k in sc.WEIGHTS), F.col("event_score") * F.col("weights.event"))
    whole, tenth = lambda c: F.format_string("%.0f", F.rint(c)), lambda c: F.format_string("%.1f", c)
    ratio = lambda n, of: F.concat(F.col(n).cast("string"), F.lit("/"), F.size(of).cast("string"))
    name, away = F.col("event.name"), tenth(F.col("event_km"))
    # fixed values: the wording of reasons
    reasons = [
        F.when((F.col("proximity") == "close") & F.col("km").isNotNull() & (F.col("spatial") > 0.7), F.lit("central / walkable location")),
        F.when(F.col("delay").isNotNull() & (F.col("accessibility") > 0.7), F.concat(F.lit("fast access (~"), whole(F.col("delay")), F.lit(" min in traffic)"))),
        F.when((amen > 0) & (F.col("n_amen") > 0), F.concat(F.lit("matches "), ratio("n_amen", "amenities"), F.lit(" requested amenities"))),
        F.when((attr > 0) & (F.col("n_attr") > 0), F.concat(F.lit("near "), ratio("n_attr", "attractions"), F.lit(" requested attractions"))),
        F.when(F.col("price").isNotNull() & (F.col("price") <= F.col("max_price")), F.lit("within budget")),
        F.when(flag("heavy"), F.lit("heavy traffic on route (x1)")).when(F.col("worst") >= 3, F.concat(F.lit("+"), whole(F.col("worst")), F.lit(" min traffic delay on route"))).when(F.col("calm") > 0.85, F.lit("low disruption / stable conditions")),
        F.when(active & in_zone & (F.col("preference") == "seek"), F.concat(F.lit("inside "), name, F.lit(" zone ("), away, F.lit(" km) - great for attending")))
        .when(F.col("avoided"), F.concat(F.lit("inside "), name, F.lit(" impact zone ("), away, F.lit(" km) - crowds/traffic")))
        .when(active & (F.col("preference") == "avoid"), F.concat(away, F.lit(" km from "), name, F.lit(" - calm"))),
    ]
    parts = [sc.half_up(F.col(k), 3).alias(k) for k in (*sc.WEIGHTS, "event_score")]
    rows = rows.select("ask_id", "city", "id", sc.half_up(score, 4).alias("score"), *parts, F.array_compact(F.array(*reasons)).alias("reasons"), "filters_relaxed", "rating5", "star", "price", "km", "delay", "amen", "attr", "weights")
    return sc.top_k(rows, ["ask_id"], [F.col("score").desc(), F.col("id").asc()], limit)


def _strict(limit: int) -> Callable[[Iterator], Iterator]:
    """Of each block per ask: the first that pass its bounds, and in rows without ``id`` how many that have all its amenities do."""

    def work(b: Block) -> Iterator[tuple]:
        import numpy as np
        import pyarrow as pa

        passes, bounds, words, wanted, lead = b.passing(True), b.bounds(), b.matched("amenities", "amen"), b.asked("n_amenities"), b.of("lead") > 0
        rating, price = b.of("rating5"), b.of("price")
        order = np.lexsort((np.arange(len(b.ids)), price, np.isnan(price), -rating, np.isnan(rating)))
        for i in range(0, len(b.asks), AT_ONCE):
            at = slice(i, i + AT_ONCE)
            ok = passes(bounds[at])
            n = (ok & lead & (words(at) == wanted[at])).sum(axis=1)
            yield b.asks[at], *[pa.nulls(len(n), x) for x in (pa.string(), pa.float64(), pa.float64())], n.astype(np.int64)
            ok = ok[:, order]
            rows, cols = np.nonzero(ok & (np.cumsum(ok, axis=1, dtype=np.int32) <= limit))
            if len(rows):
                cols = order[cols]
                yield [b.asks[i + x] for x in rows], [b.ids[x] for x in cols], *[pa.array(v[cols], mask=np.isnan(v[cols])) for v in (rating, price)], pa.nulls(len(rows), pa.int64())

    return lambda batches: each(batches, work, ["ask_id", "id", "rating5", "price", "n"])


def strictly_filtered(candidates: DataFrame, asks: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """``ask_id, id, rating5, price, rank``: the first of each ask that pass its bounds, which unknown values fail; and ``ask_id, n_all``: how many ids that have all its amenities besides.

    Best rated first, then cheapest, unknown values last; ties go to the lesser id. ``candidates`` and ``asks`` are as
    in ``retrieve``, by blocks as there.
    """
    lead = (F.row_number().over(Window.partitionBy("id").orderBy("city")) == 1).cast("double").alias("lead")
    c = candidates.where(F.col("city").isNotNull()).select("city", "id", *[F.col(x).cast("double").alias(x) for x in ("rating5", "star", "price")], "amen", lead)
    a = asks.where(F.col("city").isNotNull()).select("city", "ask_id", *BOUNDS, "amenities", F.size("amenities").alias("n_amenities"))
    found = cut(blocks(c, a, "city").mapInArrow(_strict(limit), "ask_id string, id string, rating5 double, price double, n bigint"))
    order = [F.col("rating5").desc_nulls_last(), F.col("price").asc_nulls_last(), F.col("id").asc()]
    return sc.top_k(found.where(F.col("id").isNotNull()).drop("n"), ["ask_id"], order, limit), found.where(F.col("n") > 0).groupBy("ask_id").agg(F.sum("n").alias("n_all"))


def contexts(best: DataFrame, names: DataFrame) -> DataFrame:
    """``ask_id, context``: the ranking of each ask as one text for an answer; ``names`` has ``id, name``."""
    text = lambda c, shape, default: F.coalesce(F.format_string(shape, c), F.lit(default))
    known = lambda c, shape, default: F.when(F.col(c).isNotNull(), F.format_string(shape, F.col(c))).otherwise(default)
    few = lambda c, n, default: F.coalesce(F.nullif(F.array_join(F.slice(c, 1, n), ", "), F.lit("")), F.lit(default))
    rows = best.join(names.select("id", "name"), "id", "left")
    line = F.concat(
        F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.coalesce("name", F.lit("Unknown")), text(F.col("score"), "  [score=%.3f]", ""), F.lit("\n    Rating: "), known("rating5", "%.1f", "N/A"), F.lit("/5"), known("star", " | %.0f-star", ""),
        F.lit(" | Price: "), known("price", "%.0f LKR/night", "price N/A"), F.lit(" | Distance: "), known("km", "%.1f km", "n/a"), F.lit(" | Travel time: "), known("delay", "%.0f min", "n/a"),
        F.lit("\n    Amenities: ["), few("amen", 8, "none listed"), F.lit("] | Near: ["), few("attr", 6, "none"), F.lit("]\n    Score breakdown - "), F.concat_ws(" ", *[F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in sc.WEIGHTS]),
        F.lit("\n    Why: "), few("reasons", 20, "-"),
    )
    weights = F.concat_ws(", ", *[F.concat(F.lit(f"{k}:"), F.round(F.col(f"weights.{k}"), 4).cast("string")) for k in sc.WEIGHTS])
    head = F.concat(F.lit("=== Ranked hotels in "), F.col("city"), F.lit(" (feasibility-first weighted ranking) ===\nRanking weights — "), weights, F.when(F.col("filters_relaxed"), "\n(Note: strict filters returned no hotels; constraints were relaxed.)").otherwise(""))
    lines = rows.groupBy("ask_id").agg(F.first(head).alias("head"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))  # at most the limit per ask
    return lines.select("ask_id", F.concat("head", F.lit("\n\n"), F.array_join("l.line", "\n\n")).alias("context"))
