"""Timestamps of mixed formats and time zones, normalised to UTC instants.

Every value is turned into the array of all its valid interpretations, as built-in expressions. Each source's records
are then read in the order of loading and one interpretation per value is chosen by Viterbi over the whole source: an
interpretation later than its load, a long lag, a change of format and a backward jump in time all cost something.

The order of all sources is cut into blocks of about equal size, wherever that falls. A record of one reading separates
what is before from what is after, so only runs of ambiguous records need a search, and only runs that touch an end of
their block need to hear from other blocks: each block tells what it costs to enter and to leave it by every reading
(min-plus sums), the driver puts these few numbers in a row and fixes the readings at the ends of the blocks, and the
blocks are then read a second time. The choice is that of one search over the whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.shipping import ship
from ..plans.skew import join_small

#: Zone abbreviations and the offsets, in minutes, that each may mean.
ZONES = {
    "Z": [0], "UTC": [0], "GMT": [0], "UT": [0], "WET": [0], "WEST": [60], "BST": [60], "IST": [330, 60], "SLST": [330], "CET": [60], "CEST": [120], "MEZ": [60], "MESZ": [120],
    "EET": [120], "EEST": [180], "MSK": [180], "EST": [-300, 600], "EDT": [-240, 660], "CST": [-360, 480], "CDT": [-300], "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420],
    "AEST": [600], "AEDT": [660], "ACST": [570], "ACDT": [630], "AWST": [480], "NZST": [720], "NZDT": [780], "JST": [540], "SGT": [480], "PKT": [300], "NPT": [345],
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Records per block of the order (more where there would be more than MOST_BLOCKS); a worker holds one block at a time.
BLOCK, MOST_BLOCKS = 20_000, 100_000
#: Numbers of the forms, by which a change of form is told.
FORM_NAMES = ["iso", "basic", "words", "american", "dmy", "mdy", "unix"]
#: Costs: all-number date not in the source's order; abbreviation not of the source's zone; change of format; hour of backward jump (at most ten); load before the instant.
ORDER_COST, ZONE_COST, SWITCH_COST, BACK_COST, EARLY_COST = 60.0, 6.0, 0.2, 0.5, 25.0
#: Clock skew allowed between instant and load.
SKEW_S = 60


SPLIT = "\x01"
OFFSET = r"(?: ?(Z|[A-Z]{2,4}|[+-]\d{2}:?(?:\d{2})?))?$"
HALF = r"(?: ?([aApP])\.?[mM]\.?)?"
#: The known forms: shape, and which group is year, month, day, hour, minute, second, half of the day, offset.
FORMS = {
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?" + OFFSET, [1, 2, 3, 4, 5, 6, None, 7]),
    "basic": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?" + OFFSET, [1, 2, 3, 4, 5, 6, None, 7]),
    "words": (r"^(?:[A-Za-z]{3,9},? )?(\d{1,2}) ([A-Za-z]{3})[a-z]*\.?,? (\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?" + HALF + OFFSET, [3, 2, 1, 4, 5, 6, 7, 8]),
    "american": (r"^(?:[A-Za-z]{4,9},? )?([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?" + HALF + OFFSET, [3, 1, 2, 4, 5, 6, 7, 8]),
    "numeric": (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?" + HALF + OFFSET, [3, 2, 1, 4, 5, 6, 7, 8]),
}
READINGS = "array<struct<utc_s:bigint,form:string,cost:double>>"


def with_readings(rows: DataFrame, value: str, home_zone: str, date_order: str) -> DataFrame:
    """``rows`` with ``readings``: all valid interpretations of ``value`` (struct ``utc_s, form, cost``), empty where it denotes no instant.

    Known forms: ISO 8601 dates with a time (basic or extended, blank or T, any fraction, Z, offset or none), RFC 822
    (weekday optional, offset or abbreviation), ``9 December 2024, 10:06 pm``, all-number dates with / . or -, and Unix
    seconds, milliseconds and microseconds. A date without time of day is no instant. Times without zone are read in
    ``home_zone`` (UTC where null); one that a clock change makes happen twice has both readings, one that is skipped
    is read with the offset before the change. ``date_order`` (``dmy`` or ``mdy``) makes the other reading of an
    all-number date expensive, not impossible.

    Every step is a projection of its own, so that a value is matched once and its parts are taken once.
    """
    keep, col = rows.columns, F.col
    t = F.trim(F.regexp_replace(value, r"\s+", " "))
    out = rows.select(*keep, t.alias("__t"), F.coalesce(home_zone, F.lit("UTC")).alias("__zone"), F.coalesce(date_order, F.lit("dmy")).alias("__order"))
    form = F.when(col("__t").rlike(r"^\d{9,10}$|^\d{13}$|^\d{16}$"), "unix")
    for name, (shape, _) in FORMS.items():
        form = form.when(col("__t").rlike(shape), name)
    out = out.withColumn("__form", form)
    parts = None
    for name, (shape, groups) in FORMS.items():
        order = SPLIT.join("" if g is None else f"${g}" for g in groups)
        one = F.split(F.regexp_replace("__t", shape, order), SPLIT)
        parts = F.when(col("__form") == name, one) if parts is None else parts.when(col("__form") == name, one)
    out = out.withColumn("__p", parts)
    at = lambda k: F.get("__p", F.lit(k))
    number = lambda c: c.try_cast("int")
    month = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    named = col("__form").isin("words", "american")
    hour = number(at(3))
    out = out.select(
        *keep, "__t", "__zone", "__order", "__form", number(at(0)).alias("__y"), F.when(named, F.try_element_at(month, F.lower(at(1)))).otherwise(number(at(1))).alias("__m"), number(at(2)).alias("__d"),
        F.when(at(6) == "", hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(F.lower(at(6)) == "p", 12).otherwise(0)).alias("__h"), number(at(4)).alias("__mi"),
        F.least(F.coalesce(number(at(5)), F.lit(0)), F.lit(59)).alias("__s"), F.when(at(7) != "", at(7)).alias("__off"),  # a leap second is read as the second before
    )
    stamp = lambda m, d, zone: F.unix_seconds(F.try_make_timestamp("__y", m, d, "__h", "__mi", "__s", zone))
    swapped = (col("__form") == "numeric") & (col("__m") != col("__d"))
    zoneless = col("__off").isNull()
    both = lambda m, d: F.struct(stamp(col(m), col(d), F.lit("UTC")).alias("u"), F.when(zoneless, stamp(col(m), col(d), col("__zone"))).alias("h"))
    digits = F.regexp_replace("__off", r"[^0-9]", "")
    minutes = F.when(col("__off").rlike("^[+-]"), (number(F.substring(digits, 1, 2)) * 60 + F.coalesce(number(F.substring(digits, 3, 2)), F.lit(0))) * F.when(F.startswith("__off", F.lit("-")), -1).otherwise(1))
    abbreviations = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    unix = col("__t").try_cast("bigint")
    seconds = F.when(col("__form") == "unix", F.when(F.length("__t") <= 10, unix).when(F.length("__t") == 13, F.floor(unix / 1000)).otherwise(F.floor(unix / 1_000_000)).cast("bigint"))
    out = out.select(
        *keep, "__zone", "__form", "__order", F.when(col("__y").isNotNull(), both("__m", "__d")).alias("__a"), F.when(swapped, both("__d", "__m")).alias("__b"), minutes.alias("__minutes"),
        F.when(minutes.isNull() & ~zoneless, F.coalesce(F.try_element_at(abbreviations, "__off"), F.array().cast("array<int>"))).alias("__meant"), seconds.alias("__seconds"),
    )
    wall = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), col("__zone")))
    nothing = F.array().cast(READINGS)

    def read(pair: str, form: Column, cost: Column) -> Column:
        u, h = col(f"{pair}.u"), col(f"{pair}.h")
        one = lambda x, c: F.struct(x.cast("bigint").alias("utc_s"), form.alias("form"), c.cast("double").alias("cost"))
        again = F.filter(F.array(F.lit(3600), F.lit(1800)), lambda k: wall(h + k) == u)
        at_home = F.concat(F.array(one(h, cost)), F.transform(again, lambda k: one(h + k, cost)))
        several = F.size("__meant") > 1
        zoned = F.transform("__meant", lambda m: one(u - m * 60, cost + F.when(several & (wall(u - m * 60) != u), ZONE_COST).otherwise(0.0)))
        return F.when(u.isNull(), nothing).when(col("__minutes").isNotNull(), F.array(one(u - col("__minutes") * 60, cost))).when(col("__meant").isNotNull(), zoned).otherwise(at_home)

    order_cost = lambda order: F.when((col("__form") == "numeric") & (col("__order") != order), ORDER_COST).otherwise(0.0)
    name = F.when(col("__form") == "numeric", "dmy").otherwise(col("__form"))
    first = F.when(col("__a").isNull(), nothing).otherwise(read("__a", name, order_cost("dmy")))
    second = F.when(col("__b").isNull(), nothing).otherwise(read("__b", F.lit("mdy"), order_cost("mdy")))
    in_unix = F.array(F.struct(col("__seconds").alias("utc_s"), F.lit("unix").alias("form"), F.lit(0.0).alias("cost")))
    return out.select(*keep, F.when(col("__form").isNull(), nothing).when(col("__form") == "unix", in_unix).otherwise(F.concat(first, second)).alias("readings"))


class Block:
    """Records in order: per record (row) and reading (column) the instant, the form and the cost, infinite where there is no such reading."""

    def __init__(self, pdf: pd.DataFrame):
        self.sizes = np.fromiter(map(len, pdf["utc"]), dtype=np.int64, count=len(pdf))
        row = np.repeat(np.arange(len(pdf)), self.sizes)
        column = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        shape = len(pdf), int(self.sizes.max()) if len(pdf) else 1
        self.utc, self.form, self.own = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), np.full(shape, np.inf)
        if len(row):
            self.utc[row, column], self.form[row, column] = np.concatenate(list(pdf["utc"])), np.concatenate(list(pdf["form"]))
            lag = pdf["loaded_s"].to_numpy()[row] - self.utc[row, column]
            self.own[row, column] = np.concatenate(list(pdf["cost"])) + np.where(lag < -SKEW_S, EARLY_COST, np.log1p(np.maximum(lag, 0) / 3600.0))


def _step(utc: np.ndarray, form: np.ndarray, next_utc: np.ndarray, next_form: np.ndarray) -> np.ndarray:
    """Cost of going from each reading of a record to each reading of the next (of many records at once)."""
    back = np.minimum(np.maximum(utc[..., :, None] - next_utc[..., None, :], 0) / 3600.0, 10.0) * BACK_COST
    return back + SWITCH_COST * (form[..., :, None] != next_form[..., None, :])


def _through(block: Block, a: int, b: int) -> np.ndarray:
    """Least cost from each reading of record a to each of record b - 1, all records between included."""
    m = np.full((block.own.shape[1],) * 2, np.inf)
    np.fill_diagonal(m, block.own[a])
    for k in range(a + 1, b):
        m = (m[:, :, None] + _step(block.utc[k - 1], block.form[k - 1], block.utc[k], block.form[k])[None]).min(axis=1) + block.own[k][None]
    return m[: block.sizes[a], : block.sizes[b - 1]]


def _choose(block: Block, runs: list[tuple[int, int]], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi over many runs at once: all their records, and the chosen reading of each."""
    runs = sorted(runs, key=lambda r: r[0] - r[1])
    start, size = np.array([a for a, _ in runs]), np.array([b - a for a, b in runs])
    best, pointers = own[start].copy(), np.zeros(own.shape, dtype=np.int64)
    going = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")  # runs longer than t come first
    for t in range(1, int(size[0])):
        at = start[: going[t]] + t
        step = best[: going[t], :, None] + _step(block.utc[at - 1], block.form[at - 1], block.utc[at], block.form[at])
        pointers[at] = step.argmin(axis=1)
        best[: going[t]] = step.min(axis=1) + own[at]
    chosen, records, readings = best.argmin(axis=1), [], []
    for t in range(int(size[0]) - 1, -1, -1):
        at = start[: going[t]] + t
        records.append(at)
        readings.append(chosen[: going[t]].copy())
        chosen[: going[t]] = pointers[at, chosen[: going[t]]] if t else chosen[: going[t]]
    return np.concatenate(records), np.concatenate(readings)


def _chains(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Ends of the chains (one field of one source) in a block that is in order."""
    new = (pdf["field_name"] != pdf["field_name"].shift()) | (pdf["source"] != pdf["source"].shift())
    starts = [*np.flatnonzero(new.to_numpy()), len(pdf)]
    yield from zip(starts, starts[1:])


def _runs(one: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Runs of ambiguous records in a..b, each with the records of one reading beside it."""
    many = np.flatnonzero(~one[a:b]) + a
    if len(many):
        for run in np.split(many, np.flatnonzero(np.diff(many) > 1) + 1):
            yield max(int(run[0]) - 1, a), min(int(run[-1]) + 2, b)


ENDS = "block int, field_name string, source string, at_start boolean, whole boolean, utc array<array<bigint>>, form array<array<int>>, costs array<array<double>>"


def _ends(pdf: pd.DataFrame) -> Iterator[tuple]:
    """What other blocks must know of a block: of its first and last chain, the readings at the end and the costs to pass.

    A chain that fills the block and has no record of one reading gives one row of the whole; others give a row for
    each end of the block, up to their outermost record of one reading.
    """
    block = Block(pdf)
    for a, b in _chains(pdf):
        if a > 0 and b < len(pdf):
            continue
        name = int(pdf["block"].iloc[0]), pdf["field_name"].iloc[a], pdf["source"].iloc[a]
        single = np.flatnonzero(block.sizes[a:b] == 1) + a
        pieces = [(a, b, True, True)] if not len(single) else [(a, int(single[0]) + 1, True, False), (int(single[-1]), b, False, False)]
        for i, j, start, whole in pieces:
            if whole or (start and i == 0) or (not start and j == len(pdf)):
                ends = [(k, block.sizes[k]) for k in (i, j - 1)]
                yield (*name, start, whole, [block.utc[k, :n].tolist() for k, n in ends], [block.form[k, :n].tolist() for k, n in ends], _through(block, i, j).tolist())


def _joined(rows: list) -> dict[tuple[int, str, str], tuple[int | None, int | None]]:
    """The fixed first and last reading of every chain that goes on in another block; ``rows`` are those of ``_ends``."""
    fixed: dict[tuple[int, str, str], list] = {}
    rows = sorted(rows, key=lambda r: (r.field_name, r.source, r.block, not r.at_start))
    k = 0
    while k < len(rows):
        # a stretch starts after a record of one reading and goes on while whole blocks are ambiguous
        end = k + 1
        while end < len(rows) and (rows[end].field_name, rows[end].source) == (rows[k].field_name, rows[k].source) and (rows[end - 1].whole or not rows[end - 1].at_start) and rows[end].block > rows[end - 1].block:
            end += 1
        part = rows[k:end]
        if len(part) > 1:
            best, back = np.asarray(part[0].costs).min(axis=0), []
            for p, q in zip(part, part[1:]):
                m = np.asarray(q.costs)
                enter = best[:, None] + _step(*map(np.asarray, (p.utc[1], p.form[1], q.utc[0], q.form[0])))
                through = enter.min(axis=0)[:, None] + m
                back.append((enter.argmin(axis=0), through.argmin(axis=0)))
                best = through.min(axis=0)
            last = int(best.argmin())
            for i in range(len(part) - 1, 0, -1):
                of, first = part[i], int(back[i - 1][1][last])
                entry = fixed.setdefault((of.block, of.field_name, of.source), [None, None])
                entry[0] = first
                if of.whole:
                    entry[1] = last
                last = int(back[i - 1][0][first])
            of = part[0]
            fixed.setdefault((of.block, of.field_name, of.source), [None, None])[1] = last
            if of.whole:
                fixed[(of.block, of.field_name, of.source)][0] = int(np.asarray(of.costs)[:, last].argmin())
        k = end
    return {key: tuple(v) for key, v in fixed.items()}


def _chosen(pdf: pd.DataFrame, fixed: dict) -> pd.DataFrame:
    block = Block(pdf)
    own, runs = block.own.copy(), []
    for a, b in _chains(pdf):
        for at, reading in zip((a, b - 1), fixed.get((int(pdf["block"].iloc[0]), pdf["field_name"].iloc[a], pdf["source"].iloc[a]), (None, None))):
            if reading is not None:
                own[at, np.arange(own.shape[1]) != reading] = np.inf
        runs += _runs(block.sizes == 1, a, b)
    reading = np.zeros(len(pdf), dtype=np.int64)
    if runs:
        records, readings = _choose(block, runs, own)
        reading[records] = readings  # runs share records of one reading only
    return pd.DataFrame({"field_name": pdf["field_name"], "id": pdf["id"], "value": pdf["value"], "utc_s": block.utc[np.arange(len(pdf)), reading]})


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The whole blocks of a partition."""
    parts = [b for b in batches if len(b)]
    if parts:
        whole = pd.concat(parts, ignore_index=True)
        yield from (block.reset_index(drop=True) for _, block in whole.groupby("block", sort=True))


def normalise_instants(values: DataFrame, feeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """``field_name, id, value, utc_s``: one row per distinct ``field_name, id, value`` that denotes an instant.

    ``values`` has ``field_name, id, source, value`` (string) and ``loaded_at`` (timestamp, may be null: read as the
    epoch, so it sorts first and its lag counts for nothing much); ``feeds`` has ``source, home_zone, date_order`` and
    must hold one row per source. Sources missing there are read in UTC with the day first. Null, blank and unreadable
    values, dates without time, and rows with a null id give no row. The same value under one id keeps its earliest
    load.

    Scale: readings are built-in expressions. The order is cut into blocks of about ``block`` records by range, so no
    task grows with the size of a source; two chains of each block, and at most three rows, go to the driver.
    """
    ship(values.sparkSession)
    once = (
        values.where(F.col("id").isNotNull() & F.col("value").isNotNull() & (F.trim("value") != ""))
        .groupBy("field_name", "id", "source", "value")
        .agg(F.coalesce(F.min(F.unix_seconds(F.col("loaded_at").cast("timestamp"))), F.lit(0)).alias("loaded_s"))
    )
    zones = feeds.where(F.col("source").isNotNull()).groupBy("source").agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order"))
    read = with_readings(join_small(once, zones, ["source"], "left"), "value", "home_zone", "date_order")
    flat = read.select("field_name", "id", F.coalesce("source", F.lit("")).alias("source"), "value", "loaded_s", F.col("readings.utc_s").alias("utc"), F.transform("readings.form", lambda f: F.array_position(F.array(*map(F.lit, FORM_NAMES)), f).cast("int")).alias("form"), F.col("readings.cost").alias("cost"))
    flat = cut(flat).where(F.size("utc") > 0)  # after the cut: pushed below, the test would compute the readings again
    order = ["field_name", "source", "loaded_s", "id", "value"]
    ordered = cut(flat.repartitionByRange(min(MOST_BLOCKS, -(-flat.count() // block)) or 1, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            yield pd.DataFrame(list(_ends(pdf)), columns=[c.split()[0] for c in ENDS.split(", ")])

    fixed = _joined(ordered.drop("id", "value").mapInPandas(ends, ENDS).collect())  # at most three rows a block

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            yield _chosen(pdf, fixed)

    return ordered.mapInPandas(chosen, "field_name string, id string, value string, utc_s bigint").distinct()
