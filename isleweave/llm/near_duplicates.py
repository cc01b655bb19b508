"""Near-duplicate records by an exact set-similarity join on partitions of the token universe.

Two sets of sizes r and s with Jaccard similarity J or more differ in at most H = (1-J)/(1+J) * (r+s) tokens. The
universe of tokens is cut into m segments by hash, m by the band of sizes. If each segment i gets a threshold v_i of
-1 (skipped), 0 (equal) or 1 (at most one token more or less) with the sum of v_i + 1 above H, then by the pigeonhole
principle every similar pair agrees in some segment within its threshold. Records are indexed by every segment and
by its one-deletion neighbours. Each probing record spends its H + 1 units where its buckets are smallest, judged by
counts over all records. Candidates that survive a bitmap bound are verified on the tokens themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.shipping import ship
from ..plans.skew import LEAST, salted_join

#: Ratio between the ends of a band of sizes, and segments of a band over the least number that suffices.
BAND, SLACK = 1.3, 1.4
#: Buckets are counted in so many counters (a table of at most 2 * COUNTERS integers, whatever the corpus). Collisions make the choice of segments worse, never the result.
COUNTERS = 1 << 17
#: A bucket is split for each so many records in its counter.
SPLIT = 50_000


def distinct_tokens(*texts: Column) -> Column:
    """Sorted distinct runs of a-z and 0-9 of the lower-cased texts, null as empty."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit("[a-z0-9]+"), F.lit(0))))


class Plan:
    """Bands of sizes and their segments for a threshold."""

    def __init__(self, threshold: float, least: int):
        self.threshold, self.least = threshold, max(least, 1)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(n / self.least) / math.log(BAND) + 1e-9).astype(np.int64)

    def top(self, band: np.ndarray) -> np.ndarray:
        """No size of the band is above this."""
        return np.floor(self.least * BAND ** (np.asarray(band, dtype=float) + 1) + 1e-6)

    def differ(self, both: np.ndarray) -> np.ndarray:
        """Most tokens in which similar sets of that many tokens together may differ."""
        return np.floor((1 - self.threshold) / (1 + self.threshold) * both + 1e-9).astype(np.int64)

    def segments(self, band: np.ndarray) -> np.ndarray:
        top = self.top(band)
        return np.ceil((self.differ(top + np.floor(top / self.threshold)) + 1) / 2 * SLACK).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(bands: np.ndarray, segment: np.ndarray, signature: np.ndarray, deletion: bool) -> np.ndarray:
    return _mix(signature ^ _mix((bands * 4096 + segment).astype(np.uint64) * np.uint64(2) + np.uint64(deletion)))


def _segmented(plan: Plan, hashes: list[np.ndarray], bands: np.ndarray) -> tuple[np.ndarray, ...]:
    """For records cut by the segments of ``bands``: signatures (records x segments), and per token its record, segment and the signature without it."""
    sizes = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    record = np.repeat(np.arange(len(hashes)), sizes)
    token = (np.concatenate(hashes) if len(hashes) else np.zeros(0, dtype=np.int64)).astype(np.int64).view(np.uint64)
    count = plan.segments(bands)
    most = int(count.max()) if len(count) else 1
    segment = (_mix(token) % count[record].astype(np.uint64)).astype(np.int64)
    signatures = np.zeros((len(hashes), most), dtype=np.uint64)
    code = _mix(token + np.uint64(0x51ED2701))
    np.bitwise_xor.at(signatures, (record, segment), code)
    return signatures, record, segment, signatures[record, segment] ^ code, count


def _sketch(hashes: list[np.ndarray]) -> np.ndarray:
    """128-bit parity bitmaps: the bits in which two differ are at most the tokens in which the sets differ."""
    sizes = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    record = np.repeat(np.arange(len(hashes)), sizes)
    token = np.concatenate(hashes).astype(np.int64).view(np.uint64) if len(hashes) else np.zeros(0, dtype=np.uint64)
    bit = (_mix(token ^ np.uint64(0xA5A5)) % np.uint64(128)).astype(np.int64)
    out = np.zeros((len(hashes), 2), dtype=np.uint64)
    np.bitwise_xor.at(out, (record, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.view(np.int64)


def _index_keys(plan: Plan, hashes: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of equal segments and of deletions, each with its record."""
    bands = plan.band(sizes)
    signatures, record, segment, without, count = _segmented(plan, hashes, bands)
    rows, columns = np.nonzero(np.arange(signatures.shape[1])[None, :] < count[:, None])
    return _keys(bands[rows], columns, signatures[rows, columns], False), rows, _keys(bands[record], segment, without, True), record


def _probe_keys(plan: Plan, hashes: list[np.ndarray], sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to look up in the index, with their records, after spending each record's units at least cost."""
    keys, owners = [], []
    own = plan.band(sizes)
    lowest = plan.band(np.maximum(np.ceil(sizes * plan.threshold - 1e-9), plan.least))
    for step in range(int((own - lowest).max()) + 1 if len(sizes) else 0):
        who = np.flatnonzero(own - step >= lowest)
        bands, n = own[who] - step, sizes[who]
        signatures, record, segment, without, count = _segmented(plan, [hashes[i] for i in who], bands)
        most = signatures.shape[1]
        grid = np.broadcast_to(np.arange(most), signatures.shape)
        real = grid < count[:, None]
        equal = _keys(np.repeat(bands, most), grid.ravel(), signatures.ravel(), False).reshape(signatures.shape)
        extra = _keys(np.repeat(bands, most), grid.ravel(), signatures.ravel(), True).reshape(signatures.shape)
        fewer = _keys(bands[record], segment, without, False)
        size = np.uint64(COUNTERS)
        first = counts[0][(equal % size).astype(np.int64)].astype(np.float64)
        second = counts[1][(extra % size).astype(np.int64)].astype(np.float64)
        np.add.at(second, (record, segment), counts[0][(fewer % size).astype(np.int64)])
        first, second = np.where(real, first, np.inf), np.where(real, np.maximum(first, second), np.inf)
        need = plan.differ(n + np.minimum(plan.top(bands), n)) + 1
        units = np.stack([first, second], axis=2).reshape(len(who), 2 * most)
        order = np.argsort(units, axis=1, kind="stable")
        spent = np.zeros(units.shape, dtype=bool)
        np.put_along_axis(spent, order, np.arange(2 * most)[None, :] < need[:, None], axis=1)
        spent = spent.reshape(len(who), most, 2)
        one, two = spent[:, :, 0] | spent[:, :, 1], spent[:, :, 0] & spent[:, :, 1]
        for chosen, table in ((one, equal), (two, extra)):
            r, c = np.nonzero(chosen)
            keys.append(table[r, c])
            owners.append(who[r])
        deep = two[record, segment]
        keys.append(fewer[deep])
        owners.append(who[record[deep]])
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _bucket_counts(records: DataFrame, plan: Plan) -> np.ndarray:
    """How many records each counter holds, for equal segments and for deletions: two rows of COUNTERS integers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, COUNTERS), dtype=np.int64)
        for pdf in batches:
            equal, _, deleted, _ = _index_keys(plan, list(pdf["hashes"]), pdf["n"].to_numpy())
            for k, keys in enumerate((equal, deleted)):
                total[k] += np.bincount((keys % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total.ravel())
        yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    pieces = records.select("hashes", "n").mapInPandas(count, "at bigint, n bigint")
    got = pieces.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * COUNTERS rows, whatever the corpus
    out = np.zeros(2 * COUNTERS, dtype=np.int64)
    out[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return out.reshape(2, COUNTERS)


ROWS = "key bigint, salt int, rec bigint, n int, s0 bigint, s1 bigint"


def _rows(records: DataFrame, plan: Plan, shared, probe: bool) -> DataFrame:
    """The index's or the probes' rows: key, salt, record, size and bitmap. Keys of crowded counters are salted."""

    split = SPLIT

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        crowd = counts[0].astype(np.int64) + counts[1]
        for whole in batches:
            for start in range(0, len(whole), 2000):  # bounds what a worker holds at once
                pdf = whole.iloc[start : start + 2000]
                hashes, sizes, rec = list(pdf["hashes"]), pdf["n"].to_numpy(), pdf["rec"].to_numpy()
                if probe:
                    keys, owner = _probe_keys(plan, hashes, sizes, counts)
                else:
                    a, i, b, j = _index_keys(plan, hashes, sizes)
                    keys, owner = np.concatenate([a, b]), np.concatenate([i, j])
                salts = 1 + crowd[(keys % np.uint64(COUNTERS)).astype(np.int64)] // split
                if probe:
                    salt = (_mix(rec[owner].astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
                else:
                    at = np.repeat(np.arange(len(keys)), salts)
                    salt = np.arange(len(at)) - np.repeat(np.cumsum(salts) - salts, salts)
                    keys, owner = keys[at], owner[at]
                sketch = _sketch(hashes)[owner]
                yield pd.DataFrame({"key": keys.view(np.int64), "salt": salt.astype(np.int32), "rec": rec[owner], "n": sizes[owner].astype(np.int32), "s0": sketch[:, 0], "s1": sketch[:, 1]})

    return records.select("rec", "hashes", "n").mapInPandas(emit, ROWS)


def token_classes(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal token sets: ``rec, words, hashes, n`` of each class, and ``id, rec`` of its members.

    ``docs`` has ``id, words`` (sorted distinct tokens). Records with fewer than ``least`` tokens and null ids are in
    no class; an id with several texts may be in several.
    """
    rows = docs.where(F.col("id").isNotNull() & (F.size("words") >= least)).select("id", "words").withColumn("set", F.sha2(F.concat_ws(" ", "words"), 256)).select("id", "set", "words").distinct()
    rows = cut(rows)  # read three times; the tokens are taken once
    sets = rows.groupBy("set").agg(F.first("words").alias("words"))  # equal for all rows of a set
    sets = cut(sets.select("set", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.size("words").alias("n")).withColumn("rec", F.monotonically_increasing_id()))
    members = cut(salted_join(rows.select("id", "set"), sets.select("set", "rec"), ["set"]).select("id", "rec"))
    return sets.drop("set"), members


def similar_classes(classes: DataFrame, threshold: float, least: int) -> DataFrame:
    """``rec_a, rec_b, similarity`` of all pairs of different classes at least ``threshold`` alike."""
    spark = classes.sparkSession
    ship(spark)
    plan = Plan(threshold, least)
    shared = spark.sparkContext.broadcast(np.minimum(_bucket_counts(classes, plan), np.iinfo(np.int32).max).astype(np.int32))  # 1 MB, fixed
    index, probes = _rows(classes, plan, shared, False).alias("s"), _rows(classes, plan, shared, True).alias("r")
    ratio = (1 - threshold) / (1 + threshold)
    col = F.col
    close = F.bit_count(col("r.s0").bitwiseXOR(col("s.s0"))) + F.bit_count(col("r.s1").bitwiseXOR(col("s.s1"))) <= ratio * (col("r.n") + col("s.n")) + 1e-9
    order = (col("s.n") < col("r.n")) | ((col("s.n") == col("r.n")) & (col("s.rec") < col("r.rec")))
    sized = col("s.n") >= col("r.n") * threshold - 1e-9
    found = probes.join(index, (col("r.key") == col("s.key")) & (col("r.salt") == col("s.salt")) & order & sized & close).select(col("r.rec").alias("rec_r"), col("s.rec").alias("rec_s")).distinct()
    found = cut(found)  # pairs of numbers; a record may be met by a third of all others, so the tokens come by salted joins
    words = classes.select("rec", "words", "n")
    pairs = salted_join(salted_join(found, words.toDF("rec_r", "words_r", "n_r"), ["rec_r"], found.groupBy("rec_r").agg(F.count(F.lit(1)).alias("__n"))), words.toDF("rec_s", "words_s", "n_s"), ["rec_s"], found.groupBy("rec_s").agg(F.count(F.lit(1)).alias("__n")))
    both = F.size(F.array_intersect("words_r", "words_s"))
    pairs = pairs.withColumn("both", both).withColumn("similarity", F.col("both") / (F.col("n_r") + F.col("n_s") - F.col("both")))
    return cut(pairs.where(F.col("both") >= threshold * (F.col("n_r") + F.col("n_s") - F.col("both")) - 1e-9).select(F.least("rec_r", "rec_s").alias("rec_a"), F.greatest("rec_r", "rec_s").alias("rec_b"), "similarity"))


def near_duplicates(docs: DataFrame, threshold: float, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal token sets, their members, and all pairs of similar classes: see the functions above.

    Every pair of different texts at least ``threshold`` alike is found, whatever the size of the collection. An empty
    input gives empty tables. Texts with no token at all are in no class.
    """
    classes, members = token_classes(docs, max(least, 1))
    return classes, members, similar_classes(classes, threshold, max(least, 1))


def expanded_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id_a, id_b`` of all pairs of different ids in equal or similar classes, smaller id first, distinct."""
    ends = lambda a, b: F.struct(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
    left = members.withColumnRenamed("id", "id_l")
    equal = salted_join(left, members.withColumnRenamed("id", "id_r"), ["rec"]).where(F.col("id_l") < F.col("id_r")).select(ends(F.col("id_l"), F.col("id_r")).alias("p"))
    one = salted_join(left.withColumnRenamed("rec", "rec_a"), pairs.select("rec_a", "rec_b"), ["rec_a"]).select("id_l", "rec_b")
    two = salted_join(one, members.toDF("id_r", "rec_b"), ["rec_b"]).where(F.col("id_l") != F.col("id_r")).select(ends(F.col("id_l"), F.col("id_r")).alias("p"))
    return equal.unionByName(two).select("p.id_a", "p.id_b").distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rec, root``: the least node reachable from each node over ``rec_a, rec_b``.

    Alternates large-star and small-star steps, so the rounds grow with the logarithm of the longest chain. Every
    round is written to the shared checkpoint folder; no link or label is collected. The links of a hub, a node with
    more links than a task should hold, are spread by salts.
    """

    def least_of(links: DataFrame, low: DataFrame, n: int) -> DataFrame:
        return salted_join(links, low.select("u", "m"), ["u"], low, "k") if n > LEAST else links.join(low.select("u", "m"), "u")  # no key of fewer links is hot

    edges = cut(pairs.select(F.greatest("rec_a", "rec_b").alias("u"), F.least("rec_a", "rec_b").alias("v")).distinct())
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "low").alias("m"), "k")
        large = least_of(both, low, 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = least_of(large, least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, old = cut(small), n
        n = new.count()
        same = n == old and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            break
    return nodes.select("rec").join(edges.select(F.col("u").alias("rec"), F.col("v").alias("root")), "rec", "left").select("rec", F.coalesce("root", "rec").alias("root"))
