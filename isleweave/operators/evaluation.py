"""Retrieval baselines, rank fusion, ranking metrics and annotator agreement."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.shipping import ship
from ..plans.skew import salted_join
from .scoring import top_k

RRF_K = 60
#: Queries and documents that are compared at once, and rows that a task keeps before it hands them on.
QUERIES, DOCUMENTS, KEPT = 1024, 2048, 600_000
#: Share of a block's pairs that have a term, above which the term is multiplied as a column of matrices.
DENSE = 0.005


def ascii_tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-cased runs of a-z and 0-9 of two or more characters, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stop_words))


def tf_idf(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """``id, term, w``: L2-normalised TF-IDF with idf = ln((1 + n) / (1 + df)) + 1, over ``docs`` (``id, text``).

    Documents without terms have no rows. Term counts are aggregated before any join; common terms join salted.
    """
    n = docs.agg(F.count(F.lit(1))).scalar()
    tf = docs.select("id", F.explode(ascii_tokens(F.col("text"), stop_words)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = salted_join(tf, df.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1), ["term"], df, "df").select("id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "term", (F.col("raw") / F.col("norm")).alias("w"))


def tf_idf_vectors(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """``id, v``: the same weights as ``tf_idf``, as one list of ``t, w`` per document (``t`` numbers the terms); materialised.

    Texts are read and shuffled once; ids are unique. Documents without terms have no rows.
    """
    n = docs.agg(F.count(F.lit(1))).scalar()
    terms = docs.repartition("id").select("id", F.explode(ascii_tokens(F.col("text"), stop_words)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(terms.groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("v"))).select("id", F.inline("v"))
    df = cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumns({"t": F.monotonically_increasing_id(), "idf": F.log((1 + n) / (1 + F.col("df"))) + 1}))
    raw = salted_join(tf, df, ["term"], df, "df").select("id", "t", (F.col("tf") * F.col("idf")).alias("raw"))
    lists = raw.groupBy("id").agg(F.collect_list(F.struct("t", "raw")).alias("v"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return cut(lists.select("id", F.transform("v", lambda x: F.struct(x["t"].alias("t"), (x["raw"] / F.col("norm")).alias("w"))).alias("v")))


def cosine_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, id, similarity`` of every pair that shares a term, from ``query_id, term, w`` and ``id, term, w``."""
    return salted_join(docs, queries.withColumnRenamed("w", "wq"), ["term"]).groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("wq")).alias("similarity"))


def _best(k: int, digits: int) -> Callable[[Iterator], Iterator]:
    """Batches of ``block``, ``q`` and ``d`` (lists of ``id`` and vector) to the ``k`` best of ``d`` for each of ``q`` that the task meets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, best, ids = float(10**digits), {}, {}

        def vectors(column):
            items, vs = column.values.field("id").to_pylist(), column.values.field("v")
            return column.offsets.to_numpy(), items, vs.offsets.to_numpy(), vs.values.field("t").to_numpy(), vs.values.field("w").to_numpy()

        def entries(at, t, w, first, last, words):
            rows = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
            t, w = t[at[first] : at[last]], w[at[first] : at[last]]
            place = np.minimum(np.searchsorted(words, t), len(words) - 1)
            hit = words[place] == t
            return rows[hit], place[hit], w[hit]

        def products(q, d, nq, nd, words):
            """Of all pairs: common terms as matrices, others pair by pair."""
            (qr, qp, qx), (dr, dp, dx) = q, d
            cq, cd = np.bincount(qp, minlength=words), np.bincount(dp, minlength=words)
            dense = cq * cd > DENSE * nq * nd
            column = np.cumsum(dense) - 1

            def matrix(rows, places, values, n):
                out, some = np.zeros((n, dense.sum())), dense[places]
                out[rows[some], column[places[some]]] = values[some]
                return out

            raw = matrix(qr, qp, qx, nq) @ matrix(dr, dp, dx, nd).T
            light, rest = ~dense[qp], np.flatnonzero(~dense[dp])
            rest = rest[np.argsort(dp[rest], kind="stable")]
            qr, qp, qx, cd = qr[light], qp[light], qx[light], np.where(dense, 0, cd)
            starts, times = np.cumsum(cd) - cd, cd[qp]
            if times.sum():
                other = rest[np.arange(times.sum()) + np.repeat(starts[qp] - (np.cumsum(times) - times), times)]
                raw += np.bincount(np.repeat(qr, times) * nd + dr[other], np.repeat(qx, times) * dx[other], nq * nd).reshape(nq, nd)
            return raw

        def handed_on():
            rows = [(ids[b][i], doc, sim) for b, lists in best.items() for i, top in enumerate(lists) for sim, doc in top]
            best.clear()
            ids.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query_id", "id", "similarity"])

        for batch in batches:
            (q_at, q_ids, qv, qt, qw), (d_at, d_ids, dv, dt, dw) = vectors(batch.column("q")), vectors(batch.column("d"))
            for r, block in enumerate(batch.column("block").to_pylist()):
                q0, q1, d0, d1 = q_at[r], q_at[r + 1], d_at[r], d_at[r + 1]
                if block not in best:
                    best[block], ids[block] = [[] for _ in range(q1 - q0)], q_ids[q0:q1]
                tops, place = best[block], {x: i for i, x in enumerate(ids[block])}
                words, q_n, d_n = np.unique(qt[qv[q0] : qv[q1]]), q1 - q0, d1 - d0
                raw = products(entries(qv, qt, qw, q0, q1, words), entries(dv, dt, dw, d0, d1, words), q_n, d_n, len(words))
                mine = [place[x] for x in q_ids[q0:q1]]  # a block's order may differ from row to row
                least = np.array([tops[i][-1][0] if len(tops[i]) == k else -1.0 for i in mine])
                if d_n > k and (fresh := np.flatnonzero(least < 0)).size:
                    least[fresh] = np.partition(raw[fresh], -k, axis=1)[:, -k]
                rows, cols = np.nonzero((raw >= least[:, None] - 1.01 / n) & (raw > 0))  # what rounds to the least at least
                sims = (np.floor(raw[rows, cols] * n + 0.5) / n).tolist()
                ends = np.searchsorted(rows, np.arange(q1 - q0 + 1))
                for i in np.unique(rows).tolist():
                    found = [(sims[x], d_ids[d0 + cols[x]]) for x in range(ends[i], ends[i + 1])]
                    tops[mine[i]] = heapq.nlargest(k, tops[mine[i]] + found)
            if sum(map(len, best.values())) * k > KEPT:
                yield from handed_on()
        yield from handed_on()

    return run


def best_alike(queries: DataFrame, docs: DataFrame, k: int, digits: int = 8) -> DataFrame:
    """``query_id, id, similarity, rank``: the ``k`` documents of the greatest cosine, rounded half up, above 0 per query; ties go to the greater id.

    Both sides are rows ``id, v`` of one call of ``tf_idf_vectors``.

    Scale: no pair is a row. Blocks of documents meet blocks of queries as matrices, and a task keeps the best of each
    query only.
    """
    spark = docs.sparkSession
    ship(spark)

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        many = F.ceil(rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar() / size)
        return rows.groupBy(F.pmod(F.xxhash64("id"), many).cast("bigint").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name))

    q, d = blocks(queries, "q", QUERIES), blocks(docs, "d", DOCUMENTS).select("d").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = d.crossJoin(q).select("block", "q", "d").mapInArrow(_best(k, digits), "query_id string, id string, similarity double")
    return top_k(found, ["query_id"], [F.col("similarity").desc(), F.col("id").desc()], k)


def fused(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``query_id, list, weight, rank, item``: ``query_id, item, score, position``.

    Ties go to the item seen first (least list, then least rank).
    """
    scored = lists.groupBy("query_id", "item").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first")
    return scored.withColumn("position", F.row_number().over(order).cast("bigint")).drop("first")


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per ``system, query_id``: precision, recall, nDCG at k, and reciprocal rank over the whole list.

    ``ranked`` has ``system, query_id, rank, item`` (rank from 1, one row each); ``gold`` has ``query_id, item``.
    Precision divides by the length of the list cut at k; recall and nDCG are 0 without gold.
    """
    hit = gold.distinct().withColumn("rel", F.lit(1))
    sizes = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    return judged_metrics(ranked.join(hit, ["query_id", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))), sizes, k)


def judged_metrics(rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The same for rankings that are judged already: ``rows`` has ``rel`` (0 or 1) besides, ``sizes`` has ``query_id, n_gold``."""
    top = F.col("rank") <= k
    per = rows.groupBy("system", "query_id").agg(
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("hits"), F.sum(F.when(top, 1).otherwise(0)).alias("shown"),
        F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
    )
    per = per.join(sizes, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_gold"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.select(
        "system", "query_id", F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0).alias("precision"), F.when(F.col("n_gold") > 0, F.col("hits") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        F.when(F.col("n_gold") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def krippendorff_alpha(judgments: DataFrame) -> DataFrame:
    """One row ``alpha``: interval agreement of ``unit, value``; 1.0 where nothing can disagree.

    Nulls are missing; units with one judgment do not count. Sums of squares replace all pairs.
    """
    units = judgments.where(F.col("value").isNotNull()).groupBy("unit").agg(F.count(F.lit(1)).alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).where(F.col("m") >= 2)
    total = units.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"))
    observed, expected = F.col("within") / F.col("n"), 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return total.select(F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, 1.0).when(F.abs(F.col("n") * F.col("q") - F.col("s") * F.col("s")) < 1e-12, 1.0).otherwise(1 - observed / expected).alias("alpha"))


def majority(judgments: DataFrame, keys: list[str], least: float = 1.0) -> DataFrame:
    """``relevant`` per item: more than half of the given scores are at least ``least``; null without scores; ties are not relevant."""
    n, yes = F.count("value"), F.sum(F.when(F.col("value") >= least, 1).otherwise(0))
    return judgments.groupBy(*keys).agg(n.alias("n"), yes.alias("yes")).select(*keys, "n", F.when(F.col("n") > 0, F.col("yes") * 2 > F.col("n")).alias("relevant"))


def pooled(ranked: DataFrame, candidates: DataFrame, k: int, extra: int, seed: int) -> DataFrame:
    """Annotation pool: the top k of every system, and ``extra`` others per query drawn by a seeded hash (a sampling operator)."""
    top = ranked.where(F.col("rank") <= k).select("query_id", "item").distinct()
    rest = candidates.select("query_id", "item").distinct().join(top, ["query_id", "item"], "left_anti")
    draw = F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "query_id", "item")), "item"))
    return top.withColumn("drawn", F.lit(False)).unionByName(rest.withColumn("k", draw).where(F.col("k") <= extra).select("query_id", "item", F.lit(True).alias("drawn")))
