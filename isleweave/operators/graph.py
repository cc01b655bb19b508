"""A property graph as typed tables: upserts of nodes and edges, expiry, neighbourhoods and counts.

A node table has one row per key; an edge table has ``src, dst`` and the edge's properties. All writes are set-based:
they take the present table and a batch, and give the next version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key in ``order`` (latest first). Rows with a null key are left out."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.where(known).withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def merge_nodes(old: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``old`` with ``batch`` merged in: the row with the greatest ``seq`` per key wins whole, the batch on ties, nulls included."""
    both = old.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return upsert_latest(both, keys, [F.col(seq).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def insert_absent(old: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` plus the rows of ``batch`` whose key it lacks; present rows stay as they are.

    Of several batch rows with one key the first by ``order`` is written (by default by all its columns, so that every
    run writes the same one).
    """
    first = upsert_latest(batch, keys, order or [F.col(c).asc_nulls_last() for c in batch.columns if c not in keys] or [F.lit(0)])
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def merge_edges(old: DataFrame | None, batch: DataFrame, sources: DataFrame, targets: DataFrame, seq: str) -> DataFrame:
    """Edges keyed by ``src, dst``, the latest ``seq`` winning; edges without both endpoints (``id`` columns) are no edges."""
    ends = batch.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return upsert_latest(ends, ["src", "dst"], [F.col(seq).desc_nulls_last()]) if old is None else merge_nodes(old, ends, ["src", "dst"], seq)


def update_edges(edges: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``edges`` with ``columns`` overwritten, by null too, where ``values`` has the key; other edges stay, none is added."""
    new = values.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = edges.join(new, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c) if c in edges.columns else F.lit(None)))
    return out.drop("__hit", *[f"__{c}" for c in columns])


def unexpired(rows: DataFrame, ts: str, hours: int, now: Column | None = None) -> DataFrame:
    """Rows at most ``hours`` older than ``now`` (by default the latest ``ts``, one scalar). Rows without a time stay."""
    at = F.col(ts)
    now = rows.agg(F.max(ts)).scalar() if now is None else now
    return rows.where(at.isNull() | (at >= now - F.expr(f"interval {hours} hours")))


def cascade(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Edges whose ``column`` still names a node (``id``)."""
    return edges.join(nodes.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def both_directions(edges: DataFrame) -> DataFrame:
    """``node, neighbour, type, direction`` of typed edges ``src, dst, type``, once from each end."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "type", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "type", F.lit("in").alias("direction")))


def label_counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows per table, most first by the caller's order: ``name, n``."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias(name), "n") for k, t in tables.items()])


def network_nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of typed edges with their degree."""
    return both_directions(edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def node_details(edges: DataFrame, limit: int = 40) -> DataFrame:
    """``node, total, neighbours``: of each node all its neighbours counted, and the first ``limit`` by type and id (a display limit)."""
    ends = both_directions(edges)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("type", "neighbour", "direction"))
    first = ends.withColumn("k", rank).groupBy("node").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.when(F.col("k") <= limit, F.struct("k", "type", "neighbour", "direction")))).alias("neighbours"))
    return first


def duplicate_groups(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Groups of more than one id under equal ``keys``: the keys, ``n`` and the least id."""
    return rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where(F.col("n") > 1)


def keep_best(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """``rows`` with ``kept``: the best of each group by ``order`` is kept, the others are losers."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def sanitised(rows: DataFrame, dropped: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Properties fit for display: embeddings are dropped, nested values become JSON, other values that JSON has no form for become strings."""
    out = []
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in dropped:
            continue
        nested = kind.startswith(("array", "struct", "map"))
        out.append(F.to_json(f.name).alias(f.name) if nested else F.col(f.name).cast("string").alias(f.name) if kind.startswith(("timestamp", "date", "binary", "decimal")) else F.col(f.name))
    return rows.select(*out)


def collected_maps(rows: DataFrame, key: str, fields: list[str], needed: str, name: str) -> DataFrame:
    """``key`` with the sorted distinct maps of ``fields``; maps whose ``needed`` field is null are dropped, keys stay."""
    one = F.when(F.col(needed).isNotNull(), F.struct(*fields))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(one)).alias(name))


def merged_slots(a: Column, b: Column) -> Column:
    """Union of two lists of words, lower-cased and trimmed, without blanks, sorted."""
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x))), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_union(tidy(a), tidy(b)))


def merge_aliases(nodes: DataFrame, edges: DataFrame, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (``name``) and edges (``src, dst`` and properties) after every alias is merged into its canonical name.

    Edges move with their properties; where several of one ``src`` meet, the one of the greatest old name wins.
    Aliases go, canonical nodes that were missing come.
    """
    moved = edges.withColumn("__old", F.col("dst")).withColumn("name", F.col("dst")).withColumn("dst", F.coalesce(canonical, F.col("dst"))).drop("name")
    kept = upsert_latest(moved, ["src", "dst"], [F.col("__old").desc()]).drop("__old")
    return nodes.select(F.coalesce(canonical, F.col("name")).alias("name")).distinct(), kept


CONFIRMATION = "DELETE ALL"


def cleared(tables: dict[str, DataFrame], confirmation: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table emptied, and how many rows each had (``name, n``); anything but the fixed confirmation is refused."""
    if confirmation != CONFIRMATION:
        raise ValueError(f"clearing needs the confirmation {CONFIRMATION!r}")
    return {k: t.limit(0) for k, t in tables.items()}, label_counts(tables, "name")


def network(edges: DataFrame, located: DataFrame | None = None, city: str | None = None, limit: int = 180) -> DataFrame:
    """Edges of a view ``src, dst, type``: of the first ``limit`` hotels of a city by id, or the first ``limit`` edges (a display limit).

    ``located`` has ``src`` (hotel) and ``dst`` (city). Edges keep their own direction.
    """
    if city is None:
        return edges.orderBy("type", "src", "dst").limit(limit)
    own = located.where(F.col("dst") == city).select(F.col("src").alias("hotel")).distinct().orderBy("hotel").limit(limit)
    ends = lambda c: edges.join(F.broadcast(own), F.col(c) == F.col("hotel"), "left_semi")  # at most the limit
    return ends("src").unionByName(ends("dst")).distinct()
