"""Queries on text, and their SQL where it can express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import salted_join
from ..sources.tables import table
from .addresses import house_classes, mined, parsed, same_house
from .entity_matching import entities, matches
from .mixing import mixed, reached_shares
from .near_duplicates import components, distinct_tokens, expanded_pairs, near_duplicates
from .personal import personal_spans, redacted
from .tokenise import encode_documents, token_count
from .truncation import confirmed, cut_texts


def _cut_values(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All values of the three fields, and those that are cut."""
    hotel, news, event = (table(spark, folder, t) for t in ("hotel", "news_signal", "graph_event"))
    field = lambda d, t, c: d.select(F.lit(f"{t}.{c}").alias("field_name"), "id", "source", F.col(c).alias("value"))
    values = field(hotel, "hotel", "description").unionByName(field(news, "news_signal", "summary")).unionByName(field(event, "graph_event", "title"))
    title = F.lit("graph_event.title").alias("field_name")
    found = cut_texts(values, news.select(title, F.col("title").alias("value")))
    links = event.where(F.col("news_url").isNotNull()).select("id", F.col("news_url").alias("url")).distinct()
    whole = salted_join(links, news.select("url", F.col("title").alias("whole")).distinct(), ["url"]).select(title, "id", "whole")
    return values, confirmed(found, whole)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, id``: every value whose end is missing."""
    return _cut_values(spark, folder)[1].where(F.col("id").isNotNull()).select("field_name", "id").distinct()


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts each field: distinct values, cut ones, and the share."""
    values, found = _cut_values(spark, folder)
    every = values.where(F.col("value").isNotNull() & (F.trim("value") != "")).select("field_name", "source", "id", "value").distinct().groupBy("field_name", "source").agg(F.count(F.lit(1)).alias("texts"))
    cut = found.groupBy("field_name", "source").agg(F.count(F.lit(1)).alias("cut"))
    both = every.join(cut, (every["field_name"] == cut["field_name"]) & every["source"].eqNullSafe(cut["source"]), "left").select(every["field_name"], every["source"], "texts", F.coalesce("cut", F.lit(0)).alias("cut"))
    return both.withColumn("share", F.col("cut") / F.col("texts"))


SIMILAR, LEAST_TOKENS = 0.7, 12


def _news_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "news_signal").select("id", distinct_tokens(F.col("title"), F.col("summary")).alias("words"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """``id_a, id_b``: every pair of news records whose token sets are at least 0.7 alike."""
    _, members, pairs = near_duplicates(_news_tokens(spark, folder), SIMILAR, LEAST_TOKENS)
    return expanded_pairs(members, pairs)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``id, class_id, group_id, links``: of each record the least id of its class of equal texts, the least id of its group, and how many other classes it is linked to."""
    classes, members, pairs = near_duplicates(_news_tokens(spark, folder), SIMILAR, LEAST_TOKENS)
    roots = components(classes, pairs)
    links = pairs.select(F.explode(F.array("rec_a", "rec_b")).alias("rec")).groupBy("rec").agg(F.count(F.lit(1)).alias("links"))
    firsts = members.groupBy("rec").agg(F.min("id").alias("class_id"))
    of = roots.join(firsts, "rec").join(links, "rec", "left")
    groups = of.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return members.join(of.join(groups, "root"), "rec").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """``id_a, id_b, confidence, direct``: hotel records of different sources that describe one hotel."""
    return matches(table(spark, folder, "hotel"), _houses(spark, folder)[0])


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """``id, entity_id, matches, weakest``: the hotel of every matched record as the least id of its records."""
    return entities(table(spark, folder, "hotel"), _houses(spark, folder)[0])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """``id_a, id_b``: the pairs of ``p5_matches``."""
    return p5_matches(spark, folder).select("id_a", "id_b").distinct()


def _houses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mined(parsed(table(spark, folder, "hotel"), table(spark, folder, "city")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """``id_a, id_b``: every pair of hotel records whose addresses denote the same house."""
    return same_house(_houses(spark, folder)[0])


def p7_houses(spark: SparkSession, folder: str) -> DataFrame:
    """``id, house_id, records``: the house of every hotel record as the least id there, and how many records it has."""
    return house_classes(_houses(spark, folder)[0])


def p7_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """``round, word, better``: the rewrites that were mined."""
    return _houses(spark, folder)[1]


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ids`` of every document by the public 50k byte-level vocabulary."""
    return encode_documents(table(spark, folder, "documents"))


def p8_tokens_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens per source."""
    docs = table(spark, folder, "documents").select("source", token_count(spark, F.col("text")).alias("tokens"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, tokens, copy``: the documents of the mix, one row per use."""
    return mixed(table(spark, folder, "documents"), table(spark, folder, "source_mix"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mix reaches, per source."""
    return reached_shares(table(spark, folder, "documents"), table(spark, folder, "source_mix"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, kind, found_text``: every piece of personal information as it stands in the text."""
    return personal_spans(table(spark, folder, "documents")).select("doc_id", "kind", "found_text").distinct()


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text`` with every piece replaced by its placeholder."""
    return redacted("text", table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p3_found, p3_rates, p4_found, p4_groups, p5_found, p5_matches, p5_entities, p7_found, p7_houses, p7_rewrites, p8_ids, p8_tokens_by_source, p9_mix, p9_shares, p10_found, p10_redacted)}
_TOKENS = "list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))), '[a-z0-9]+'))"
SQL = {
    "p4_found": f"""
        WITH s AS (SELECT DISTINCT id, list_sort({_TOKENS}) AS words FROM news_signal WHERE id IS NOT NULL AND len({_TOKENS}) >= {LEAST_TOKENS}),
             k AS (SELECT row_number() OVER () AS k, id, words FROM s), t AS (SELECT k, unnest(words) AS w FROM k),
             b AS (SELECT a.k AS ka, b.k AS kb, count(*) AS n FROM t a JOIN t b ON a.w = b.w AND a.k < b.k GROUP BY 1, 2)
        SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM b JOIN k x ON x.k = b.ka JOIN k y ON y.k = b.kb
        WHERE x.id <> y.id AND b.n >= {SIMILAR}e0 * (len(x.words) + len(y.words) - b.n) - 1e-9""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
