"""Hybrid rank: vector and keyword candidates become one scored row for each URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


@dataclass(frozen=True)
class Settings:
    pool: int = 500
    max_distance: float = 0.6
    exact_phrase: float = 0.5
    all_terms: float = 0.25
    heading: float = 0.3
    filename: float = 0.4
    term_in_text: float = 0.2
    title: float = 0.35


def contains(text: Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


def rank(vector_hits: DataFrame, keyword_hits: DataFrame, query: str, settings: Settings = Settings(), titles: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(url, title, text, similarity, score), one row a URL (without case), best first, then by URL.

    vector_hits: (url, text, is_heading, distance, ord); keyword_hits: (url, text, is_heading, exact_phrase, ord); ord is
    each one's order. Vector hits beyond max_distance don't count. The text is that of the most similar chunk, the first
    of equals; a keyword hit's only where no vector hit has one. Similarity is 0 at least. titles: (url, title).
    One shuffle by URL does what would be an outer join of both sides.
    """
    flag = F.coalesce("is_heading", F.lit(False)).alias("is_heading")
    v = vector_hits.filter(F.col("distance") <= settings.max_distance).select(
        "url", F.coalesce("text", F.lit("")).alias("text"), flag, (1 - F.col("distance")).alias("sim"), F.lit(False).alias("exact"), F.lit(False).alias("terms"), F.lit(0).alias("phase"), F.col("ord").cast("long").alias("ord"))
    k = keyword_hits.select(
        "url", F.coalesce("text", F.lit("")).alias("text"), flag, F.lit(0.0).alias("sim"), F.col("exact_phrase").alias("exact"), (~F.col("exact_phrase")).alias("terms"), F.lit(1).alias("phase"), F.col("ord").cast("long").alias("ord"))
    order = F.struct((F.col("text") == "").alias("a"), "phase", (-F.greatest("sim", F.lit(0.0))).alias("s"), "ord")
    one = v.unionByName(k).groupBy(F.lower("url").alias("key")).agg(
        F.min_by("url", F.struct("phase", "ord")).alias("url"), F.min_by("text", order).alias("text"), F.greatest(F.max("sim"), F.lit(0.0)).alias("similarity"),
        F.bool_or("exact").alias("exact"), F.bool_or("terms").alias("terms"), F.bool_or("is_heading").alias("in_heading"))
    if titles is None:
        named = one.withColumn("title", F.lit(None).cast("string"))
    else:
        named = one.join(titles.groupBy(F.lower("url").alias("key")).agg(F.min_by("title", "url").alias("title")), "key", "left")
    boost = [
        F.when(F.col("exact"), settings.exact_phrase).when(F.col("terms"), settings.all_terms).otherwise(0.0),
        F.when(F.col("in_heading"), settings.heading).otherwise(0.0),
        F.when(urls.file_name_contains(F.col("url"), F.lit(query)), settings.filename).otherwise(0.0),
        F.when(contains(F.col("text"), query), settings.term_in_text).otherwise(0.0),
        F.when((F.col("title") != "") & contains(F.col("title"), query), settings.title).otherwise(0.0),
    ]
    score = F.col("similarity")
    for b in boost:
        score = score + b
    if digits is not None:
        score = F.round(score, digits)
    similarity = F.col("similarity") if digits is None else F.round("similarity", digits)
    return named.select("url", "title", "text", similarity.alias("similarity"), score.alias("score")).orderBy(F.desc("score"), "url")
