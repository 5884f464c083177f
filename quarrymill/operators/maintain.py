"""Index tables as DataFrames: upserts, replacements, deletions, pruning, statistics. Nothing here writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding, text
from ..functions.chunking import chunks as chunk_column
from ..sources.store import Change
from . import fulltext

STATE = ("url", "last_crawled", "status_code", "etag", "last_modified", "title", "content_hash")


def make_chunks(pages: DataFrame, size: int = 150, overlap: int = 30, embedder: embedding.Embedder | None = embedding.hash_embed) -> DataFrame:
    """(id, url, ord, text, is_heading, tokens, embedding) for (url, text, is_heading). Ids are hashes of place, so a task that runs again makes the
    same. Blank texts have no chunk. embedder None: no vectors."""
    each = pages.select("url", "is_heading", F.posexplode(chunk_column(F.col("text"), size, overlap)).alias("ord", "text"))
    ready = each.select(F.sha2(F.concat_ws("\0", "url", F.col("is_heading").cast("string"), F.col("ord").cast("string")), 256).alias("id"), "url", "ord", "text", "is_heading", text.token_array(F.col("text")).alias("tokens"))
    return ready.withColumn("embedding", F.lit(None).cast("array<float>") if embedder is None else embedding.embed(F.col("text"), embedder))


def index_changes(chunks: DataFrame, gone: DataFrame) -> dict[str, Change]:
    """Changes of the chunks and postings tables for rows of make_chunks() that replace what gone(url) had."""
    return {"chunks": Change(chunks.withColumn("n_tokens", F.size("tokens")), gone), "postings": Change(fulltext.postings(chunks, keep=("url",)), gone)}


def upsert_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of the same URL as a whole: a null replaces a value too."""
    return old.join(new.select("url"), "url", "left_anti").unionByName(new).select(*STATE)


def record_visits(old: DataFrame, visits: DataFrame) -> DataFrame:
    """visits: (url, last_crawled, status_code, clear), one a URL. Stamps time and status; metadata stay, but go where
    clear is set."""
    v = visits.select("url", F.col("last_crawled").alias("t"), F.col("status_code").alias("s"), F.col("clear").alias("c"), F.lit(True).alias("hit"))
    both = old.join(v, "url", "full_outer")
    kept = [F.when(F.coalesce("c", F.lit(False)), F.lit(None)).otherwise(F.col(n)).alias(n) for n in STATE[3:]]
    return both.select("url", F.when(F.col("hit"), F.col("t")).otherwise(F.col("last_crawled")).alias("last_crawled"), F.when(F.col("hit"), F.col("s")).otherwise(F.col("status_code")).alias("status_code"), *kept)


def replace_outlinks(old: DataFrame, new: DataFrame) -> DataFrame:
    """new: (from_url, to_urls ARRAY<STRING>): all links of these pages; an empty list removes them. Links are a set."""
    fresh = new.select("from_url", F.explode(F.array_distinct("to_urls")).alias("to_url")).filter("to_url IS NOT NULL").distinct()
    return old.join(new.select("from_url"), "from_url", "left_anti").select("from_url", "to_url").unionByName(fresh)


def delete_urls(table: DataFrame, gone: DataFrame, key: str = "url") -> DataFrame:
    return table.join(gone.select(F.col("url").alias(key)), key, "left_anti").select(*table.columns)


def stale(state: DataFrame, before) -> DataFrame:
    """URLs not crawled since, or never."""
    return state.filter(F.col("last_crawled").isNull() | (F.col("last_crawled") < F.lit(before))).select("url")


def duplicates_of(hashes: DataFrame, state: DataFrame, chunks: DataFrame) -> DataFrame:
    """(url, content_hash, duplicate_of) of hashes(url, content_hash): the least other URL that is indexed (has chunks)
    with the same content; rows without one are left out."""
    indexed = state.join(chunks.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("other"), "content_hash")
    return hashes.join(indexed, "content_hash").filter(F.col("other") != F.col("url")).groupBy("url", "content_hash").agg(F.min("other").alias("duplicate_of"))


def first_copies(pages: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """pages with `copy_of`: the order of the first page of the same content, null on the first itself."""
    first = F.min(order_col).over(Window.partitionBy(hash_col))
    return pages.withColumn("copy_of", F.when(F.col(order_col) != first, first))


def index_stats(state: DataFrame, chunks: DataFrame, size: int = 0) -> DataFrame:
    """One row: indexed_urls, chunks, known_urls, last_crawled, bytes."""
    a = chunks.agg(F.countDistinct("url").alias("indexed_urls"), F.count("*").alias("chunks"))
    b = state.agg(F.count("*").alias("known_urls"), F.max("last_crawled").alias("last_crawled"))
    return a.crossJoin(b).withColumn("bytes", F.lit(size).cast("long"))
