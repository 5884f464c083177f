"""Hybrid search over an index: keyword and vector candidates, site filter, titles, rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding, urls
from ..functions.text import Query, parse_query
from ..operators import fulltext, knn
from ..operators.maintain import index_changes, index_stats, make_chunks
from ..operators.rank import Settings, rank
from ..sources.shared import shared_dir
from ..sources.store import TABLES, Change, Store

RESULT = "url string, title string, text string, similarity double, score double"


class IndexNotBuilt(RuntimeError):
    """There is no index to search."""


def _ordered(hits: DataFrame, *by: str) -> DataFrame:
    """`ord` 1, 2, … of at most a pool of rows, hence a window over one partition."""
    return hits.withColumn("ord", F.row_number().over(Window.orderBy(*by)))


def keyword_pools(chunks: DataFrame, query: str, pool: int, stemmed: bool = True, digits: int | None = None, postings: DataFrame | None = None) -> DataFrame | None:
    """(id, exact_phrase, ord): the pools of the phrase and, for more than one word, of all terms. By the postings of
    stems and n_tokens where they are given, else by one pass over the tokens."""
    phrase, terms = fulltext.phrase_of(query, stemmed), fulltext.terms_of(query, stemmed)
    wanted = [(exact, x) for exact, x in ((True, phrase), (False, terms)) if x]
    if not wanted:
        return None
    if postings is None:
        seen = fulltext.counted(chunks, phrase + terms)
        places = {True: list(range(len(phrase))), False: list(range(len(phrase), len(phrase) + len(terms)))}
        found = [(exact, fulltext.ranked(*seen, places[exact], pool, digits=digits)) for exact, _ in wanted]
    else:
        found = [(exact, fulltext.top_k_postings(postings, chunks.select("n_tokens"), x, pool, digits=digits)) for exact, x in wanted]
    hits = [_ordered(f, "rank", "id").select("id", F.lit(exact).alias("exact_phrase"), (F.col("ord") + (not exact) * pool).alias("ord")) for exact, f in found]
    return hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])


def vector_pool(chunks: DataFrame, vector: list[float], pool: int, digits: int | None = None) -> DataFrame:
    """(id, distance, ord)."""
    return _ordered(knn.top_k(chunks.select("id", "embedding"), vector, pool, digits=digits), "distance", "id").select("id", "distance", "ord")


def hybrid(chunks: DataFrame, query: Query, vector: list[float] | None, settings: Settings = Settings(), titles: DataFrame | None = None, stemmed: bool = True, digits: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Ranked rows for chunks(id, url, text, is_heading, tokens, embedding); with postings, tokens aren't
    needed, but n_tokens are. Pools are of ids; texts are read once, for the pools' rows. The sites filter what the pools
    hold, so other hosts' chunks take their places too. A query without text finds nothing; without a vector only keywords
    count.
    """
    if not query.text:
        return chunks.sparkSession.createDataFrame([], RESULT)
    shared_dir(chunks.sparkSession)
    words = keyword_pools(chunks, query.text, settings.pool, stemmed, digits, postings)
    pools = [] if words is None else [words.select("id", F.lit(None).cast("double").alias("distance"), "exact_phrase", "ord")]
    if vector is not None:
        pools.append(vector_pool(chunks, vector, settings.pool, digits).select("id", "distance", F.lit(None).cast("boolean").alias("exact_phrase"), "ord"))
    if not pools:
        return chunks.sparkSession.createDataFrame([], RESULT)
    # At most three pools of rows, which bounds the broadcast and what is written.
    rows = chunks.select("id", "url", "text", "is_heading").join(F.broadcast(reduce(DataFrame.unionByName, pools)), "id").filter(urls.matches_site(F.col("url"), list(query.sites))).checkpoint()
    return rank(rows.filter("distance IS NOT NULL"), rows.filter("exact_phrase IS NOT NULL"), query.text, settings, titles, digits)


def search(store: Store, query: str, settings: Settings = Settings(), embedder: embedding.Embedder = embedding.hash_embed, prefix: str = "", digits: int | None = None) -> DataFrame:
    """RESULT rows of a stored index, best first. A blank query is an error, as is a missing index."""
    if not (query or "").strip():
        raise ValueError("the query is blank")
    if not store.exists():
        raise IndexNotBuilt(store.root)
    parsed = parse_query(query)
    vector = embedding.embed_query(parsed.text, embedder, prefix) if parsed.text else None
    return hybrid(store.read("chunks"), parsed, vector, settings, store.read("state").select("url", "title"), digits=digits, postings=store.read("postings"))


def total_matches(results: DataFrame) -> int:
    return results.count()


def stats(store: Store) -> DataFrame:
    if not store.exists():
        raise IndexNotBuilt(store.root)
    return index_stats(store.read("state"), store.read("chunks"), store.bytes())


def index_documents(store: Store, pages: DataFrame, size: int = 150, overlap: int = 30, embedder: embedding.Embedder = embedding.hash_embed) -> int:
    """Replaces the chunks of pages(url, text, is_heading)."""
    return store.commit(index_changes(make_chunks(pages, size, overlap, embedder), pages.select("url")))


def delete_urls(store: Store, gone: DataFrame) -> int:
    """Removes (url) from all tables."""
    return store.commit({t: Change(None, gone) for t in TABLES})
