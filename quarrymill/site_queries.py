"""Registered queries of whole crawls, of the stream and of documents in files, over a site of as many pages as there are."""

from __future__ import annotations

import io
import uuid
import zipfile
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .functions import content, urls
from .functions.text import plain_tokens
from .operators import fulltext, jobs
from .plans.crawl import crawl
from .queries import CHUNKS, _bm25, _NORMAL, _p, chunks
from .registry import query, table
from .sources.shared import shared_dir
from .sources.store import Change, Store
from .streaming.ingest import ingest, read_fetches

# Page i links to pages 16 i + 1 to 16 i + 16. By the last digit of i a page is 3: not to be indexed, 4: the same as all of
# its kind, without links, 5: failing, 6: gone. robots.txt forbids page 7. A crawl's order is that of the numbers.

SITE, NOW = "https://site.example", datetime(2024, 6, 1)


def web(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    n, i = pages.count(), F.col("page_id")
    linked = F.filter(F.sequence(16 * i + 1, 16 * i + 16), lambda c: c < n)
    links = F.array_join(F.transform(linked, lambda c: F.concat(F.lit('<a href="'), c.cast("string"), F.lit('#top">next</a>'))), " ")
    meta = F.when(i % 10 == 3, F.lit('<meta name="robots" content="noindex">')).otherwise(F.lit(""))
    own = F.concat(F.lit("<html>"), meta, F.lit("<title>Page "), i.cast("string"), F.lit("</title><p>words of page "), i.cast("string"), F.lit("</p>"), links)
    body = F.when(i % 10 == 4, F.lit("<html><title>Same</title><p>all the same</p></html>")).otherwise(own)
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    status = F.when(i % 10 == 5, 500).when(i % 10 == 6, 404).otherwise(200)
    found = pages.select(F.concat(F.lit(f"{SITE}/p/"), i.cast("string")).alias("url"), *none("final_url"), status.alias("status"), F.lit("text/html").alias("content_type"), *none("charset", "etag", "last_modified", "x_robots_tag"), body.cast("binary").alias("body"))
    rules = spark.range(1).select(F.lit(f"{SITE}/robots.txt"), *none("f"), F.lit(200), F.lit("text/plain"), *none("c", "e", "l", "x"), F.lit("User-agent: *\nDisallow: /p/7$\n").cast("binary"))
    return found.union(rules)


def crawled(spark, sf_dir, **caps) -> tuple[Store, object]:
    """A crawl of a store that already has a page that is gone from the site, and one of another site."""
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}")
    store.create()
    before = spark.createDataFrame([(f"{SITE}/old", datetime(2024, 1, 1), 200, None, None, "Old", None), ("https://other.example/x", datetime(2024, 1, 1), 200, None, None, "Other", None)],
                                   "url string, last_crawled timestamp, status_code int, etag string, last_modified string, title string, content_hash string")
    store.commit({"state": Change(before, before.select("url"))})
    return store, crawl(store, web(spark, sf_dir), f"{SITE}/p/0", NOW, embedder=None, **caps)


_CRAWL = f"""n AS (SELECT count(*) AS n FROM pages),
r(i, level) AS (SELECT 0::BIGINT, 1 UNION ALL SELECT c, level + 1 FROM r, n, range(16 * i + 1, 16 * i + 17) t(c) WHERE c < n.n AND c <> 7 AND i % 10 NOT IN (4, 5, 6)),
f AS (SELECT i, level, i % 10 AS kind, i % 10 = 4 AND i <> (SELECT min(i) FROM r WHERE i % 10 = 4) AS copy FROM r),
g AS (SELECT *, kind NOT IN (3, 5, 6) AND NOT copy AS indexed FROM f)"""


@query(f"""WITH RECURSIVE {_CRAWL} SELECT '{SITE}/p/' || i AS url, CASE kind WHEN 5 THEN 500 WHEN 6 THEN 404 ELSE 200 END::INT AS status_code, CASE WHEN kind IN (5, 6) OR copy THEN NULL WHEN kind = 4 THEN 'Same' ELSE 'Page ' || i END AS title, indexed,
  CASE WHEN kind IN (4, 5, 6) THEN 0 ELSE (SELECT count(*) FROM n, range(16 * i + 1, 16 * i + 17) t(c) WHERE c < n.n) END::BIGINT AS links, true AS now, outcome FROM g, (SELECT count(*) FILTER (indexed) || ' ' || count(*) || ' ' || max(level) || ' 1' AS outcome FROM g)
UNION ALL SELECT 'https://other.example/x', 200, 'Other', false, 0, false, NULL""")
def crawl_state(spark, sf_dir):
    """The store after a whole crawl, with what was pruned gone; and the crawl's own counts: indexed, jobs, levels, pruned."""
    store, done = crawled(spark, sf_dir)
    links = store.read("links").groupBy(F.col("from_url").alias("url")).agg(F.count("*").alias("links"))
    own = store.read("chunks").select("url").distinct().withColumn("indexed", F.lit(True))
    rows = store.read("state").join(own, "url", "left").join(links, "url", "left")
    return rows.select("url", "status_code", "title", F.coalesce("indexed", F.lit(False)).alias("indexed"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), (F.col("last_crawled") == F.lit(NOW)).alias("now"),
                       F.when(F.col("last_crawled") == F.lit(NOW), f"{done.indexed} {done.jobs} {done.levels} {done.pruned}").alias("outcome"))


@query(f"WITH RECURSIVE {_CRAWL} SELECT '{SITE}/p/' || i AS url, false AS pruned FROM (SELECT i FROM g WHERE indexed ORDER BY i LIMIT 12)")
def crawl_page_cap(spark, sf_dir):
    """A crawl that ends at twelve pages, in the order of their discovery, prunes nothing."""
    store, done = crawled(spark, sf_dir, max_pages=12)
    return store.read("chunks").select("url").distinct().withColumn("pruned", F.lit(done.pruned > 0))


@query(f"WITH RECURSIVE {_CRAWL} SELECT '{SITE}/p/' || i AS url, true AS capped FROM (SELECT i FROM g WHERE indexed ORDER BY i LIMIT 9)")
def crawl_host_cap(spark, sf_dir):
    store, done = crawled(spark, sf_dir, max_per_host=9)
    return store.read("chunks").select("url").distinct().withColumn("capped", F.lit(done.host_cap_hit))


_LAST = f"SELECT url, max(page_id) AS page_id FROM (SELECT {_NORMAL} AS url, page_id FROM pages) GROUP BY url"


@query(f"SELECT url, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END::INT AS status_code, CASE WHEN page_id % 5 <> 0 THEN 'No. ' || page_id END AS title, page_id % 5 <> 0 AS indexed FROM ({_LAST})")
def stream_ingest(spark, sf_dir):
    """A stream of two files, a batch each; of a URL that comes again the last fetch counts."""
    i, none = F.col("page_id"), F.lit(None).cast("string")
    fetched = table(spark, sf_dir, "pages").select(
        "url", none.alias("final_url"), F.when(i % 5 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), none.alias("charset"), none.alias("etag"), none.alias("last_modified"), none.alias("x_robots_tag"),
        F.concat(F.lit("<html><title>No. "), i.cast("string"), F.lit("</title><p>page "), i.cast("string"), F.lit("</p></html>")).cast("binary").alias("body"), i.alias("ord"))
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    half = (fetched.agg(F.max("ord")).first()[0] or 0) // 2
    for part in (F.col("ord") <= half, F.col("ord") > half):
        fetched.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")  # a file for each batch
    store = Store(spark, f"{root}/index")
    ingest(store, read_fetches(spark, f"{root}/in", 1), [], f"{root}/progress", embedder=None).awaitTermination()
    own = store.read("chunks").select("url").distinct().withColumn("indexed", F.lit(True))
    return store.read("state").join(own, "url", "left").select("url", "status_code", "title", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def _docx(title: str, words: str) -> bytes:
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>{words}</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t><w:tab/><w:t>line</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> {title} </dc:title></c>')
    return out.getvalue()


def _pdf(title: str, words: str) -> bytes:
    return f"%PDF-1.4\n1 0 obj << /Title ({title}) >> endobj\n2 0 obj << /Length 9 >> stream\nBT (words) Tj T* [(of) -500 ( {words})] TJ ET\nendstream endobj\n".encode()


@F.arrow_udf(BinaryType())
def _file(page: pa.Array) -> pa.Array:
    return pa.array([(_docx if i % 2 else _pdf)(f"No.  {i}", f"file {i}") for i in page.to_pylist()], pa.binary())


@query("SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'docx' ELSE 'pdf' END AS kind, 'No. ' || page_id AS title, CASE WHEN page_id % 2 = 1 THEN 'file ' || page_id || ' second line' ELSE 'words of file ' || page_id END AS text FROM pages")
def file_texts(spark, sf_dir):
    """PDF and DOCX files, told by their bytes alone."""
    files = table(spark, sf_dir, "pages").select("page_id", _file(F.col("page_id")).alias("body")).withColumn("kind", content.classify(F.lit("application/octet-stream"), F.col("body")))
    return files.withColumn("doc", jobs._documents(content.extract_pdf)(F.col("kind"), F.col("body"))).select("page_id", "kind", "doc.title", "doc.text")


@query(f"WITH {CHUNKS}, {_bm25('hit', ['that was', 'of'], 500)} SELECT id, rank FROM hit")
def fts_nested_phrase(spark, sf_dir):
    """A word of the query that splits into tokens is a phrase of them."""
    c = chunks(spark, sf_dir).select("id", "tokens")
    return fulltext.top_k(c, fulltext.terms_of("that_was of", stemmed=False), 500, digits=6)


@query("SELECT doc_id AS id, 0.0::DOUBLE AS rank FROM documents WHERE false")
def fts_no_token(spark, sf_dir):
    """A query without a token matches nothing."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), plain_tokens(F.col("text")).alias("tokens"))
    return fulltext.top_k(c, fulltext.phrase_of("?! --"), 500)


@query(f"SELECT page_id, lower({_p(1)}) = 'https' AND lower({_p(3)}) = 'tionsh.example.com' AS pinned, lower({_p(3)}) = 'tionsh.example.com' AS any_port FROM pages")
def pinned_origin(spark, sf_dir):
    """A rule pins scheme, host and port of the seed; a bare host pins the host alone."""
    pin, bare = urls.origin_rule("HTTPS://TionSH.example.com/x?y#z"), urls.parse_host_rule(" tionsh.example.COM/ ")
    bad = [r for r in map(urls.parse_host_rule, ("https://a.example/path", "a:99999", "::1", "", None)) if r]
    return table(spark, sf_dir, "pages").select("page_id", urls.in_scope(F.col("url"), [pin, *bad]).alias("pinned"), urls.in_scope(F.col("url"), [bare]).alias("any_port"))
