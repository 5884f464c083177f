"""What becomes of fetched pages: a job for each, by an ordered list of rules; and what jobs do to the index."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content, html, robots, urls
from ..sources.store import Change
from . import maintain

#: url: as asked for, normalised; final_url: where redirects led; ord: order of discovery.
FETCHES = "url string, final_url string, status int, content_type string, charset string, etag string, last_modified string, x_robots_tag string, body binary, ord bigint"
LIMIT = 15 * 1024 * 1024
_DOC = "struct<title: string, text: string>"


def _documents(pdf: content.Extractor) -> object:
    @F.arrow_udf(_DOC)
    def run(kind: pa.Array, body: pa.Array) -> pa.Array:
        out = []
        for k, b in zip(kind.to_pylist(), body.to_pylist()):
            try:
                title, words = (content.extract_docx if k == content.DOCX else pdf)(b)
                out.append({"title": title, "text": words})
            except Exception:  # whatever a broken file makes a parser raise: the page is as one that could not be fetched
                out.append(None)
        return pa.array(out, pa.struct([("title", pa.string()), ("text", pa.string())]))

    return run


def decide(fetches: DataFrame, state: DataFrame, chunks: DataFrame, rules: list[urls.HostRule], robots_table: DataFrame | None = None, visited: DataFrame | None = None, agent: str = "", limit: int = LIMIT, pdf: content.Extractor = content.extract_pdf) -> DataFrame:
    """(url, ord, job, status, title, headings, text, etag, last_modified, content_hash, outlinks, redirect_source, follow,
    stored_links): a job for every fetch whose URL robots.txt allows. job: index, noindex, gone, alias or touch.

    state and chunks are the index before; robots_table: (origin, rules); visited: (url) seen in earlier batches.
    follow: the one URL that an alias leads to; stored_links: the outlinks stored for url are to be followed.
    Bodies are parsed only where a rule that needs no parsing hasn't decided.
    """
    rules_of = fetches.sparkSession.createDataFrame([], f"origin string, rules {robots.RULES}") if robots_table is None else robots_table.select("origin", "rules")

    def with_rules(df: DataFrame, url: str, name: str) -> DataFrame:
        side = rules_of.select(F.col("origin").alias("__o"), F.col("rules").alias(name))
        return df.join(side, urls.origin(F.col(url)) == F.col("__o"), "left").drop("__o")

    asked = with_rules(fetches.withColumn("target", F.coalesce(urls.normalise(F.col("final_url")), "final_url", "url")), "url", "__own")
    asked = with_rules(asked.filter(robots.allowed(urls.path_and_query(F.col("url")), F.col("__own"))).drop("__own"), "target", "__rules")
    moved = F.lower("target") != F.lower("url")
    seen = asked.select(F.lower("url").alias("k"), (F.col("ord") * 2 - 1).alias("at")).union(asked.filter(moved).select(F.lower("target").alias("k"), (F.col("ord") * 2).alias("at")))
    if visited is not None:
        seen = seen.union(visited.select(F.lower("url"), F.lit(-1).cast("long")))
    first = seen.groupBy("k").agg(F.min("at").alias("first_at"))
    # A redirect's target counts as seen if it was asked for in this batch (all of it was queued before) or before.
    queued = asked.select(F.lower("url").alias("q")).distinct()
    rows = asked.withColumn("k", F.lower("target")).join(first, "k", "left").join(queued, F.col("k") == F.col("q"), "left")
    lost = moved & (~urls.in_scope(F.col("target"), rules) | ~robots.allowed(urls.path_and_query(F.col("target")), F.col("__rules")) | F.col("q").isNotNull() | (F.col("first_at") < F.col("ord") * 2))
    s = F.col("status")
    early = (
        F.when(s == 304, "touch").when(lost, "lost").when(s.isin(404, 410), "gone").when(~s.between(200, 299) | s.isNull(), "touch")
        .when(F.length("body") > limit, "touch").when(~content.type_welcome(F.col("content_type")), "touch")
        .when(~content.prefix_supported(F.col("body"), F.col("content_type"), F.col("target")), "touch")
    )
    rows = rows.withColumn("early", early).drop("k", "q", "first_at", "__rules").withColumn("content_hash", F.when(F.col("early").isNull(), content.content_hash(F.col("body"))))
    indexed = chunks.select(F.col("url").alias("target"), F.lit(True).alias("has_chunks")).distinct()
    known = state.select(F.col("url").alias("target"), F.col("content_hash").alias("known_hash"))
    rows = rows.join(indexed, "target", "left").join(known, "target", "left")
    same = F.coalesce((F.col("known_hash") == F.col("content_hash")) & F.col("has_chunks"), F.lit(False))
    rows = rows.withColumn("early", F.coalesce("early", F.when(same, "same")))
    stored = maintain.duplicates_of(rows.filter("early IS NULL").select(F.col("target").alias("url"), "content_hash").distinct(), state, chunks)
    rows = rows.join(stored.select(F.col("url").alias("target"), "content_hash", "duplicate_of"), ["target", "content_hash"], "left")
    rows = rows.withColumn("kind", F.when(F.col("early").isNull(), content.classify(F.col("content_type"), F.col("body"))))
    open_ = F.col("early").isNull() & F.col("duplicate_of").isNull()
    page = F.when(open_ & (F.col("kind") == content.HTML), F.col("body"))
    rows = rows.withColumn("html", html.analysis(page, F.col("charset"), F.col("target"), F.col("x_robots_tag"), rules, agent))
    is_doc = F.coalesce(F.col("kind").isin(content.PDF, content.DOCX), F.lit(False))
    rows = rows.withColumn("doc", F.when(open_ & is_doc, _documents(pdf)(F.col("kind"), F.when(open_ & is_doc, F.col("body")))))
    late = (
        F.when(is_doc, F.when(F.col("doc").isNull(), "failed").otherwise("index")).when(F.col("kind") != content.HTML, "touch")
        .when(F.col("html.canonical").isNotNull(), "canonical").when(F.col("html.noindex"), "noindex").otherwise("index")
    )
    rows = rows.withColumn("late", F.when(open_, late))
    # The first page of a content that is indexed owns it; later ones of the batch are its copies.
    owner = F.min(F.when(F.col("late") == "index", F.struct("ord", "target"))).over(Window.partitionBy("content_hash"))
    rows = rows.withColumn("owner", F.when(open_, owner))
    copy = F.coalesce((F.col("owner.ord") < F.col("ord")) & (F.lower("owner.target") != F.lower("target")), F.lit(False))
    what = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("duplicate_of").isNotNull() | copy, "copy").otherwise(F.col("late"))
    rows = rows.withColumn("what", what)
    goes = F.col("what").isin("index", "noindex")
    job = F.when(F.col("what").isin("lost", "copy", "canonical"), "alias").when(F.col("what").isin("same", "failed"), "touch").otherwise(F.col("what"))
    stays = F.col("what").isin("lost")
    code = F.when(F.col("what") == "lost", 302).when(F.col("what") == "failed", 500).otherwise(F.coalesce("status", F.lit(500)))
    only = lambda c: F.when(goes, c)
    linked = F.filter(F.col("html.outlinks"), lambda x: F.lit(True))
    return rows.select(
        F.when(stays | (s == 304), F.col("url")).otherwise(F.col("target")).alias("url"), "ord", job.alias("job"), code.alias("status"),
        only(F.coalesce("html.title", "doc.title")).alias("title"), only(F.coalesce(F.col("html.headings"), F.col("doc.title"), F.lit(""))).alias("headings"),
        only(F.coalesce("html.text", "doc.text")).alias("text"), only(F.col("etag")).alias("etag"), only(F.col("last_modified")).alias("last_modified"),
        only(F.col("content_hash")).alias("content_hash"), F.when(goes, F.coalesce(linked, F.array().cast("array<string>"))).alias("outlinks"),
        F.when(moved & ~stays & (s != 304), F.col("url")).alias("redirect_source"),
        F.when(F.col("what") == "copy", F.coalesce("duplicate_of", "owner.target")).when(F.col("what") == "canonical", F.col("html.canonical")).alias("follow"),
        ((F.col("what") == "same") | (s == 304)).alias("stored_links"),
    )


def changes(jobs: DataFrame, state: DataFrame, now, embedder=None, size: int = 150, overlap: int = 30) -> dict[str, Change]:
    """What jobs do to the tables, as one commit. Of a URL's jobs the last that isn't a touch decides content
    and metadata, the last of any kind time and status: as if they had been applied in turn. Redirect sources lose
    everything and are stamped 302. state is the table before."""
    now = now if isinstance(now, Column) else F.lit(now)
    plain = jobs.select("url", "ord", F.lit(1).alias("half"), "job", "status", "title", "headings", "text", "etag", "last_modified", "content_hash", "outlinks")
    none = lambda t: F.lit(None).cast(t)
    source = jobs.filter("redirect_source IS NOT NULL").select(
        F.col("redirect_source").alias("url"), "ord", F.lit(0).alias("half"), F.lit("alias").alias("job"), F.lit(302).alias("status"),
        *(none("string").alias(c) for c in ("title", "headings", "text", "etag", "last_modified", "content_hash")), none("array<string>").alias("outlinks"))
    every = plain.unionByName(source)
    one = F.struct("job", "title", "headings", "text", "etag", "last_modified", "content_hash", "outlinks")
    last = every.groupBy("url").agg(F.max_by("status", F.struct("ord", "half")).alias("status"), F.max_by(F.when(F.col("job") != "touch", one), F.when(F.col("job") != "touch", F.struct("ord", "half"))).alias("j"))
    last = last.select("url", "status", "j.*")
    decided = last.filter("job IS NOT NULL")
    pages = decided.filter("job = 'index'")
    texts = pages.select("url", "text", F.lit(False).alias("is_heading")).union(pages.select("url", F.col("headings"), F.lit(True)))
    gone = decided.select("url")
    indexed = maintain.index_changes(maintain.make_chunks(texts.filter(F.length(F.btrim("text")) > 0), size, overlap, embedder), gone)
    meta = decided.select("url", now.alias("last_crawled"), F.col("status").alias("status_code"), "etag", "last_modified", "title", "content_hash")
    touched = last.filter("job IS NULL").select("url", "status").join(state.drop("last_crawled", "status_code"), "url", "left").select("url", now.alias("last_crawled"), F.col("status").alias("status_code"), "etag", "last_modified", "title", "content_hash")
    links = decided.select(F.col("url").alias("from_url"), F.explode(F.array_distinct("outlinks")).alias("to_url"))
    return indexed | {"state": Change(meta.union(touched), last.select("url")), "links": Change(links, gone)}
