"""Registered queries of the crawl's operators, over pages that stand for a fetched web.

What pages lack (directives, redirects, statuses, robots.txt and sitemaps) is made from their ids, the same way in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import content, html, robots, urls
from .operators import jobs
from .plans.crawl import robots_table
from .queries import _NORMAL, _PATH, _p
from .registry import query, table
from .sources.sitemaps import sitemap_urls

AGENT, HOME = "quarrymill", "https://ththin.example.com"
RULES = [urls.HostRule("https", "ththin.example.com", None), urls.HostRule(None, "ththan.example.net", None)]
_SCOPE = f"(lower({_p(1)}) = 'https' AND lower({_p(3)}) = 'ththin.example.com' OR lower({_p(3)}) = 'ththan.example.net')"
_BASE = f"lower({_p(1)}) || '://' || lower({_p(3)})"
_ID = "page_id::VARCHAR"


def _unescaped(x: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    return x


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\n\\r\\t]+', ' ', 'g'))"


_TITLE = _collapsed(_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))
_HEAD = _collapsed(_unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))
_STRIPPED = "regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'gs')"
_TEXT = _collapsed(_unescaped(f"regexp_replace({_STRIPPED}, '<[^>]*>', ' ', 'g')"))


def marked_pages(spark, sf_dir) -> DataFrame:
    """Pages with directives, a canonical link, links of all kinds and a heading before their markup, and a header."""
    i = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 6 == 0, "other").when(F.col("page_id") % 6 == 5, "QuarryMill").otherwise("robots")
    said = F.element_at(F.array(*map(F.lit, ("noindex", "noindex", "x, NOFOLLOW", "none", "index,follow", "noindex"))), (F.col("page_id") % 6 + 1).cast("int"))
    canonical = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/c/"), i)).otherwise(F.concat(F.lit(f"{HOME}:443/c/"), i, F.lit("/?utm_source=x#top")))
    links = F.concat(F.lit('<a href="/up/'), i, F.lit('">x</a><a href=\'sub?q='), i, F.lit('#f\'>y</a><a href="?z='), i, F.lit('">z</a><a href="//ththan.example.net/k/'), i, F.lit('/">k</a><a href="/UP/'), i,
                     F.lit('">again</a><a rel="nofollow" href="/no">n</a><a href="mailto:a@b.example">m</a><a href=" ">b</a><a name="q">q</a>'))
    head = F.concat(F.lit('<meta name="'), name, F.lit('" content="'), said, F.lit('"><link rel="Canonical" href="'), canonical, F.lit('">'), links, F.lit("<h2>Head <i>"), i, F.lit("</i></h2>"))
    header = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("noindex", "otherbot: noindex", f"{AGENT}: nofollow"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(head, "html").alias("html"), header.alias("header"))


_NOINDEX = "(page_id % 6 IN (1, 3, 5) OR page_id % 4 = 1)"
_NOFOLLOW = "(page_id % 6 IN (2, 3) OR page_id % 4 = 3)"
_CANONICAL = f"CASE WHEN page_id % 2 = 1 THEN '{HOME}/c/' || {_ID} WHEN {_SCOPE} THEN {_BASE} || '/c/' || {_ID} END"


@query(f"""SELECT page_id, nullif({_TITLE}, '') AS title, trim({_TITLE} || ' Head ' || {_ID} || ' ' || {_HEAD}) AS headings, trim('x y z k again n m b q Head ' || {_ID} || ' ' || {_TEXT}) AS text,
  {_NOINDEX} AS noindex, {_NOFOLLOW} AS nofollow, {_CANONICAL} AS canonical FROM pages""")
def html_analysis(spark, sf_dir):
    p = marked_pages(spark, sf_dir)
    return p.select("page_id", html.analysis(F.col("html").cast("binary"), F.lit(None).cast("string"), F.col("url"), F.col("header"), RULES, AGENT).alias("a")).select(
        "page_id", "a.title", "a.headings", "a.text", "a.noindex", "a.nofollow", "a.canonical")


@query(f"""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(
  CASE WHEN {_SCOPE} THEN [{_BASE} || '/up/' || {_ID}, {_BASE} || regexp_replace({_PATH}, '[^/]*$', '') || 'sub?q=' || {_ID}, {_BASE} || CASE WHEN rtrim({_PATH}, '/') = '' THEN '/' ELSE rtrim({_PATH}, '/') END || '?z=' || {_ID}] ELSE [] END
  || [lower({_p(1)}) || '://ththan.example.net/k/' || {_ID}])) AS link FROM pages WHERE NOT {_NOFOLLOW}) WHERE starts_with(link, 'https://ththin.example.com/') OR contains(link, '://ththan.example.net/')""")
def page_outlinks(spark, sf_dir):
    p = marked_pages(spark, sf_dir)
    a = html.analysis(F.col("html").cast("binary"), F.lit("utf-8"), F.col("url"), F.col("header"), RULES, AGENT)
    return p.select("page_id", F.explode(a["outlinks"]).alias("link"))


LIMIT = 5000
SAME, TWIN = "<html><title>Same</title><p>the same page</p></html>", "<html><title>Twin</title><p>a page that is stored</p></html>"


def fetches(spark, sf_dir) -> DataFrame:
    i, none = F.col("page_id"), F.lit(None).cast("string")
    pick = lambda n, *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (i % n + 1).cast("int"))
    text = F.when(i % 11 == 0, "plain words").when(i % 11 == 1, F.concat(F.lit('<html><meta name="robots" content="noindex">'), "html")).when(i % 11 == 2, SAME).when(
        i % 11 == 3, F.concat(F.lit(f'<html><link rel="canonical" href="{HOME}/c/'), i.cast("string"), F.lit('">'), "html")).when(i % 11 == 5, TWIN).otherwise(F.col("html"))
    final = F.when(i % 10 == 1, F.concat(F.lit(f"{HOME}/final/"), i)).when(i % 10 == 2, F.concat(F.lit("https://elsewhere.example/x"), i))
    return table(spark, sf_dir, "pages").select(
        urls.normalise(F.col("url")).alias("url"), final.alias("final_url"), pick(7, 404, 304, 410, 500, 200, 200, 200).alias("status"),
        pick(9, "image/png", none, "text/plain; charset=utf-8", "application/octet-stream", *["text/html"] * 5).alias("content_type"), none.alias("charset"), F.concat(F.lit("e"), i).alias("etag"), none.alias("last_modified"),
        none.alias("x_robots_tag"), text.cast("binary").alias("body"), i.alias("ord"))


def stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """State and chunks before: some pages with their own hash, half of these with chunks; one page that is TWIN."""
    none = F.lit(None).cast("string")
    own = fetches(spark, sf_dir).filter("ord % 13 = 0").select(F.coalesce("final_url", "url").alias("url"), content.content_hash(F.col("body")).alias("content_hash"), "ord")
    twin = spark.range(1).select(F.lit(f"{HOME}/stored").alias("url"), content.content_hash(F.lit(TWIN).cast("binary")).alias("content_hash"), F.lit(0).cast("long").alias("ord"))
    rows = own.unionByName(twin)
    state = rows.select("url", F.lit(None).cast("timestamp").alias("last_crawled"), F.lit(200).alias("status_code"), F.lit("old").alias("etag"), none.alias("last_modified"), F.lit("old").alias("title"), "content_hash")
    return state, rows.filter("ord % 26 = 0").select("url")


_BODY = f"""CASE page_id % 11 WHEN 0 THEN 'plain words' WHEN 1 THEN '<html><meta name="robots" content="noindex">' || html WHEN 2 THEN '{SAME}' WHEN 3 THEN '<html><link rel="canonical" href="{HOME}/c/' || page_id || '">' || html WHEN 5 THEN '{TWIN}' ELSE html END"""
_JOBS = f"""f AS (SELECT page_id AS ord, {_NORMAL} AS url, CASE page_id % 10 WHEN 1 THEN '{HOME}/final/' || page_id WHEN 2 THEN 'https://elsewhere.example/x' || page_id END AS final, [404, 304, 410, 500, 200, 200, 200][page_id % 7 + 1] AS status,
  page_id % 9 AS kind, {_BODY} AS body, html FROM pages),
g AS (SELECT *, coalesce(final, url) AS target, upper(sha256(body)) AS hash FROM f),
kept AS (SELECT target AS other, hash FROM g WHERE ord % 26 = 0 UNION ALL SELECT '{HOME}/stored', upper(sha256('{TWIN}'))),
dup AS (SELECT ord, min(other) AS duplicate_of FROM g JOIN kept USING (hash) WHERE other <> target GROUP BY ord),
h AS (SELECT *, CASE WHEN status = 304 THEN 'touch' WHEN ord % 10 = 2 THEN 'lost' WHEN status IN (404, 410) THEN 'gone' WHEN status <> 200 THEN 'touch' WHEN strlen(body) > {LIMIT} THEN 'touch' WHEN kind = 0 THEN 'touch'
  WHEN kind < 4 AND ord % 11 = 0 THEN 'touch' WHEN ord % 26 = 0 THEN 'touch' WHEN duplicate_of IS NOT NULL THEN 'twin' WHEN ord % 11 = 3 THEN 'canonical' WHEN ord % 11 = 1 THEN 'noindex' ELSE 'index' END AS early FROM g LEFT JOIN dup USING (ord)),
w AS (SELECT *, min(ord) FILTER (early = 'index') OVER (PARTITION BY hash) AS first_ord, arg_min(target, ord) FILTER (early = 'index') OVER (PARTITION BY hash) AS first_target FROM h),
j AS (SELECT *, CASE WHEN early IN ('index', 'noindex', 'canonical') AND first_ord < ord THEN 'copy' ELSE early END AS what FROM w),
done AS (SELECT ord, CASE WHEN what = 'lost' OR status = 304 THEN url ELSE target END AS url, CASE WHEN what IN ('lost', 'twin', 'copy', 'canonical') THEN 'alias' ELSE what END AS job, CASE WHEN what = 'lost' THEN 302 ELSE status END AS status,
  CASE WHEN what IN ('index', 'noindex') THEN nullif(CASE WHEN ord % 11 = 2 THEN 'Same' WHEN ord % 11 = 0 THEN '' ELSE {_TITLE} END, '') END AS title, CASE WHEN what IN ('index', 'noindex') THEN hash END AS content_hash,
  CASE what WHEN 'twin' THEN duplicate_of WHEN 'copy' THEN first_target WHEN 'canonical' THEN '{HOME}/c/' || ord END AS follow, CASE WHEN final IS NOT NULL AND what <> 'lost' AND status <> 304 THEN url END AS source FROM j)"""


def _decided(spark, sf_dir) -> DataFrame:
    state, chunks = stored(spark, sf_dir)
    return jobs.decide(fetches(spark, sf_dir), state.select("url", "content_hash"), chunks, RULES, agent=AGENT, limit=LIMIT)


@query(f"WITH {_JOBS} SELECT ord, url, job, status::INT AS status, title, content_hash, follow, source AS redirect_source FROM done")
def crawl_jobs(spark, sf_dir):
    return _decided(spark, sf_dir).select("ord", "url", "job", "status", "title", "content_hash", "follow", "redirect_source")


@query(f"""WITH {_JOBS}, old AS (SELECT target AS url, any_value(hash) AS hash FROM g WHERE ord % 13 = 0 GROUP BY target),
every AS (SELECT url, ord, 1 AS half, job, status, title, content_hash, 'e' || ord AS etag FROM done UNION ALL SELECT source, ord, 0, 'alias', 302, NULL, NULL, NULL FROM done WHERE source IS NOT NULL),
final AS (SELECT url, arg_max(status, (ord, half)) AS status, arg_max({{'job': job, 'title': title, 'hash': content_hash, 'etag': CASE WHEN job IN ('index', 'noindex') THEN etag END}}, (ord, half)) FILTER (job <> 'touch') AS j FROM every GROUP BY url)
SELECT f.url, status::INT AS status_code, CASE WHEN j IS NOT NULL THEN j.etag WHEN old.url IS NOT NULL THEN 'old' END AS etag, CASE WHEN j IS NOT NULL THEN j.title WHEN old.url IS NOT NULL THEN 'old' END AS title,
  CASE WHEN j IS NOT NULL THEN j.hash ELSE old.hash END AS content_hash FROM final f LEFT JOIN old ON old.url = f.url""")
def job_changes(spark, sf_dir):
    """What the jobs make of the crawl state: content and metadata, stamps of touched pages, redirect sources."""
    changed = jobs.changes(_decided(spark, sf_dir), stored(spark, sf_dir)[0], F.lit(None).cast("timestamp"), embedder=None)["state"]
    return changed.rows.select("url", "status_code", "etag", "title", "content_hash")


TYPES = ("text/html; charset=x", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip", "image/png", "TEXT/HTML", "", "application/xhtml+xml")


@query("""SELECT page_id, [true, true, true, true, false, true, true, true][page_id % 8 + 1] AS welcome, ['unknown', 'pdf', 'docx', 'unknown', 'unknown', 'html', 'unknown', 'html'][page_id % 8 + 1] AS declared,
  CASE WHEN page_id % 8 IN (1, 2, 5, 7) THEN ['', 'pdf', 'docx', '', '', 'html', '', 'html'][page_id % 8 + 1] ELSE ['html', 'html', 'pdf', 'unknown', 'html'][page_id % 5 + 1] END AS kind,
  page_id % 8 IN (1, 2, 5, 7) OR page_id % 5 <> 3 AS supported FROM pages""")
def content_types(spark, sf_dir):
    i = F.col("page_id")
    t = F.element_at(F.array(*map(F.lit, TYPES)), (i % 8 + 1).cast("int"))
    bom = F.unhex(F.lit("EFBBBF"))
    body = F.element_at(F.array(F.concat(bom, F.lit(" \n<HTML>").cast("binary")), F.col("html").cast("binary"), F.lit("%PDF-1.7").cast("binary"), F.lit("words alone").cast("binary"), F.lit("<!-- x --><p>").cast("binary")), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", content.type_welcome(t).alias("welcome"), content.declared_kind(t).alias("declared"), content.classify(t, body).alias("kind"), content.prefix_supported(body, t, F.col("url")).alias("supported"))


@query(f"SELECT page_id, {_TITLE} AS title, page_id % 4 = 3 AS told_wrong FROM pages WHERE page_id % 4 < 3 UNION ALL SELECT page_id, regexp_replace({_TITLE}, '[^\\x00-\\x7F]', '??', 'g'), true FROM pages WHERE page_id % 4 = 3")
def page_decoding(spark, sf_dir):
    """By the response's charset, by the byte order mark, as UTF-8; the last as if it were ASCII of one byte each."""
    i, none = F.col("page_id"), F.lit(None).cast("string")
    whole = F.col("html")
    body = F.when(i % 4 == 0, F.encode(whole, "UTF-16LE")).when(i % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), whole.cast("binary"))).otherwise(whole.cast("binary"))
    charset = F.when(i % 4 == 0, "utf-16le").when(i % 4 == 3, "latin1")
    a = html.analysis(body, charset, F.col("url"), none, [], AGENT)
    wide = F.regexp_replace(a["title"], "[^\\x00-\\x7F]", "?")
    return table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 == 3, wide).otherwise(a["title"]).alias("title"), (i % 4 == 3).alias("told_wrong"))


ROBOTS = "User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nUser-agent: QuarryMill\nDisallow: /en/\nAllow: /en/1*.html$\nCrawl-delay: 1.5\n# a comment\nDisallow:\nSitemap: https://maps.example/s.xml\n"
_ROBOTS_HOST = f"SELECT DISTINCT {_BASE} || CASE WHEN lower({_p(1)}) = 'http' THEN ':80' ELSE ':443' END AS origin, length({_p(3)}) % 5 AS n FROM pages"


@query(f"""SELECT origin, n = 2 AS unavailable, CASE WHEN n = 0 THEN 2.0::DOUBLE WHEN n = 4 THEN NULL END AS delay, CASE WHEN n = 0 THEN 2.0::DOUBLE ELSE 0.25 END AS wait, CASE WHEN n = 0 THEN ['https://maps.example/s.xml'] ELSE [] END AS sitemaps,
  CASE n WHEN 0 THEN [4, 12] WHEN 2 THEN [1] WHEN 4 THEN [4] ELSE []::INT[] END AS lengths, n NOT IN (0, 2, 4) AS en_allowed, n <> 2 AND n <> 4 AS en_html_allowed FROM ({_ROBOTS_HOST})""")
def robots_files(spark, sf_dir):
    """robots.txt of each origin: there, missing, failing, not asked for, and one of which the limit cuts off all but a rule."""
    pages = table(spark, sf_dir, "pages")
    origins = pages.select(urls.origin(F.col("url")).alias("origin")).distinct().withColumn("base", F.regexp_replace("origin", ":(?:80|443)$", "")).withColumn("n", F.length(F.regexp_replace("base", "^.*://", "")) % 5)
    body = F.when(F.col("n") == 4, F.concat(F.lit("User-agent: *\nDisallow: /en/\n"), F.repeat(F.lit("# padding\n"), 40), F.lit(ROBOTS))).otherwise(F.lit(ROBOTS))
    web = origins.filter("n <> 3").select(F.concat("base", F.lit("/robots.txt")).alias("url"), F.when(F.col("n") == 1, 404).when(F.col("n") == 2, 503).otherwise(200).alias("status"), body.cast("binary").alias("body"))
    found = robots_table(web, origins.select("origin"), AGENT, 300)
    path = lambda p: robots.allowed(F.lit(p), F.col("rules"))
    return found.select("origin", "unavailable", "delay", robots.request_delay(F.col("delay")).alias("wait"), F.coalesce("sitemaps", F.array()).alias("sitemaps"), F.array_sort(F.col("rules.len")).alias("lengths"), path("/en/2").alias("en_allowed"), path("/en/12.html").alias("en_html_allowed"))


_MAPPED = f"SELECT DISTINCT {_NORMAL} AS url FROM pages WHERE {_BASE} = '{HOME}' AND NOT starts_with({_PATH}, '/de/')"


@query(f"{_MAPPED}")
def sitemap_pages(spark, sf_dir):
    """A sitemap index with two sitemaps that list all pages of the web, one with a name space; those of the own origin that
    robots.txt allows count. One more has a DTD, which is refused."""
    p = table(spark, sf_dir, "pages")
    listed = lambda some: F.concat_ws("", F.collect_list(F.when(some, F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")))))
    maps = p.agg(listed(F.col("page_id") % 2 == 0).alias("a"), listed(F.col("page_id") % 2 == 1).alias("b"))
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{HOME}/{n}.xml</loc></sitemap>" for n in ("a", "b", "dtd")) + "</sitemapindex>"
    rows = F.array(
        F.struct(F.lit(f"{HOME}/sitemap.xml").alias("url"), F.lit(index).alias("body")),
        F.struct(F.lit(f"{HOME}/a.xml").alias("url"), F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "a", F.lit("</urlset>")).alias("body")),
        F.struct(F.lit(f"{HOME}/b.xml").alias("url"), F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("body")),
        F.struct(F.lit(f"{HOME}/dtd.xml").alias("url"), F.lit(f"<!DOCTYPE x []><urlset><url><loc>{HOME}/never</loc></url></urlset>").alias("body")),
    )
    web = maps.select(F.explode(rows).alias("r")).select("r.url", F.lit(200).alias("status"), F.col("r.body").cast("binary").alias("body"))
    found = sitemap_urls(web, f"{HOME}/", robots.parse("User-agent: *\nDisallow: /de/\n", AGENT), 1 << 30)
    return spark.createDataFrame([(u,) for u in found], "url string")
