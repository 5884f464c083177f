"""A crawl over a snapshot of the web: levels of a breadth-first search, each decided and committed as one batch."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding, robots, urls
from ..operators import jobs, maintain
from ..sources.shared import shared_dir
from ..sources.sitemaps import sitemap_urls
from ..sources.store import TABLES, Change, Store

#: A fetched web: what each URL answers. A URL that isn't there answers 404.
WEB = "url string, final_url string, status int, content_type string, charset string, etag string, last_modified string, x_robots_tag string, body binary"


@dataclass
class Outcome:
    indexed: int = 0
    jobs: int = 0
    levels: int = 0
    pruned: int = 0
    host_cap_hit: bool = False


def robots_table(web: DataFrame, origins: DataFrame | None, agent: str, limit: int) -> DataFrame:
    """(origin, rules, unavailable, sitemaps, delay) of origins(origin), or of those that have a robots.txt if it is None:
    others allow everything."""

    kind = pa.struct([("rules", pa.list_(pa.struct([("len", pa.int32()), ("allow", pa.bool_()), ("pattern", pa.string())]))), ("delay", pa.float64()), ("sitemaps", pa.list_(pa.string())), ("unavailable", pa.bool_())])

    @F.arrow_udf(f"struct<rules: {robots.RULES}, delay: double, sitemaps: array<string>, unavailable: boolean>")
    def parse(status: pa.Array, body: pa.Array) -> pa.Array:
        out = []
        for s, b in zip(status.to_pylist(), body.to_pylist()):
            found, down = robots.from_response(s, b, agent, limit)
            out.append({"rules": [{"len": n, "allow": a, "pattern": p} for n, a, p in found.rules], "delay": found.delay, "sitemaps": list(found.sitemaps), "unavailable": down})
        return pa.array(out, kind)

    files = web.filter(urls.path(F.col("url")) == "/robots.txt").select(urls.origin(F.col("url")).alias("origin"), "status", "body").dropDuplicates(["origin"])
    joined = files if origins is None else origins.join(files, "origin", "left")
    return joined.select("origin", parse("status", "body").alias("r")).select("origin", "r.*")


def _capped(rows, host_limit: int | None, room: int | None, per_host: Counter) -> tuple[list[int], bool]:
    """Orders of the rows that are fetched at all, in turn: a host that has its pages, or a crawl that has all, takes no
    more. rows: (ord, host of the request, host of the result, job, content)."""
    taken, skipped, indexed = [], False, 0
    owned: set[str] = set()
    for r in rows:
        if room is not None and indexed >= room:
            break
        if host_limit is not None and per_host[r.host] >= host_limit:
            skipped = True
            continue
        taken.append(r.ord)
        if r.alone == "index" and r.content_hash not in owned:
            owned.add(r.content_hash)
            indexed += 1
            per_host[r.final_host] += 1
    return taken, skipped


def crawl(store: Store, web: DataFrame, seed: str, now, max_pages: int | None = None, allowed: list[str] = (), max_per_host: int | None = None, limit: int = jobs.LIMIT, agent: str = "quarrymill", embedder: embedding.Embedder | None = embedding.hash_embed, most_levels: int = 1000) -> Outcome:
    """Crawls from the seed and brings the store up to date; now: the crawl's time. allowed: host rules besides the
    seed's own origin. When the queue has run empty, no host was capped and anything was done, URLs in scope that
    weren't seen again are pruned, but not those of servers whose robots.txt was unavailable.

    With caps, a level's order and hosts (not its pages) go through the driver, which folds them in turn.
    """
    spark = store.spark
    shared_dir(spark)
    store.create()
    start = urls.normalise_text(seed)
    if start is None:
        raise ValueError(f"no absolute URL: {seed}")
    rules = [r for r in [urls.origin_rule(start), *map(urls.parse_host_rule, allowed)] if r]
    web = web.withColumn("__key", F.lower(urls.normalise(F.col("url"))))
    redirect = web.filter(F.col("__key") == start.lower()).select(urls.normalise(F.col("final_url"))).first()
    if redirect and redirect[0] and not urls.in_scope_text(redirect[0], rules):  # the seed takes its new place along
        rules.append(urls.origin_rule(redirect[0]))
    table = robots_table(web, None, agent, limit).checkpoint()  # once a crawl
    down = table.filter("unavailable").select("origin")
    first = robots_table(web, spark.createDataFrame([(urls.origin_text(start),)], "origin string"), agent, limit).first()
    own = robots.Robots(tuple((r.len, r.allow, r.pattern) for r in first.rules), first.delay, tuple(first.sitemaps))
    listed = [u for u in sitemap_urls(web.select("url", "status", "body"), start, own, limit) if u.lower() != start.lower()]
    frontier = spark.createDataFrame([(u, i) for i, u in enumerate([*listed, start])], "url string, ord bigint")
    visited = frontier.select("url")
    result, per_host = Outcome(), Counter()
    drained = True
    while not frontier.isEmpty():
        if result.levels == most_levels or max_pages is not None and result.indexed >= max_pages:
            drained = False
            break
        result.levels += 1
        state, chunks, links = (store.read(t) for t in ("state", "chunks", "links"))
        fetched = frontier.withColumn("__key", F.lower("url")).join(web.withColumnRenamed("url", "__asked"), "__key", "left").withColumn("status", F.when(F.col("__asked").isNull(), 404).otherwise(F.col("status"))).drop("__key", "__asked")
        decide = lambda some: jobs.decide(some, state, chunks, rules, table, visited, agent, limit)  # noqa: B023, E731
        done = decide(fetched).checkpoint()
        if max_pages is not None or max_per_host is not None:
            alone = done.select("ord", urls.host(F.col("url")).alias("final_host"), "job", "content_hash", "follow")
            rows = frontier.select("ord", urls.host(F.col("url")).alias("host")).join(alone, "ord", "left").withColumn("alone", F.col("job")).orderBy("ord").collect()
            taken, skipped = _capped(rows, max_per_host, None if max_pages is None else max_pages - result.indexed, per_host)
            result.host_cap_hit |= skipped
            drained &= len(taken) == len(rows) or skipped
            if len(taken) < len(rows):  # what isn't fetched owns no content
                done = decide(fetched.join(spark.createDataFrame([(t,) for t in taken], "ord bigint"), "ord", "left_semi")).checkpoint()
        counts = done.agg(F.count("*").alias("n"), F.count_if(F.col("job") == "index").alias("indexed")).first()
        result.jobs += counts.n
        result.indexed += counts.indexed
        stored = done.filter("stored_links").select("ord", F.col("url").alias("from_url")).join(links, "from_url").select("ord", F.lit(0).alias("pos"), F.col("to_url").alias("url"))
        out = done.select("ord", F.posexplode("outlinks").alias("pos", "url")).union(stored).union(done.filter("follow IS NOT NULL").select("ord", F.lit(0), "follow"))
        out = out.filter(urls.in_scope(F.col("url"), rules))
        side = table.select(F.col("origin").alias("__o"), F.col("rules").alias("__r"))
        out = out.join(side, urls.origin(F.col("url")) == F.col("__o"), "left").filter(robots.allowed(urls.path_and_query(F.col("url")), F.col("__r")))
        seen = visited.union(done.select("url")).select(F.lower("url").alias("key")).distinct()
        fresh = out.groupBy(F.lower("url").alias("key")).agg(F.min(F.struct("ord", "pos", "url")).alias("x")).join(seen, "key", "left_anti")
        ordered = fresh.select(F.col("x.url").alias("url"), F.col("x.ord").alias("o"), F.col("x.pos").alias("p"), "key").checkpoint()
        store.commit(jobs.changes(done, state, now, embedder))
        base = (frontier.agg(F.max("ord")).first()[0] or 0) + 1
        frontier = _number(ordered, base).checkpoint()
        visited = visited.union(done.select("url")).union(frontier.select("url")).distinct().checkpoint()
    if drained and not result.host_cap_hit and result.jobs:
        result.pruned = prune(store, now, rules, down)
    store.compact()
    return result


def _number(rows: DataFrame, base: int) -> DataFrame:
    """(url, ord): in order of discovery, without moving all rows to one task: ranges of the order are counted first."""
    parts = rows.repartitionByRange("o", "p", "key").sortWithinPartitions("o", "p", "key").select("url", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    low = F.col("id") - F.shiftleft(F.col("part").cast("long"), 33)
    held = parts.select("url", "part", low.alias("low")).checkpoint()
    sizes = sorted((r.part, r["count"]) for r in held.groupBy("part").count().collect())
    begin, offsets = base, []
    for part, n in sizes:
        offsets.append((part, begin))
        begin += n
    return held.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, begin bigint")), "part").select("url", (F.col("begin") + F.col("low")).alias("ord"))


def prune(store: Store, before, rules: list[urls.HostRule], unavailable: DataFrame | None = None) -> int:
    """Removes URLs in scope not crawled since; those of unavailable(origin) stay."""
    shared_dir(store.spark)
    old = maintain.stale(store.read("state"), before).filter(urls.in_scope(F.col("url"), rules))
    if unavailable is not None:
        old = old.join(unavailable.distinct(), urls.origin(F.col("url")) == F.col("origin"), "left_anti")
    old = old.select("url").checkpoint()
    n = old.count()
    if n:
        store.commit({t: Change(None, old) for t in TABLES})
    return n
