"""Operators of the index, the crawl and the stream, on fixtures of a few rows."""

import sqlite3
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill import queries
from quarrymill.functions import text, urls
from quarrymill.functions.text import Query
from quarrymill.operators import fulltext, graph, jobs, knn, maintain
from quarrymill.operators.rank import Settings, rank
from quarrymill.plans import search
from quarrymill.plans.crawl import WEB, crawl
from quarrymill.sources.sitemaps import parse_sitemap
from quarrymill.sources.store import Change, Store
from quarrymill.streaming.ingest import ingest, read_fetches

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
V = "url string, text string, is_heading boolean, distance double, ord int"
K = "url string, text string, is_heading boolean, exact_phrase boolean, ord int"
S = Settings(max_distance=0.5)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("vector, keyword, query, title, score", [
    ([], [("https://e.com/x", "t", False, True, 1)], "foo", None, 0.50),
    ([], [("https://e.com/foo.html", "t", False, True, 1)], "foo", None, 0.90),
    ([], [("https://e.com/foo-bar_x.html", "t", False, True, 1)], "foo bar", None, 0.90),
    ([("https://e.com/x", "t", True, 0.4, 1)], [], "foo", None, 0.90),
    ([("https://e.com/x", "has FOO", False, 0.4, 1)], [], "foo", None, 0.80),
    ([("https://e.com/foo", "foo", True, 0.4, 1)], [("https://e.com/foo", "y", False, True, 1)], "foo", None, 2.00),
    ([("https://e.com/x", "t", False, 0.4, 1)], [("https://e.com/x", "y", False, False, 1)], "foo", None, 0.85),
    ([], [("https://e.com/x", "t", False, True, 1), ("https://e.com/x", "t", False, False, 2)], "foo", None, 0.50),
    ([("https://e.com/x", "t", False, 0.4, 1)], [], "foo", "The Foo", 0.95),
])
def test_rank_scores(spark, vector, keyword, query, title, score):
    titles = spark.createDataFrame([("https://E.com/x", title)], "url string, title string") if title else None
    got = rows(rank(spark.createDataFrame(vector, V), spark.createDataFrame(keyword, K), query, S, titles, digits=6))
    assert len(got) == 1 and got[0][4] == pytest.approx(score)


def test_rank_snippets(spark):
    v = spark.createDataFrame([("https://E.com/a", "far", False, 0.49, 2), ("https://e.com/a", "near", False, 0.2, 1), ("https://e.com/b", "edge", None, 0.5, 3), ("https://e.com/c", "out", False, 0.51, 4)], V)
    k = spark.createDataFrame([("https://e.com/a", "kw", False, True, 1), ("https://e.com/d", "first", False, False, 2), ("https://e.com/d", "second", True, False, 3)], K)
    got = {r[0]: r for r in rows(rank(v, k, "q", S, digits=6))}
    assert set(got) == {"https://e.com/a", "https://e.com/b", "https://e.com/d"}
    assert got["https://e.com/a"][2:] == ("near", 0.8, 1.3) and got["https://e.com/b"][2:] == ("edge", 0.5, 0.5) and got["https://e.com/d"][2:] == ("first", 0.0, 0.55)


def test_knn_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [1.0, None]), (8, [-1.0, 0.0])], "id int, embedding array<float>")
    assert rows(knn.top_k(df, [1.0, 0.0], 3, digits=5)) == [(1, 0.0), (6, 0.0), (2, 1.0)]
    assert rows(knn.top_k(df, [1.0, 0.0], 9, max_distance=1.0, digits=5)) == [(1, 0.0), (6, 0.0), (2, 1.0)]
    assert rows(knn.top_k(df.limit(0), [1.0, 0.0], 3)) == []


TEXTS = ["foo middle bar", "foo bar", "only foo here", "foo_bar baz foo bar", "", "running runs run", "Café CAFE cafés"]


def test_bm25_is_that_of_a_full_text_index(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(TEXTS))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, x string").select("id", text.token_array(F.col("x")).alias("tokens"))
    index = fulltext.postings(df).cache()
    for query in ("foo bar", "foo", "run", "cafe", "foo_bar foo", "here only", "nothing", "bar middle"):
        for phrases, match in ((fulltext.phrase_of(query), f'"{query}"'), (fulltext.terms_of(query), " AND ".join(f'"{w}"' for w in query.split()))):
            if not phrases:
                continue
            want = con.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid", (match,)).fetchall()
            got = rows(fulltext.top_k(df, phrases, 10, digits=9))
            assert sorted(r[0] for r in got) == sorted(r[0] for r in want), (query, match)
            assert {i: pytest.approx(r, abs=1e-6) for i, r in want} == dict(got)
            assert dict(rows(fulltext.top_k_postings(index, df.select(F.size("tokens").alias("n_tokens")), phrases, 10, digits=9))) == dict(got)
            assert sorted(r[0] for r in rows(fulltext.match_postings(index, phrases))) == sorted(r[0] for r in want)
    assert rows(fulltext.top_k(df, fulltext.phrase_of("?!"), 5)) == []
    assert fulltext.terms_of("one") == [] and fulltext.terms_of("a _") == []


def test_maintenance(spark):
    schema = "url string, last_crawled timestamp, status_code int, etag string, last_modified string, title string, content_hash string"
    old = spark.createDataFrame([("a", T1, 200, "e", "m", "t", "h"), ("b", T1, 200, "e", "m", "t", "h"), ("c", None, 200, None, None, None, "z")], schema)
    new = spark.createDataFrame([("b", T2, 201, None, None, "t2", "h2"), ("d", T2, 200, None, None, None, "h")], schema)
    up = maintain.upsert_state(old, new)
    assert {r.url: (r.status_code, r.etag, r.title) for r in up.collect()} == {"a": (200, "e", "t"), "b": (201, None, "t2"), "c": (200, None, None), "d": (200, None, None)}
    seen = maintain.record_visits(old, spark.createDataFrame([("a", T2, 304, False), ("b", T2, 404, True), ("x", T2, 500, False)], "url string, last_crawled timestamp, status_code int, clear boolean"))
    assert {r.url: (r.status_code, r.etag) for r in seen.collect()} == {"a": (304, "e"), "b": (404, None), "c": (200, None), "x": (500, None)}
    assert sorted(r[0] for r in rows(maintain.stale(old, T2))) == ["a", "b", "c"] and [r[0] for r in rows(maintain.stale(old, T1))] == ["c"]
    links = maintain.replace_outlinks(spark.createDataFrame([("a", "1"), ("b", "2")], "from_url string, to_url string"), spark.createDataFrame([("a", ["3", "3", None]), ("c", [])], "from_url string, to_urls array<string>"))
    assert sorted(rows(links)) == [("a", "3"), ("b", "2")]
    chunks = spark.createDataFrame([("a",), ("a",)], "url string")
    assert rows(maintain.duplicates_of(new.select("url", "content_hash"), old, chunks)) == [("d", "h", "a")]
    assert rows(maintain.index_stats(old, chunks, 7)) == [(1, 2, 3, T1, 7)]
    assert rows(maintain.index_stats(old.limit(0), chunks.limit(0))) == [(0, 0, 0, None, 0)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("a", None)], "from_node string, to_node string")
    assert sorted(rows(graph.levels(edges, spark.createDataFrame([("a",)], "node string")))) == [("a", 0), ("b", 1), ("c", 2)]


def test_levels_of_any_depth(spark, tmp_path):
    chain = [7**i % 1000 for i in range(20)]
    spark.createDataFrame([(3, k) for k in chain], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(rows(queries.QUERIES["frontier_bfs"](spark, str(tmp_path)))) == sorted((k, i) for i, k in enumerate(chain))
    line = spark.createDataFrame([(i, i + 1) for i in range(40)], "from_node bigint, to_node bigint")
    assert sorted(rows(graph.levels(line, spark.createDataFrame([(0,)], "node bigint"), None))) == [(i, i) for i in range(41)]
    assert graph.levels(line, spark.createDataFrame([(0,)], "node bigint"), 3).count() == 4


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    with pytest.raises(search.IndexNotBuilt):
        search.search(store, "x")
    store.create()
    store.create()
    with pytest.raises(ValueError):
        search.search(store, "  ")
    pages = spark.createDataFrame([("https://a.com/1", "The quick brown fox", False), ("https://b.com/2", "The quick brown fox", False), ("https://a.com/3", "lazy dogs sleep", False), ("https://a.com/4", " ", False)], "url string, text string, is_heading boolean")
    search.index_documents(store, pages)
    got = rows(search.search(store, "The quick brown fox"))
    assert [r[0] for r in got][:2] == ["https://a.com/1", "https://b.com/2"] and got[0][3] == pytest.approx(1) and got[0][4] == pytest.approx(1.7)
    assert [r[0] for r in rows(search.search(store, "site:b.com the quick brown fox"))] == ["https://b.com/2"]
    assert rows(search.search(store, "site:b.com")) == []
    search.index_documents(store, spark.createDataFrame([("https://a.com/1", "something else", False)], pages.schema))
    assert rows(search.search(store, "quick brown", Settings(max_distance=0.0)))[0][0] == "https://b.com/2"
    assert len(rows(search.search(store, "quick brown", Settings(max_distance=0.0)))) == 1
    search.delete_urls(store, spark.createDataFrame([("https://b.com/2",)], "url string"))
    before = sorted(rows(store.read("chunks").select("url", "text")))
    assert before == [("https://a.com/1", "something else"), ("https://a.com/3", "lazy dogs sleep")]
    assert store.compact(force=True) and sorted(rows(store.read("chunks").select("url", "text"))) == before
    assert rows(search.stats(store))[0][:3] == (2, 2, 0) and store.bytes() > 0
    assert store.vacuum() > 3 and store.vacuum() == 0 and sorted(rows(store.read("chunks").select("url", "text"))) == before
    with pytest.raises(RuntimeError):
        now = store.manifest()
        store._publish(now)


def page(body, **meta):
    return f"<html><head>{meta.get('head', '')}</head><body>{body}</body></html>".encode()


def web(spark, pages):
    out = []
    for url, p in pages.items():
        p = {"body": p} if isinstance(p, bytes) else p
        out.append((url, p.get("final"), p.get("status", 200), p.get("type", "text/html"), None, p.get("etag"), None, p.get("x"), p.get("body")))
    return spark.createDataFrame(out, WEB)


SEED = "https://s.com/"
SITE = {
    SEED: page('<a href="/p2">2</a><a href="/p3#x">3</a><a href="https://other.com/">o</a><a href="/secret/x">s</a>home'), "https://s.com/p2": page('<a href="/p4?utm_source=q">4</a>two'),
    "https://s.com/p3": page('<a href="/p4?utm_source=q">4</a>two'.replace("4</a>two", "4</a>three")), "https://s.com/p4": page("four"), "https://s.com/robots.txt": {"body": b"User-agent: *\nDisallow: /secret", "type": "text/plain"},
    "https://s.com/sitemap.xml": {"body": b"<urlset xmlns='x'><url><loc>https://s.com/only-in-sitemap</loc></url><url><loc>https://other.com/z</loc></url></urlset>", "type": "text/xml"},
    "https://s.com/only-in-sitemap": page("from the sitemap"), "https://s.com/secret/x": page("secret"),
}


def state(store):
    return {r.url.removeprefix("https://s.com/"): r.status_code for r in store.read("state").collect()}


def indexed(store):
    return {r.url.removeprefix("https://s.com/") for r in store.read("chunks").select("url").distinct().collect()}


def test_crawl(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    first = crawl(store, web(spark, SITE), SEED, T1)
    assert indexed(store) == {"", "p2", "p3", "p4", "only-in-sitemap"} and first.indexed == 5 and first.levels == 3 and first.pruned == 0
    assert set(state(store).values()) == {200}
    assert sorted(rows(store.read("links"))) == [("https://s.com/", "https://s.com/p2"), ("https://s.com/", "https://s.com/p3"), ("https://s.com/", "https://s.com/secret/x"), ("https://s.com/p2", "https://s.com/p4"), ("https://s.com/p3", "https://s.com/p4")]
    again = dict(SITE) | {"https://s.com/p3": {"status": 410}, "https://s.com/p2": {"status": 304}, "https://s.com/only-in-sitemap": {"status": 503}}
    second = crawl(store, web(spark, again), SEED, T2)
    assert indexed(store) == {"", "p2", "p4", "only-in-sitemap"} and second.indexed == 0
    assert state(store) == {"": 200, "p2": 304, "p3": 410, "p4": 200, "only-in-sitemap": 503}
    gone = {k: v for k, v in SITE.items() if k in (SEED, "https://s.com/robots.txt")} | {SEED: page("alone")}
    third = crawl(store, web(spark, gone), SEED, datetime(2024, 3, 1))
    assert third.pruned == 4 and indexed(store) == {""} and state(store) == {"": 200}


def test_crawl_rules(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    copy = page("the same words")
    site = {
        SEED: page("".join(f'<a href="/{x}">x</a>' for x in ("a", "b", "moved", "away", "canon", "hidden", "nofollow", "image", "zip", "missing", "broken")) + "home"),
        "https://s.com/a": copy, "https://s.com/b": copy, "https://s.com/moved": {"final": "https://s.com/target", "body": page("moved here")}, "https://s.com/away": {"final": "https://other.com/", "body": page("x")},
        "https://s.com/canon": page("dup", head='<link rel=canonical href="/a">'), "https://s.com/hidden": page('<a href="/deep">d</a>hidden', head='<meta name="robots" content="noindex">'),
        "https://s.com/nofollow": {"body": page('<a href="/never">d</a>nofollow'), "x": "nofollow"}, "https://s.com/image": {"body": b"GIF", "type": "image/gif"}, "https://s.com/zip": {"body": b"PK\3\4zz", "type": "application/zip"},
        "https://s.com/deep": page("deep"), "https://s.com/never": page("never"), "https://s.com/broken": {"body": b"%PDF-", "type": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"},
    }
    crawl(store, web(spark, site), SEED, T1)
    assert indexed(store) == {"", "a", "target", "nofollow", "deep"}
    assert state(store) == {"": 200, "a": 200, "b": 200, "moved": 302, "target": 200, "away": 302, "canon": 200, "hidden": 200, "nofollow": 200, "image": 200, "zip": 200, "missing": 404, "deep": 200, "broken": 500}
    meta = {r.url.removeprefix("https://s.com/"): r.content_hash for r in store.read("state").collect()}
    assert meta["b"] is None and meta["a"] and meta["hidden"]


@pytest.mark.parametrize("limits, want", [({"max_pages": 2}, 2), ({"max_per_host": 3}, 3), ({"max_pages": 100}, 5)])
def test_crawl_caps(spark, tmp_path, limits, want):
    store = Store(spark, f"file://{tmp_path}/index")
    out = crawl(store, web(spark, SITE), SEED, T1, embedder=None, **limits)
    assert out.indexed == want == len(indexed(store)) and out.host_cap_hit == ("max_per_host" in limits)


def test_seed_redirect_and_robots_down(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    site = {SEED: {"final": "https://www.s.com/", "body": page('<a href="/x">x</a>home')}, "https://www.s.com/x": page("x")}
    crawl(store, web(spark, site), SEED, T1)
    assert {r[0] for r in rows(store.read("chunks").select("url").distinct())} == {"https://www.s.com/", "https://www.s.com/x"}
    down = {SEED: page("home"), "https://s.com/robots.txt": {"status": 503}}
    out = crawl(store, web(spark, down), SEED, T2)
    assert out.jobs == 0 and out.pruned == 0


def test_sitemaps():
    assert parse_sitemap(b"<sitemapindex><sitemap><loc> a </loc></sitemap></sitemapindex>", 99) == ([], ["a"])
    assert parse_sitemap(b'<!DOCTYPE x [<!ENTITY a "b">]><urlset><loc>&a;</loc></urlset>', 99) == ([], []) == parse_sitemap(b"<broken", 99) == parse_sitemap(None, 9) == parse_sitemap(b"<a><loc>x</loc></a>", 3)


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    rules = [urls.parse_host_rule("s.com")]
    put = lambda n, pages: spark.createDataFrame([(u, None, s, "text/html", None, None, None, None, b, i) for i, (u, s, b) in enumerate(pages)], jobs.FETCHES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(1, [("https://s.com/a", 200, page("one")), ("https://s.com/b", 200, page("two"))])
    for _ in range(2):
        ingest(store, read_fetches(spark, f"{tmp_path}/in", 1), rules, f"file://{tmp_path}/check").awaitTermination()
        assert indexed(store) == {"a", "b"}
    put(2, [("https://s.com/a", 410, None), ("https://s.com/c", 200, page("three")), ("https://s.com/b", 500, None)])
    ingest(store, read_fetches(spark, f"{tmp_path}/in", 1), rules, f"file://{tmp_path}/check").awaitTermination()
    assert indexed(store) == {"b", "c"} and state(store) == {"a": 410, "b": 500, "c": 200}


def test_changes_keep_metadata_through_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    store.create()
    s = spark.createDataFrame([("u", T1, 200, "e", None, "t", "h")], "url string, last_crawled timestamp, status_code int, etag string, last_modified string, title string, content_hash string")
    store.commit({"state": Change(s)})
    job = spark.createDataFrame([("u", 1, "touch", 503, None)], "url string, ord bigint, job string, status int, redirect_source string")
    for c in ("title", "headings", "text", "etag", "last_modified", "content_hash"):
        job = job.withColumn(c, F.lit(None).cast("string"))
    job = job.withColumn("outlinks", F.lit(None).cast("array<string>"))
    store.commit(jobs.changes(job, store.read("state"), T2))
    assert rows(store.read("state")) == [("u", T2, 503, "e", None, "t", "h")]


def test_a_blank_query_finds_nothing(spark):
    chunks = spark.createDataFrame([], "id string, url string, text string, is_heading boolean, tokens array<string>, embedding array<float>")
    assert rows(search.hybrid(chunks, Query("", ("a.com",)), None)) == []
    assert rows(search.hybrid(chunks, Query("a b", ()), None)) == []


def test_fetch_is_conditional_polite_and_tries_again(spark):
    import gzip
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from quarrymill.sources import fetch

    seen = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("If-None-Match"), time.monotonic()))
            if self.path == "/moved":
                self.send_response(301)
                self.send_header("Location", "/page")
                return self.end_headers()
            if self.headers.get("If-None-Match") == "tag":
                self.send_response(304)
                return self.end_headers()
            if self.path == "/busy" and sum(p == "/busy" for p, *_ in seen) < 3:
                self.send_response(503)
                return self.end_headers()
            self.send_response(404 if self.path == "/gone" else 200)
            for k, v in (("Content-Type", "text/html; charset=utf-8"), ("ETag", "tag"), ("X-Robots-Tag", "noindex"), ("Content-Encoding", "gzip")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(gzip.compress(b"x" * 5000 if self.path == "/large" else b"<p>hello</p>"))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    wanted = [(f"{base}/page", None), (f"{base}/moved", None), (f"{base}/old", "tag"), (f"{base}/busy", None), (f"{base}/gone", None), (f"{base}/large", None), ("http://127.0.0.1:1/none", None), (None, None)]
    got = {r.url.removeprefix(base): r for r in fetch.fetch(spark.createDataFrame(wanted, "url string, etag string"), limit=1000, least_delay=0.1, waits=(0.05, 0.05)).collect()}
    server.shutdown()
    page = got["/page"]
    assert (page.status, page.content_type, page.charset, page.etag, page.x_robots_tag, bytes(page.body)) == (200, "text/html", "utf-8", "tag", "noindex", b"<p>hello</p>")
    assert got["/moved"].final_url == f"{base}/page" and got["/old"].status == 304 and got["/busy"].status == 200 and got["/gone"].status == 404
    assert len(got["/large"].body) == 1001 and got["http://127.0.0.1:1/none"].status is None and len(got) == 7
    own = sorted(t for p, _, t in seen if p in ("/page", "/old", "/gone", "/large"))
    assert min(b - a for a, b in zip(own, own[1:])) >= 0.09


def test_command_line(spark, tmp_path, capsys):
    from quarrymill.__main__ import answer, main, parser

    web = spark.createDataFrame([("https://e.example/a", None, 200, "text/html", None, None, None, None, b"<title>Hello</title><p>some words here")], WEB)
    web.write.parquet(f"{tmp_path}/web")
    store = f"file://{tmp_path}/index"
    assert answer(spark, "search", Store(spark, store), "words")[0] == 503 and answer(spark, "search", Store(spark, store), " ")[0] == 400
    assert main(["crawl", store, f"{tmp_path}/web", "https://e.example/a", "--max-pages", "5", "--allowed-server", "x.example"], spark) == 0
    assert main(["search", store, "words"], spark) == 0 and main(["stats", store], spark) == 0 and main(["search", store, ""], spark) == 1
    out = capsys.readouterr().out
    assert '"indexed": 1' in out and '"totalMatches": 1' in out and '"title": "Hello"' in out and '"known_urls": 1' in out
    for bad in (["crawl", "s", "w", "u", "--max-pages", "0"], ["nothing"], ["search", "s", "q", "--x"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_many_queries_go_in_blocks(spark):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 0.5]) for i in range(60)], "id int, embedding array<float>")
    q = e.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "embedding")
    one, many = (sorted(rows(knn.top_k_of_each(e, q, 4, digits=5, block=b))) for b in (1000, 6))
    assert one == many and len(one) == 80


@pytest.mark.parametrize("digits", [5, None])
def test_nearest_of_each_are_those_of_the_exact_distance(spark, digits):
    """The product of matrices chooses pairs, the plan's own expression tells what is right: ties, copies, odd sizes and gaps too."""
    rng = np.random.default_rng(3)
    rows_ = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 3)] if i % 3 else [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(300)]
    rows_ += [(1000 + i, x) for i, x in enumerate([None, [], [1.0, None, 2.0], [0.0, 0.0, 0.0], [1e-30, 2e-30, 0.0], [1e30, 1.0, 1e30], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [2.0, 4.1]])]
    e = spark.createDataFrame(rows_, "id bigint, embedding array<float>").repartition(3)
    q = e.filter("id % 7 = 0 OR id >= 1000").select(F.col("id").alias("query_id"), "embedding")
    d = knn.cosine_distance(F.col("embedding"), F.col("x"))
    d = d if digits is None else F.round(d, digits) + F.lit(0.0)
    every = e.crossJoin(q.withColumnRenamed("embedding", "x")).select("query_id", "id", d.alias("distance")).filter("distance IS NOT NULL")
    want = every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter("place <= 5")
    for block in (None, 7):
        got = knn.top_k_of_each(e, q, 5, digits=digits, block=block)
        assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


def test_many_vectors_of_many_queries_take_seconds(spark, tmp_path):
    """20,000 rows, 400 queries, 64 numbers: eight million pairs (F1)."""
    x = np.random.default_rng(1).normal(size=(20000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.perf_counter()
    got = rows(queries.QUERIES["knn_of_queries"](spark, str(tmp_path)))
    took = time.perf_counter() - began
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    near = np.sort(1 - u[::50] @ u.T, axis=1)[:, :10]
    assert len(got) == 4000 and np.abs(np.array([r[2] for r in sorted(got, key=lambda r: (r[0], r[3]))]).reshape(400, 10) - near).max() < 1e-5 and took < 60


def test_postings_are_made_in_place(spark, tmp_path):
    """No shuffle, however the tokens fall into runs; a store's commit and compaction have none of a large version (F5 to F11)."""
    lists = [(i, f"u{i % 3}", [f"w{(i * j) % 7}" for j in range(i % 5)] + ([None] if i == 4 else [])) for i in range(40)] + [(90, "u", None), (91, "u", [])]
    df = spark.createDataFrame(lists, "id bigint, url string, tokens array<string>").coalesce(2)
    want = sorted((repr(w), i, u, [p for p, x in enumerate(t) if x == w], len(t)) for i, u, t in lists if t for w in set(t))
    plan = fulltext.postings(df, keep=("url",))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((repr(r[0]), *r[1:]) for r in rows(plan)) == want
    runs = list(fulltext._runs(["term", "id", "url", "positions", "n_tokens"])(iter(df.toArrow().to_batches())))
    assert sorted((repr(r["term"]), r["id"], r["url"], r["positions"], r["n_tokens"]) for b in runs for r in b.to_pylist()) == want
    store = Store(spark, f"file://{tmp_path}/index")
    store.create()
    pages = spark.createDataFrame([(f"https://a.com/{i}", f"some words of page {i}", False) for i in range(30)], "url string, text string, is_heading boolean")
    search.index_documents(store, pages)
    search.index_documents(store, pages.filter("url LIKE '%7'").withColumn("text", F.lit("other text")))
    search.delete_urls(store, pages.filter("url LIKE '%9'").select("url"))
    before = {t: sorted(rows(store.read(t).drop("embedding")), key=repr) for t in ("chunks", "postings")}
    assert "SortMergeJoin" not in store.read("postings")._jdf.queryExecution().executedPlan().toString()
    from quarrymill.sources import store as module

    for large in (1, 1 << 30):  # all versions stay in order, or none
        module.LARGE, was = large, module.LARGE
        try:
            assert store.compact(force=True)
        finally:
            module.LARGE = was
        assert {t: sorted(rows(store.read(t).drop("embedding")), key=repr) for t in before} == before
        store.commit({t: Change(None, spark.createDataFrame([("none",)], "url string")) for t in ("chunks", "postings")})
    assert {r[0] for r in rows(fulltext.match_postings(store.read("postings"), [["other", "text"]]))} == {r[0] for r in rows(store.read("chunks").filter("text = 'other text'").select("id"))}


def test_dictionary_counts_by_term_alone(spark):
    """What a task holds are terms, not terms of each chunk; ids that occur twice, and no id, are one chunk each (F12)."""
    some = [(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None)]
    df = spark.createDataFrame(some, "id bigint, tokens array<string>")
    plan = fulltext.dictionary(df)
    assert sorted(rows(plan)) == [("a", 2, 3), ("b", 1, 1)] and "keys=[term" in plan._jdf.queryExecution().executedPlan().toString() and ", id#" not in str(plan._jdf.queryExecution().executedPlan()).split("Scan")[0]
    again = spark.createDataFrame([*some, (1, ["a", "c"]), (None, ["c"]), (None, ["c", "d"]), (4, ["e"])], df.schema)
    assert sorted(rows(fulltext.dictionary(again))) == [("a", 2, 4), ("b", 1, 1), ("c", 2, 3), ("d", 1, 1), ("e", 1, 1)]
