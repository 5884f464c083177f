import io
import sqlite3
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import chunking, content, embedding, html, robots, text, urls


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize("query, want, sites", [
    ("plain words", "plain words", ()), ("site:a.com x", "x", ("a.com",)), ("x SITE:HTTPS://A.com:80/p y", "x y", ("a.com",)),
    ("site: x", "site: x", ()), ("website:a.com x", "website:a.com x", ()), ("site:. x", "x", ()), ("site:a.com site:b.org", "", ("a.com", "b.org")), ("", "", ()), (None, "", ()),
])
def test_parse_query(spark, query, want, sites):
    assert text.parse_query(query) == text.Query(want, sites)
    if query is not None:
        df = spark.createDataFrame([(query,)], "q string")
        assert tuple(df.select(text.query_text(F.col("q")), text.query_sites(F.col("q"))).first()) == (want, list(sites))


WORDS = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll archaeologi geology a an was the running yy".split()


def test_tokens_are_those_of_a_full_text_index():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    for sample in [" ".join(WORDS), "Ça Été naïve-façade foo_bar x1 ２ Straße", "don't  stop; e.g. 3.14"]:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (sample,))
        want = [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")]
        assert text.tokens(sample) == want
    assert text.tokens(None) == [] == text.tokens("")


def test_urls(spark):
    cases = {
        "HTTP://Example.COM:80/A/b//?b=2&utm_source=x&&a=1&GCLID=3#top": "http://example.com/A/b?b=2&a=1", "https://e.com": "https://e.com/", "https://e.com:8443/x/": "https://e.com:8443/x",
        "https://u:p@e.com/?ref=1": "https://u:p@e.com/?ref=1", "/relative": None, "": None, None: None, "https://[::1]:443/a": "https://[::1]/a", "https://e.com/?utm_a=1": "https://e.com/",
    }
    assert column(spark, cases, urls.normalise) == list(cases.values()) == [urls.normalise_text(u) for u in cases]
    assert column(spark, ["http://A.b/x", "https://a.b:1/", "no"], urls.origin) == ["http://a.b:80", "https://a.b:1", None]
    assert column(spark, ["https://x.a.com/p", "https://nota.com/", "https://a.com:8/", "junk", None], lambda u: urls.matches_site(u, ["a.com"])) == [True, False, True, False, False]
    for entry, want in {"a.com": (None, "a.com", None), "https://A.com:8/": ("https", "a.com", 8), "a.com/p": None, "a.com:0": None, "a.com:70000": None, "::1": None, "[::1]:5": (None, "[::1]", 5), "": None, None: None, "1x://a": None}.items():
        rule = urls.parse_host_rule(entry)
        assert (rule and (rule.scheme, rule.host, rule.port)) == want, entry
    rules = [urls.parse_host_rule("https://a.com"), urls.parse_host_rule("b.com:81")]
    cases = {"https://a.com:9/": True, "http://a.com/": False, "http://b.com:81/x": True, "http://b.com/": False, "mailto:x@a.com": False}
    assert column(spark, cases, lambda u: urls.in_scope(u, rules)) == list(cases.values()) == [urls.in_scope_text(u, rules) for u in cases]
    cases = {"https://e.com/a/my-File_name.html": True, "https://e.com/my%2Dfile+name/": False, "https://e.com/": False, "https://e.com/x/MY%20FILE%20NAME?q=1": True, "https://e.com/%zz-my-file-name": True, None: False}
    assert column(spark, cases, lambda u: urls.file_name_contains(u, F.lit("my file_name"))) == list(cases.values())


ROBOTS = [
    ("", "/x", True), ("User-agent: *\nDisallow: /private", "/private/a", False), ("User-agent: *\nDisallow:", "/x", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True), ("User-agent: *\nDisallow: /*.php$", "/x.php?y", True), ("User-agent: *\nDisallow: /*.pdf", "/d/x.pdf?y", False),
    ("User-agent: bot\nUser-agent: other\nDisallow: /b\n\nUser-agent: *\nDisallow: /c", "/c", True), ("User-agent: bot\nDisallow: /b # why", "/b", False), ("User-agent: *\nDisallow: /", "", False),
    ("user-agent: BOT\nallow: /x\nuser-agent: bot\ndisallow: /y", "/y", False), ("User-agent: *\nDisallow: /a?b", "/a?b=1", False), ("User-agent: *\nDisallow: /a.b", "/axb", True),
]


@pytest.mark.parametrize("file, path, want", ROBOTS)
def test_robots(spark, file, path, want):
    r = robots.parse(file, "bot")
    assert r.allows(path) is want
    df = spark.createDataFrame([(path, [(n, a, p) for n, a, p in r.rules])], f"p string, r {robots.RULES}")
    assert df.select(robots.allowed(F.col("p"), F.col("r"))).first()[0] is want


def test_robots_rest():
    r = robots.parse("Sitemap: https://e.com/s.xml\nUser-agent: *\nCrawl-delay: 2.5\nSitemap: nope", "bot")
    assert r.delay == 3 and r.sitemaps == ("https://e.com/s.xml",)
    assert robots.from_response(503, b"", "b", 9) == (robots.DISALLOW_ALL, True) and not robots.DISALLOW_ALL.allows("/x")
    assert robots.from_response(404, None, "b", 9) == (robots.ALLOW_ALL, False) == robots.from_response(None, None, "b", 9)
    assert robots.from_response(200, b"User-agent: *\nDisallow: /a", "b", 25)[0].allows("/b") is False  # cut to Disallow: /


def _zip(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in names:
            z.writestr(n, t)
    return out.getvalue()


W = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>two </w:t><w:t>three</w:t></w:r></w:p></w:body></w:document>'
CORE = '<c:coreProperties xmlns:c="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> My  title </dc:title></c:coreProperties>'


def test_content(spark):
    docx, other = _zip(("word/document.xml", W), ("docProps/core.xml", CORE)), _zip(("x.txt", "y"))
    rows = [(None, docx, "docx"), (None, other, "unknown"), (None, b"%PDF-1.4", "pdf"), (None, b"\xef\xbb\xbf \n<!DOCTYPE HTML>", "html"), (None, b"<!-- x", "html"), (None, b"<p>", "unknown"), (None, b"", "unknown"), (None, None, "unknown"),
            ("application/PDF", b"x", "pdf"), ("text/html", b"%PDF-", "html"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", b"", "docx"), ("text/html; charset=x", b"zz", "unknown")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, b binary, want string").orderBy("i")
    for r in df.select("want", content.classify(F.col("t"), F.col("b")).alias("got")).collect():
        assert r.got == r.want
    types = {None: True, "": True, "text/html; charset=utf-8": True, "image/png": False, "TEXT/plain": True, "application/zip;x": True}
    assert column(spark, types, content.type_welcome) == list(types.values())
    prefixes = [(b"PK\3\4", "https://e.com/a.zip", False), (b"PK\3\4", "https://e.com/a.docx", True), (b"PK\3\4", "https://e.com/a", True), (b"x", "https://e.com/a", False), (b"<html>", None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(prefixes)], "i int, b binary, u string, want boolean")
    for r in df.select("want", content.prefix_supported(F.col("b"), F.lit(None).cast("string"), F.col("u")).alias("got")).collect():
        assert r.got == r.want
    assert content.extract_docx(docx) == ("My title", "One two three")
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj T* [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Title (A title)>> endobj\n2 0 obj <</Length 9 /Filter /FlateDecode>>\nstream\n" + stream + b"\nendstream"
    assert content.extract_pdf(pdf) == ("A title", "Hello (PDF) world")


def test_decode():
    assert content.decode("é".encode("cp1252"), "windows-1252") == "é"
    assert content.decode('<meta charset="windows-1252">é'.encode("cp1252")).endswith("é")
    assert content.decode("\ufeffé".encode("utf-16-le")) == "é"
    assert content.decode('<meta charset="utf-16">é'.encode()).endswith("é")
    assert content.decode("é".encode(), "nonsense") == "é" and content.decode(None) == ""
    assert content.decode('<meta charset="windows-1252">é'.encode(), "utf-8").endswith("é")


PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><meta name=Robots content="NoFollow"><link rel="canonical" href="/c?utm_x=1"></head>
<body><nav>menu<a href=/n>n</a></nav><h1>Big <b>head</b>ing</h1><p>one<b>two</b>&nbsp;x<script>var a = "</p>";</script><input><p>three <a href="/d#f">four</a> <a rel="x NOFOLLOW" href=/e>five</a><aside>no<aside>deep</aside>no</aside> end"""


def test_html():
    rules = [urls.parse_host_rule("e.com")]
    a = html.analyse(PAGE, "https://e.com/a/b", rules)
    assert a["title"] == "A & B" and a["headings"] == "A & B Big heading" and a["canonical"] == "https://e.com/c" and a["nofollow"] and not a["noindex"] and a["outlinks"] == []
    assert a["text"] == "A & B Big head ing one two \xa0x three four five end"
    b = html.analyse(PAGE.replace("NoFollow", "x").replace("canonical", "other"), "https://e.com/a/b", rules, "bot", "bot: noindex")
    assert b["outlinks"] == ["https://e.com/d"] and b["noindex"] and b["canonical"] is None
    assert not html.analyse("", "https://e.com/", rules, "bot", "other: noindex")["noindex"]
    assert not html.analyse("", "https://e.com/", rules, "bot", "noindex, other: nofollow")["noindex"]
    assert html.analyse("", "https://e.com/", rules, "bot", "none")["nofollow"]
    assert html.analyse("<h1>open <p>text", "https://e.com/", rules)["headings"] == "open text"
    assert html.analyse("<", "", [])["text"] == "<"


def test_chunks():
    assert chunking.chunk("") == chunking.chunk(None) == chunking.chunk(" \n ") == []
    assert chunking.chunk("short text") == ["short text"]
    assert chunking.chunk("First sentence is here. Second sentence starts here.", 10, 2) == ["First sentence is here. Second ", "Second sentence starts here."]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk("x", *bad)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;!\n-é😀", max_size=600), st.integers(4, 40), st.integers(0, 3))
def test_chunks_hold_the_text(sample, size, overlap):
    found = chunking.chunk(sample, size, overlap)
    assert bool(found) == bool(sample.strip())
    have = "".join("".join(found).split())
    assert set("".join(sample.split())) <= set(have) and len(have) >= len("".join(sample.split()))


def test_embedding(spark):
    v = embedding.hash_embed(["a", "b", "a", ""])
    assert v.shape == (4, 384) and (v[0] == v[2]).all() and not (v[0] == v[1]).all() and np.allclose((v * v).sum(1), 1, atol=1e-5)
    got = column(spark, ["a", None], embedding.embed)
    assert np.allclose(got[0], v[0]) and got[1] is None


def test_highlight(spark):
    assert column(spark, ["The cat and a Dog", None], lambda t: text.highlight(t, "the a DOG c site:x")) == ["The cat and a <mark>Dog</mark>", None]


@pytest.mark.parametrize("raw, strict, bare", [
    ("a &quot", "a &quot", "a &quot"), ("the&amp;&amp", "the&&amp", "the&&"), ("&lt;b&gt; &amp;lt; &#65;&#x42;", "<b> &lt; AB", "<b> &lt; AB"), ("?x=1&copy=2&notit;&ampere", "?x=1&copy=2&notit;&ampere", "?x=1&copy=2&notit;&ere"), ("& &;&&eacute;", "& &;&é", "& &;&é"),
])
def test_entities_need_their_semicolon(raw, strict, bare):
    """A page's title may be cut off within an entity (F2, F3, F4)."""
    assert html.unescape(raw) == strict and html.unescape(raw, html.BARE) == bare
    page = f"<html><title>{raw}</title><p>{raw}</p>"
    for kept, want in (((), strict), (html.BARE, bare)):
        a = html.analyse(page, "https://a.example/", [], bare=kept)
        assert (a["title"], a["headings"], a["text"]) == (want, want, f"{want} {want}")


def test_arrow_functions_hold_little_at_a_time(spark, tmp_path):
    """However large a batch is, Python objects are made of about a megabyte of it, or one row (F13 to F17)."""
    import pyarrow as pa

    from quarrymill.functions import batches

    x = pa.array([None if i % 9 == 8 else "ä" * (i % 5000) for i in range(3000)] + ["b" * 3_000_000])
    cut = [p for (p,) in batches.parts(x)]
    assert pa.concat_arrays(cut).equals(x) and all(len(p) == 1 or p.nbytes <= batches.BYTES for p in cut) and max(map(len, cut)) <= batches.ROWS
    assert batches.by_parts(lambda p: p, pa.string(), x[:0]).equals(x[:0])

    def embedder(texts):
        with open(f"{tmp_path}/{id(texts)}-{len(texts)}", "w") as out:
            out.write(str(sum(map(len, texts))))
        return np.ones((len(texts), 3), np.float32)

    df = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert df.select(embedding.embed(F.col("t"), embedder).alias("v")).filter("size(v) = 3").count() == 4000
    seen = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert max(seen) <= batches.BYTES


def test_stems_are_counted_by_word(spark):
    """A worker sends each stem of its texts once, not each token (F18)."""
    values = ["running runs run", "Café cafés", None, "", "run 1990s"] * 40
    df = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    want = sorted(tuple(r) for r in df.select(F.explode(text.token_array(F.col("x"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("times")).collect())
    got = text.stem_counts(df)
    assert sorted(tuple(r) for r in got.collect()) == want and "Generate" not in got._jdf.queryExecution().executedPlan().toString()
