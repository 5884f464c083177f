"""Registered queries of the stored index and of what goes into it: search, commits, stems, embeddings, chunks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import chunking, embedding, text
from .operators import fulltext, knn, maintain
from .operators.rank import Settings
from .plans import search
from .queries import Q0, _bm25, vector_of, with_vectors
from .registry import query, table
from .sources.shared import shared_dir
from .sources.store import TABLES, Change, Store

# A site of which a URL holds up to four documents as chunks, a third of them headings, some pages with titles.

WORDS, GONE, AGAIN = "of the", 7, 5
SETTINGS = Settings(max_distance=0.95, pool=200)
_URL = "'https://' || CASE WHEN doc_id % 3 = 0 THEN 'www.' ELSE '' END || source || '.example/' || CASE WHEN doc_id // 4 % 5 = 0 THEN 'best_of-the-web.html' ELSE 'page' END || '?n=' || (doc_id // 4)"


def site(spark, sf_dir) -> DataFrame:
    """(id, url, ord, text, is_heading, tokens, embedding)."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    page = F.floor(F.col("doc_id") / 4).cast("bigint")
    url = F.concat(F.lit("https://"), F.when(F.col("doc_id") % 3 == 0, "www.").otherwise(""), "source", F.lit(".example/"), F.when(page % 5 == 0, "best_of-the-web.html").otherwise("page"), F.lit("?n="), page)
    both = with_vectors(docs, vectors)
    return both.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), url.alias("url"), F.lit(0).alias("ord"), "text", (F.col("doc_id") % 3 == 1).alias("is_heading"), text.plain_tokens(F.col("text")).alias("tokens"), "embedding", "doc_id")


def stored_site(spark, sf_dir) -> Store:
    """A store of the site: written in one commit; then pages whose number has the remainder AGAIN of 11 are replaced by their
    first two documents alone, and those of GONE are deleted; at last all versions are made one."""
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/site-{uuid.uuid4().hex}")
    store.create()
    chunks = site(spark, sf_dir)
    page = F.floor(F.col("doc_id") / 4) % 11
    pages = chunks.select("url", page.alias("n")).distinct()
    title = F.when(F.length("url") % 2 == 0, F.concat(F.lit("About OF THE page "), "url")).otherwise(F.lit("Another"))
    none = F.lit(None).cast("string")
    state = pages.select("url", F.lit(None).cast("timestamp").alias("last_crawled"), F.lit(200).alias("status_code"), none.alias("etag"), none.alias("last_modified"), title.alias("title"), none.alias("content_hash"))
    store.commit(maintain.index_changes(chunks.drop("doc_id"), pages.select("url")) | {"state": Change(state, pages.select("url"))})
    store.commit(maintain.index_changes(chunks.filter((page == AGAIN) & (F.col("doc_id") % 4 < 2)).drop("doc_id"), pages.filter(F.col("n") == AGAIN).select("url")))
    search.delete_urls(store, pages.filter(F.col("n") == GONE).select("url"))
    store.compact(force=True)
    return store


_SITE = f"""chunks AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, {_URL} AS url, text, doc_id % 3 = 1 AS is_heading, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tokens, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id
  WHERE doc_id // 4 % 11 <> {GONE} AND NOT (doc_id // 4 % 11 = {AGAIN} AND doc_id % 4 >= 2))"""


def _search(words: str, site_filter: str) -> str:
    s, pool, many = SETTINGS, SETTINGS.pool, len(words.split()) > 1
    bm = f", {_bm25('p', [words], pool)}" + (f", {_bm25('a', words.split(), pool)}" if many else "")
    union = f" UNION ALL SELECT id, 0.0::DOUBLE, false, true, 1, {pool} + row_number() OVER (ORDER BY rank, id) FROM a" if many else ""
    return f"""WITH {_SITE}{bm},
v AS (SELECT id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6) + 0.0 AS distance FROM chunks WHERE embedding IS NOT NULL ORDER BY 2, 1 LIMIT {pool}),
h AS (SELECT id, 1 - distance AS sim, false AS exact, false AS terms, 0 AS phase, row_number() OVER (ORDER BY distance, id) AS ord FROM v WHERE distance <= {s.max_distance}
  UNION ALL SELECT id, 0.0::DOUBLE, true, false, 1, row_number() OVER (ORDER BY rank, id) FROM p{union}),
g AS (SELECT lower(c.url) AS key, arg_min(c.url, (phase, ord)) AS url, arg_min(c.text, (c.text = '', phase, -greatest(sim, 0.0::DOUBLE), ord)) AS text, greatest(max(sim), 0.0::DOUBLE) AS similarity, bool_or(exact) AS exact, bool_or(terms) AS terms, bool_or(is_heading) AS heading
  FROM h JOIN chunks c USING (id) {site_filter} GROUP BY 1)
SELECT url, title, text, round(similarity, 6) AS similarity, round(similarity + CASE WHEN exact THEN {s.exact_phrase}::DOUBLE WHEN terms THEN {s.all_terms}::DOUBLE ELSE 0 END + CASE WHEN heading THEN {s.heading}::DOUBLE ELSE 0 END
  + CASE WHEN contains(url, 'of-the') AND '{words}' IN ('of the', 'best') THEN {s.filename}::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), '{words}') THEN {s.term_in_text}::DOUBLE ELSE 0 END + CASE WHEN contains(lower(title), '{words}') THEN {s.title}::DOUBLE ELSE 0 END, 6) AS score
FROM (SELECT *, CASE WHEN length(url) % 2 = 0 THEN 'About OF THE page ' || url ELSE 'Another' END AS title FROM g)"""


def _found(spark, sf_dir, words: str) -> DataFrame:
    vector = np.array([vector_of(spark, sf_dir)], np.float32)
    return search.search(stored_site(spark, sf_dir), words, SETTINGS, lambda texts: vector, digits=6)


@query(_search(WORDS, ""))
def store_search(spark, sf_dir):
    return _found(spark, sf_dir, WORDS)


@query(_search(WORDS, "WHERE regexp_matches(c.url, '^https://(www\\.)?src1\\.example/')"))
def store_search_site(spark, sf_dir):
    return _found(spark, sf_dir, f"site:https://SRC1.example/x {WORDS}")


@query(_search("best", ""))
def store_search_word(spark, sf_dir):
    """One word: there is no pool of all terms."""
    return _found(spark, sf_dir, "best")


@query("SELECT NULL::VARCHAR AS url, NULL::VARCHAR AS title, NULL::VARCHAR AS text, NULL::DOUBLE AS similarity, NULL::DOUBLE AS score WHERE false")
def store_search_no_text(spark, sf_dir):
    return _found(spark, sf_dir, "site:src1.example")


@query(f"WITH {_SITE} SELECT url, count(*) AS chunks, sum(len(tokens))::BIGINT AS tokens, count(*) FILTER (is_heading) AS headings FROM chunks GROUP BY url")
def store_chunks(spark, sf_dir):
    """What the commits have left of each page."""
    rows = stored_site(spark, sf_dir).read("chunks")
    return rows.groupBy("url").agg(F.count("*").alias("chunks"), F.sum("n_tokens").cast("bigint").alias("tokens"), F.count_if("is_heading").alias("headings"))


@query(f"WITH {_SITE} SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM (SELECT id, unnest(tokens) AS term FROM chunks) GROUP BY term")
def store_postings(spark, sf_dir):
    return stored_site(spark, sf_dir).read("postings").groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


@query(f"WITH {_SITE} SELECT count(DISTINCT url) AS indexed_urls, count(*) AS chunks, (SELECT count(DISTINCT {_URL}) FROM documents WHERE doc_id // 4 % 11 <> {GONE}) AS known_urls, NULL::TIMESTAMP AS last_crawled, true AS has_bytes, {len(TABLES)}::BIGINT AS tables FROM chunks")
def store_stats(spark, sf_dir):
    store = stored_site(spark, sf_dir)
    return search.stats(store).select("indexed_urls", "chunks", "known_urls", "last_crawled", (F.col("bytes") > 0).alias("has_bytes"), F.lit(len(store.manifest()["tables"])).cast("long").alias("tables"))


# Porter's stems in SQL: `w` is the word, its letters are told apart by a pattern of A and C, in which y counts as either.

_STEP2 = text._STEP2
_STEP3 = text._STEP3
_STEP4 = text._STEP4


def _cv(w: str) -> str:
    """Vowels as A, other letters as C: y is a vowel behind a consonant."""
    a = f"regexp_replace(regexp_replace({w}, '([^aeiouy])y', '\\1V', 'g'), '([^aeiouy])y', '\\1V', 'g')"
    return f"regexp_replace(regexp_replace({a}, '[aeiouV]', 'A', 'g'), '[^A]', 'C', 'g')"


def _m(w: str) -> str:
    return f"len(regexp_extract_all({_cv(w)}, 'A+C'))"


def _vowel(w: str) -> str:
    return f"contains({_cv(w)}, 'A')"


def _cvc(w: str) -> str:
    return f"(regexp_matches({_cv(w)}, 'CAC$') AND NOT regexp_matches({w}, '[wxy]$'))"


def _but(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _by_end(rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m(_but(len(a)))} > 0 THEN {_but(len(a))} || '{b}' ELSE w END" for a, b in sorted(rules, key=lambda r: -len(r[0])))
    return f"CASE {cases} ELSE w END"


def _fourth() -> str:
    cases = []
    for a in sorted(_STEP4, key=len, reverse=True):
        also = f" AND regexp_matches({_but(3)}, '[st]$')" if a == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m(_but(len(a)))} > 1{also} THEN {_but(len(a))} ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


_AFTER = f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches({_cv('w')}, 'CC$') AND right(w, 1) = left(right(w, 2), 1) AND NOT regexp_matches(w, '[lsz]$') THEN {_but(1)} WHEN {_m('w')} = 1 AND {_cvc('w')} THEN w || 'e' ELSE w END"
_ORDER = [
    f"CASE WHEN ends_with(w, 's') THEN CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_but(2)} WHEN ends_with(w, 'ss') THEN w ELSE {_but(1)} END ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(_but(3))} > 0 THEN {_but(1)} ELSE w END WHEN ends_with(w, 'ed') AND {_vowel(_but(2))} THEN '+' || {_but(2)} WHEN ends_with(w, 'ing') AND {_vowel(_but(3))} THEN '+' || {_but(3)} ELSE w END",
    f"CASE WHEN starts_with(w, '+') THEN (SELECT {_AFTER} FROM (SELECT substr(x.w, 2) AS w)) ELSE w END",
    f"CASE WHEN ends_with(w, 'y') AND {_vowel(_but(1))} THEN {_but(1)} || 'i' ELSE w END",
    _by_end(_STEP2),
    _by_end(_STEP3),
    _fourth(),
    f"CASE WHEN ends_with(w, 'e') AND ({_m(_but(1))} > 1 OR {_m(_but(1))} = 1 AND NOT {_cvc(_but(1))}) THEN {_but(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND {_m('w')} > 1 THEN {_but(1)} ELSE w END",
]
_FOLDED = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_STEMS = f"words AS (SELECT DISTINCT unnest({_FOLDED}) AS word FROM documents),\ns0 AS (SELECT word, word AS w FROM words WHERE strlen(word) BETWEEN 3 AND 64),\n" + ",\n".join(
    f"s{i + 1} AS (SELECT word, {step} AS w FROM s{i} x)" for i, step in enumerate(_ORDER)
) + f",\nstems AS (SELECT word, w AS stem FROM s{len(_ORDER)} UNION ALL SELECT word, word FROM words WHERE strlen(word) NOT BETWEEN 3 AND 64)"


@query(f"WITH {_STEMS} SELECT stem, count(*) AS times FROM (SELECT unnest({_FOLDED}) AS word FROM documents) JOIN stems USING (word) GROUP BY stem")
def stems(spark, sf_dir):
    """How often each stem occurs in all documents."""
    return text.stem_counts(table(spark, sf_dir, "documents").select("text"))


@query(f"""WITH {_STEMS}, chunks AS (SELECT doc_id AS id, '' AS url, '' AS text, list(stem ORDER BY pos) AS tokens FROM (SELECT doc_id, unnest({_FOLDED}) AS word, generate_subscripts({_FOLDED}, 1) AS pos FROM documents) JOIN stems USING (word) GROUP BY doc_id
  UNION ALL SELECT doc_id, '', '', [] FROM documents WHERE text IS NOT NULL AND len({_FOLDED}) = 0), {_bm25("hit", ["the", "of"], 500)} SELECT id, rank FROM hit""")
def fts_stemmed(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.token_array(F.col("text")).alias("tokens"))
    return fulltext.top_k(c, [["the"], ["of"]], 500, digits=6)


_SEED = "list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::UHUGEINT), lambda h, u: (xor(h, u) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 1469598103934665603::UHUGEINT)"
def _hashed(name: str) -> str:
    """Vectors of a table (id, text): the seed by FNV-1a, then a linear congruential generator."""
    return ("""{0}s AS (SELECT id, s // 2 * 2 + 1 AS s FROM (SELECT id, """ + _SEED + """ AS s FROM {0})),
{0}l(id, i, s) AS (SELECT id, 0, s FROM {0}s UNION ALL SELECT id, i + 1, (s * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT FROM {0}l WHERE i < 384),
{0}x AS (SELECT id, list(((s // 8589934592::UHUGEINT)::DOUBLE / 2147483648 - 1)::FLOAT::DOUBLE ORDER BY i) AS x FROM {0}l WHERE i > 0 GROUP BY id)""").replace("{0}", name)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT 0 AS id, 'of the' AS text), {_hashed("d")}, {_hashed("q")}
SELECT d.id AS doc_id, round(1 - list_cosine_similarity(d.x, q.x), 5) + 0.0 AS distance FROM dx d, qx q ORDER BY 2, 1 LIMIT 50""")
def embed_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", embedding.embed(F.col("text")).alias("embedding"))
    return knn.top_k(docs, embedding.embed_query("of the"), 50, "doc_id", digits=5)


# The chunker in SQL: pieces are halved at the separator next to their middle, lines become paragraphs, paragraphs overlap.


def _cut(piece: str, kind: str, separators: tuple[str | None, ...]) -> str:
    """How many characters stand before the cut; -1 without one."""
    seps = "[" + ", ".join("NULL" if s is None else "'" + s.replace("'", "''") + "'" for s in separators) + f"][{kind}]"
    half = f"length({piece}) // 2"
    places = f"list_filter(list_transform(string_split({piece}, ''), lambda c, i: CASE WHEN contains({seps}, c) AND i < length({piece}) THEN i - 1 END), lambda i: i IS NOT NULL)"
    best = f"list_reduce({places}, lambda best, i: CASE WHEN abs({half} - i) < abs({half} - best) THEN i + 1 ELSE best END, -1::BIGINT)"
    return f"CASE WHEN {kind} = {len(separators)} THEN {half} WHEN length({piece}) > 2 THEN {best} ELSE -1 END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _chunked(separators: tuple[str | None, ...] = chunking.PLAIN, header: str = "", size: int = 150, overlap: int = 30) -> str:
    """CTEs down to chunks(id, para, chunk) of all documents; sizes are such that no line is split again."""
    over = int(overlap * chunking.TOKENS_A_WORD)
    room = int(size * chunking.TOKENS_A_WORD) - over - len(header) // 4
    cut = lambda piece, kind: _cut(piece, kind, separators)
    return f"""cut(id, path, kind, done, piece, cutat) AS (
  SELECT doc_id, '', 1, length(text) // 4 <= {chunking.LINE_TOKENS}, text, {cut("text", "1")} FROM documents WHERE text IS NOT NULL AND {_strip("text")} <> ''
  UNION ALL SELECT id, path, kind, length(piece) // 4 <= {chunking.LINE_TOKENS}, piece, {cut("piece", "kind")} FROM (
    SELECT id, path || side AS path, CASE WHEN cutat > 0 THEN kind ELSE kind + 1 END AS kind, {_strip("CASE WHEN cutat <= 0 THEN piece WHEN side = '0' THEN left(piece, cutat) ELSE substr(piece, cutat + 1) END")} AS piece
    FROM cut, (VALUES ('0'), ('1')) AS s(side) WHERE NOT done AND (cutat > 0 OR side = '0'))),
lines AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY path) AS n, {_strip("piece")} AS line FROM cut WHERE done),
fold(id, n, held, para) AS (
  SELECT id, n, length(line) + 1, 1 FROM lines WHERE n = 1
  UNION ALL SELECT l.id, l.n, CASE WHEN stop THEN 0 ELSE held END + length(line) + 1, para + stop::INT FROM (
    SELECT l.*, held, para, length(line) // 4 + 1 >= {room} OR length(line) // 4 + 1 + held // 4 >= {room} AS stop FROM fold f JOIN lines l ON l.id = f.id AND l.n = f.n + 1) l),
paras AS (SELECT id, para, {_strip("string_agg(line, chr(10) ORDER BY n)")} AS p FROM lines JOIN fold USING (id, n) GROUP BY ALL),
tail AS (SELECT id, max(para) AS last, arg_max(p, para) AS b, arg_max(p, para) FILTER (para < m) AS a FROM (SELECT *, max(para) OVER (PARTITION BY id) AS m FROM paras) GROUP BY id),
words AS (SELECT id, last, list_filter(string_split(a, ' '), lambda w: w <> '') || list_filter(string_split(b, ' '), lambda w: w <> '') AS w FROM tail WHERE last > 1 AND length(b) // 4 < {room // 4}),
joined AS (SELECT id, last, array_to_string(w, ' ') AS p FROM words WHERE len(w) <= {room}),
whole AS (SELECT p.id, p.para, CASE WHEN p.para = j.last - 1 THEN j.p ELSE p.p END AS p FROM paras p LEFT JOIN joined j ON j.id = p.id WHERE j.id IS NULL OR p.para < j.last),
head(id, para, kind, done, piece, cutat) AS (
  SELECT id, para, 1, length(p) // 4 <= {over}, p, {cut("p", "1")} FROM whole WHERE para > 1
  UNION ALL SELECT id, para, kind, length(piece) // 4 <= {over}, piece, {cut("piece", "kind")} FROM (
    SELECT id, para, CASE WHEN cutat > 0 THEN kind ELSE kind + 1 END AS kind, CASE WHEN cutat > 0 THEN left(piece, cutat) ELSE piece END AS piece FROM head WHERE NOT done)),
chunks AS (SELECT w.id, w.para, '{header}' || w.p || coalesce(' ' || h.piece, '') AS chunk FROM whole w LEFT JOIN head h ON h.id = w.id AND h.para = w.para + 1 AND h.done)"""


@query(f"WITH RECURSIVE {_chunked()} SELECT id AS doc_id, (para - 1)::INT AS ord, chunk FROM chunks")
def chunk_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("ord", "chunk"))


HEADER = "From a file: "


@query(f"WITH RECURSIVE {_chunked(chunking.MARKDOWN, HEADER)} SELECT id AS doc_id, (para - 1)::INT AS ord, chunk FROM chunks")
def chunk_markdown(spark, sf_dir):
    """Markdown's separators, and a header before each chunk."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunks(F.col("text"), header=HEADER, separators=chunking.MARKDOWN)).alias("ord", "chunk"))


@query("""SELECT doc_id, length(t) // 4 AS tokens, 2 * length(text) // 4 AS wide FROM (SELECT doc_id, text, text || 'é' AS t FROM documents)""")
def chunk_sizes(spark, sf_dir):
    """Tokens are four UTF-16 units each: a character beyond 16 bits is two of them."""
    @F.udf("bigint", useArrow=True)
    def size(t):
        return None if t is None else chunking.count(t)

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", size(F.concat("text", F.lit("é"))).alias("tokens"), size(F.repeat(F.lit("😀"), F.length("text"))).alias("wide"))
