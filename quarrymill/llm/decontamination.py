"""Operator 3: benchmark decontamination by BM25 over an inverted index of the test items.

Every passage of every training text is a query; the index holds the test items, which are few and short. A
passage is BACK words long or more (twice the longest item) and passages overlap by half, so that a copied item
lies whole in one. Scores are BM25 as a share of what the item scores against itself. Retrieved is every item of
a share of at least LEAST_SCORE: block-max WAND skips blocks of postings whose maxima can't reach it. What no
pivot can exist for is found for whole chunks first: frequent terms together give an item so much at most, so the
rare terms of a passage must give that same item the rest, and their short postings are summed by passage and item for
all passages at once. Both bounds are exact, so nothing is lost.

A retrieved item counts as leaked if enough of its question's and of its answer's word n-grams are in the passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K1, B, LEAST_SCORE, LEAST_OVERLAP, NGRAM, BACK, BLOCK = 1.2, 0.75, 0.45, 0.5, 3, 64, 8
#: The answer of an item is its last sentence; what stands before it is the question.
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def text_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-case word, and where each text's begin (and the end)."""
    buf, offsets = common.pack([t and t.lower() for t in texts])
    start, end = common.words(buf)
    return common.word_hashes(buf, start, end), np.searchsorted(start, offsets)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer); of a single sentence, its words' last third is the answer."""
    parts = [p for p in SENTENCE.split(text) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = max(1, len(w) - max(1, len(w) // 3)) if len(w) > 1 else 0
    return " ".join(w[:cut]), " ".join(w[cut:])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n or n < 1:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        total = common.mix(total) + h[j : len(h) - n + 1 + j]
    return np.unique(total)


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's n-grams (of NGRAM words, or all that it has) that the passage has; 1 for a part without words."""
    if not len(part):
        return 1.0
    n = min(NGRAM, len(part))
    own = ngrams(part, n)
    return float(np.isin(own, ngrams(passage, n)).mean())


def build_index(items: list[tuple[int | str, str]], least: float = LEAST_SCORE) -> dict[str, np.ndarray]:
    """Postings sorted by term and item with normalised impacts, block maxima, term maxima; words of the items' parts."""
    items = sorted((i, t) for i, t in items if t and i is not None)
    words, at = text_words([t for _, t in items])
    some = np.flatnonzero(np.diff(at) > 0)
    items = [items[i] for i in some]
    if not items:
        return {"ids": np.zeros(0, np.int64)}
    words, at = text_words([t for _, t in items])
    n, length = len(items), np.diff(at)
    vocab, term = np.unique(words, return_inverse=True)
    pair, tf = np.unique(term * n + np.repeat(np.arange(n), length), return_counts=True)
    t, d = pair // n, pair % n
    df = np.bincount(t, minlength=len(vocab))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / length.mean()))
    impact /= np.bincount(d, impact, n)[d]
    begin = np.concatenate([[0], np.cumsum(df)])
    top = np.maximum.reduceat(impact, begin[:-1])
    # The frequent terms that together give no item more than half of what is wanted.
    rare = np.ones(len(vocab), bool)
    order = np.argsort(-df, kind="stable")
    given = np.zeros(n)
    for x in order.tolist():
        s = slice(begin[x], begin[x + 1])
        more = given.copy()
        more[d[s]] += impact[s]
        if more.max() > least / 2:
            break
        given, rare[x] = more, False
    blocks = [(b, min(b + BLOCK, begin[x + 1])) for x in range(len(vocab)) for b in range(begin[x], begin[x + 1], BLOCK)]
    qa = [split_item(text) for _, text in items]
    q, q_at = text_words([x for x, _ in qa])
    a, a_at = text_words([x for _, x in qa])
    small = np.zeros(1 << 16, bool)
    small[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    return {"ids": np.array([i for i, _ in items]), "vocab": vocab, "small": small, "begin": begin, "item": d.astype(np.int64), "impact": impact, "top": top,
            "rare": rare, "given": given, "block_at": np.concatenate([[0], np.cumsum(-(-df // BLOCK))]), "block_max": np.array([impact[x:y].max() for x, y in blocks]),
            "q": q, "q_at": q_at, "a": a, "a_at": a_at, "half": np.array([max(BACK, int(length.max()))])}


def block_max_wand(terms: np.ndarray, m, least: float) -> list[tuple[int, float]]:
    """Every (item, score) of at least `least` for the distinct terms, in order of the items."""
    # Views of the mapped arrays, whose single numbers cost less to read than numpy's.
    begin, item, impact, top, block_at, block_max = (memoryview(np.asarray(m[k])) for k in ("begin", "item", "impact", "top", "block_at", "block_max"))
    eps = 1e-9
    lists = []
    for t in terms.tolist():
        lo, hi = begin[t], begin[t + 1]
        lists.append([item[lo], lo, hi, top[t], block_at[t], lo])
    found = []

    def seek(x: list, to: int) -> None:
        p = x[1] = bisect_left(item, to, x[1], x[2])
        x[0] = item[p] if p < x[2] else -1

    while lists:
        lists.sort()
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[3]
            if bound >= least - eps:
                pivot = k
                break
        if pivot < 0:
            break
        doc = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
            pivot += 1
        bound, far = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
        for x in lists[: pivot + 1]:
            p = bisect_left(item, doc, x[1], x[2])  # shallow: only which block
            if p < x[2]:
                block = (p - x[5]) // BLOCK
                bound += block_max[x[4] + block]
                far = min(far, item[min(x[5] + (block + 1) * BLOCK, x[2]) - 1] + 1)
        if bound < least - eps:
            to = max(doc + 1, far)
            for x in lists[: pivot + 1]:
                seek(x, to)
        elif lists[0][0] == doc:
            score = sum(impact[x[1]] for x in lists[: pivot + 1])
            if score >= least - eps:
                found.append((doc, score))
            for x in lists[: pivot + 1]:
                seek(x, doc + 1)
        else:
            for x in lists[: pivot + 1]:
                if x[0] < doc:
                    seek(x, doc)
        lists = [x for x in lists if x[0] >= 0]
    return found


def reachable(term: np.ndarray, start: np.ndarray, doc: np.ndarray, k: np.ndarray, m, least: float) -> np.ndarray:
    """Passages that some item may reach the threshold in. A passage is named by its first piece."""
    begin, items, impact, given = (np.asarray(m[x]) for x in ("begin", "item", "impact", "given"))
    use = np.flatnonzero(term >= 0)
    use = use[np.asarray(m["rare"])[term[use]]]
    if not len(use):
        return np.zeros(0, np.int64)
    piece, t = np.searchsorted(start, use, "right") - 1, term[use]
    paired = np.zeros(len(doc), bool)  # with the piece behind it
    paired[:-1] = doc[1:] == doc[:-1]
    own, back = paired[piece] | (k[piece] == 0), k[piece] > 0
    passage, t = np.divmod(np.unique(np.concatenate([piece[own], piece[back] - 1]) * (len(begin) - 1) + np.concatenate([t[own], t[back]])), len(begin) - 1)
    size = begin[t + 1] - begin[t]
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(begin[t] - ends + size, size)
    key, value = np.repeat(passage, size) * len(given) + items[at], impact[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    passage, item = np.divmod(key[first], len(given))
    return np.unique(passage[np.add.reduceat(value[order], first) + given[item] >= least - 1e-9])


#: Bytes of passages that a worker remembers. Only speed depends on it.
MEMO = 24 << 20


def _passage(h: np.ndarray, term: np.ndarray, m, least: float, least_overlap: float) -> list[tuple[int, tuple[float, float, float]]]:
    """The leaked items of one passage. Copies of texts have the same passages, so that results are remembered."""
    memo = common.memo(getattr(m, "key", str(id(m))), f"passages {least} {least_overlap}", MEMO)

    def make(_: list) -> list:
        out = []
        terms = np.unique(term)
        for item, score in block_max_wand(terms[terms >= 0], m, least):
            q = overlap(np.asarray(m["q"][m["q_at"][item] : m["q_at"][item + 1]]), h)
            a = overlap(np.asarray(m["a"][m["a_at"][item] : m["a_at"][item + 1]]), h)
            if q >= least_overlap and a >= least_overlap:
                out.append((item, (score, q, a)))
        return [out]

    key = h.tobytes()
    late = memo.learn({key}, make, lambda v: 60 + 200 * len(v))
    found = memo[key]
    memo.forget(late)
    return found


def find_leaks(texts: list[str | None], m, least: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP) -> list[tuple[int, int | str, float, float, float]]:
    """(text, item, score, question's overlap, answer's overlap) of each text's leaked items; the best passage counts."""
    if not len(m["ids"]):
        return []
    h, at = text_words(texts)
    if not len(h):
        return []
    vocab, half = np.asarray(m["vocab"]), int(m["half"][0])
    term = np.full(len(h), -1, np.int64)
    maybe = np.flatnonzero(np.asarray(m["small"])[(h & np.uint64(0xFFFF)).astype(np.int64)])
    where = np.minimum(np.searchsorted(vocab, h[maybe]), len(vocab) - 1)
    hit = vocab[where] == h[maybe]
    term[maybe[hit]] = where[hit]
    n = np.diff(at)
    pieces = -(-n // half)  # a passage is two pieces in a row, or a short text's only one
    doc = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[doc] + k * half
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in reachable(term, start, doc, k, m, least).tolist():
        lo, hi = int(start[p]), int(min(start[p] + 2 * half, at[doc[p] + 1]))
        for item, x in _passage(h[lo:hi], term[lo:hi], m, least, least_overlap):
            key = (int(doc[p]), item)
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), x)
    ids = m["ids"]
    return [(d, ids[i].item(), *x) for (d, i), x in sorted(best.items())]


def item_kind(benchmark: DataFrame, item_col: str) -> str:
    """Items are named by whole numbers or else by strings."""
    return "bigint" if common.kind(benchmark, item_col) in ("tinyint", "smallint", "int", "bigint") else "string"


def index(benchmark: DataFrame, item_col: str, text_col: str, least: float) -> common.Model:
    """The index grows with the test items alone, never with the corpus."""
    own = common.pick(benchmark, item=item_col, text=text_col).select(F.col("item").cast(item_kind(benchmark, item_col)), "text")
    items = [tuple(r) for r in own.dropna().distinct().collect()]
    return common.Model(benchmark.sparkSession, "benchmark", build_index(items, least))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(id_col, item_col, score DOUBLE, question DOUBLE, answer DOUBLE): a row for each test item that a row of docs leaks.
    Items are BIGINT, or STRING where item_col is no whole number.

    Whole texts of any length are searched, in one pass without a shuffle. Null and empty texts and items leak nothing.
    Items with the same text are all reported; an item id with two texts is reported for each. Rows that occur twice
    are reported twice, null ids with their own rows. Other columns are not read, whatever their names; where id_col is
    called as another of the results is, that one gets an underscore. An empty table on either side gives none.
    """
    model = index(benchmark, item_col, item_text, least)
    item = item_kind(benchmark, item_col)

    @common.tidied
    def run(batches, model):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.chunks(texts):
                if found := find_leaks(texts[a:b], model, least):
                    row, leaked, score, q, ans = zip(*found)
                    take = batch.column(0).take(pa.array([r + a for r in row]))
                    yield pa.RecordBatch.from_arrays([take, pa.array(leaked, pa.int64() if item == "bigint" else pa.string()), *(pa.array([round(v, 6) for v in x], pa.float64()) for x in (score, q, ans))], names=["id", "item", "score", "question", "answer"])

    done = common.pick(docs, id=id_col, text=text_col).mapInArrow(partial(run, model=model), f"id {common.kind(docs, id_col)}, item {item}, score double, question double, answer double")
    return common.named(done, id_col, item_col, "score", "question", "answer")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, that leak no test item. Null and empty texts stay; rows that occur twice stay or go
    alike; columns may have any names; an empty table stays empty, and with no test items all rows stay."""
    model, at = index(benchmark, item_col, item_text, least), common.place(docs, text_col)

    @common.tidied
    def run(batches, model):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.ones(len(texts), bool)
            for a, b in common.chunks(texts):
                keep[[r + a for r, *_ in find_leaks(texts[a:b], model, least)]] = False
            yield batch.filter(pa.array(keep))

    return common.sift(docs, partial(run, model=model))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
