"""Operator 9: URL filter by word segmentation of hosts and multinomial naive Bayes.

A host's names are split into words by unigram Viterbi: words have the frequencies of Zipf's law by their rank in a
public vocabulary, and a stretch that is no word costs more the longer it is. The segmented words of the host and the
words of path and query are tokens. Unwanted examples are the URLs whose segmented host has a word of SEEDS; all others
are the other class. Counts of both classes over all rows, in BUCKETS hashed tokens, make the naive Bayes model, which
then scores all rows: so words that come with seed words, as those of the same farms, tell as well.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCAB = f"{common.TOKENIZERS}/word_bpe_49k.json"
SEEDS = (
    "adult ads bets betting bingo bitcoin casino cheap clickbait dating drugs escort gambling jackpot loans lottery malware naked nude payday "
    "phishing pharmacy pills poker porn prize replica scam sex slots spam spyware tramadol viagra warez webcam xxx"
).split()
BUCKETS, SMOOTH = 1 << 18, 0.5
#: A URL is blocked from this log-odds on.
LEAST = 0.0
NO_WORD, NO_WORD_CHAR = math.log(1e-6), math.log(1e-2)
#: Hosts whose words a worker remembers. Only speed depends on it.
MEMO = 200_000

URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)(?::\d*)?([^#]*)", re.I)
NAME = re.compile(r"[^\W\d_]+|\d+")


def word_costs(path: str = VOCAB) -> dict[str, float]:
    """Log-probability of each whole word of the vocabulary, by Zipf's law of its rank. Single letters other than a and
    i are no words."""
    with open(path) as f:
        found = json.load(f)["model"]["vocab"]
    ranked = sorted((i, w[:-4]) for w, i in found.items() if w.endswith("</w>") and w[:-4].isalpha() and (len(w) > 5 or w[0] in "ai"))
    total = math.log(len(ranked) or 1) + 0.5772
    return {w: -math.log((r + 1) * total) for r, (_, w) in enumerate(ranked)}


def segment(name: str, words: dict[str, float], longest: int | None = None) -> list[str]:
    """The likeliest split of a name into words and stretches that are none; of equal ones that with the fewest parts,
    then the one whose last part is longest."""
    n = len(name)
    longest = max(map(len, words), default=0) if longest is None else longest
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, -parts, where the last part begins
    # A stretch that is no word: its start costs once, each character again. `open_` carries the best start.
    open_ = (0.0, 0, 0)
    for i in range(1, n + 1):
        top = (open_[0] + NO_WORD + NO_WORD_CHAR * i, open_[1] - 1, open_[2])
        for j in range(max(0, i - longest), i):
            p = words.get(name[j:i])
            if p is not None:
                new = (best[j][0] + p, best[j][1] - 1, j)
                if (new[0], new[1], -j) > (top[0], top[1], -top[2]):
                    top = new
        best.append(top)
        here = (top[0] - NO_WORD_CHAR * i, top[1], i)
        if here[:2] > open_[:2]:
            open_ = here
    out, i = [], n
    while i:
        j = best[i][2]
        out.append(name[j:i])
        i = j
    return out[::-1]


def split_url(url: str) -> tuple[str, str]:
    """Host without www., and path with query, lower-case; a text that is no URL is all host up to its first slash."""
    m = URL.match(url)
    host = m[1].lower().strip(".")
    return host[4:] if host.startswith("www.") else host, m[2].lower()


def host_words(host: str, words: dict[str, float]) -> list[str]:
    longest = max(map(len, words), default=0)
    return [w for x in NAME.findall(host) for w in ([x] if x.isdigit() else segment(x, words, longest))]


def tokens(url: str, split) -> tuple[list[str], list[str]]:
    """The host's words, and all tokens: host words, pairs of them, and path words. Numbers are one token by length."""
    host, path = split_url(url)
    words = split(host)
    short = [f"#{len(w)}" if w.isdigit() else w for w in words]
    rest = (f"#{len(w)}" if w.isdigit() else w for w in NAME.findall(path))
    return words, [*("h:" + w for w in short), *(f"h:{a} {b}" for a, b in zip(short, short[1:])), *("p:" + w for w in rest)]


@lru_cache(1 << 18)
def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) % BUCKETS


_splits: dict[str, object] = {}


def splitter(vocab: str):
    if vocab not in _splits:
        words = word_costs(vocab)
        _splits[vocab] = lru_cache(MEMO)(lambda host: host_words(host, words))
    return _splits[vocab]


def count_tokens(urls: DataFrame, url_col: str, seeds: list[str], vocab: str) -> np.ndarray:
    """(2, BUCKETS + 1): counts of tokens by class, and last of URLs, over all rows. The result's size is fixed."""
    marks = frozenset(s.lower() for s in seeds)

    @common.tidied
    def run(batches):
        split, total = splitter(vocab), np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            at: tuple[list[int], list[int]] = ([], [])
            for url in batch.column(0).to_pylist():
                if url is not None:
                    words, t = tokens(url, split)
                    at[not marks.isdisjoint(words)].extend([*map(bucket, t), BUCKETS])
            for c in range(2):
                total[c] += np.bincount(np.array(at[c], np.int64), minlength=BUCKETS + 1)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["b", "good", "bad"])

    out = np.zeros((2, BUCKETS + 1), np.int64)
    for r in common.pick(urls, url=url_col).mapInArrow(run, "b bigint, good bigint, bad bigint").groupBy("b").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        out[:, r.b] = r.good, r.bad
    return out


def bayes(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-odds of each token for the unwanted class, and of the class; with one class only, all are 0 or as many
    as decide for that class."""
    tokens_, urls = counts[:, :-1].astype(float), counts[:, -1].astype(float)
    if not urls.all():
        return np.zeros(tokens_.shape[1]), -1.0 if not urls[1] else 1.0
    kinds = int((tokens_.sum(0) > 0).sum())
    log = np.log(tokens_ + SMOOTH) - np.log(tokens_.sum(1, keepdims=True) + SMOOTH * kinds)
    return log[1] - log[0], float(np.log(urls[1] / urls[0]))


def filter_urls(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", seeds: list[str] | tuple[str, ...] = SEEDS, vocab: str = VOCAB, least: float = LEAST) -> DataFrame:
    """(id_col, host_words STRING, score DOUBLE, blocked BOOLEAN): one row for each row of urls.

    score is the log-odds that the URL is unwanted. A null URL has null words and score and isn't blocked; an empty one
    has no words and the classes' odds. URLs of any length are read whole. If no URL has a seed word none is blocked.
    Null and repeated ids are passed on with their own rows, and repeated rows count as often as they occur. Other
    columns are not read, whatever their names; where id_col is called as one of the results is, that one gets an
    underscore. An empty table gives none.
    """
    weight, prior = bayes(count_tokens(urls, url_col, list(seeds), vocab))
    model = common.Model(urls.sparkSession, "urls", {"weight": weight})

    @common.tidied
    def run(batches, model):
        split, w = splitter(vocab), np.asarray(model["weight"])
        for batch in batches:
            names: list = []
            score: list = []
            for url in batch.column(1).to_pylist():
                if url is None:
                    names.append(None)
                    score.append(None)
                    continue
                words, t = tokens(url, split)
                names.append(" ".join(words))
                score.append(round(prior + float(w[list(map(bucket, t))].sum()), 6))
            blocked = [s is not None and s >= least for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(blocked, pa.bool_())], names=["id", "host_words", "score", "blocked"])

    done = common.pick(urls, id=id_col, url=url_col).mapInArrow(partial(run, model=model), f"id {common.kind(urls, id_col)}, host_words string, score double, blocked boolean")
    return common.named(done, id_col, "host_words", "score", "blocked")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))
