"""Operator 6: a quality classifier by co-training of two views.

One classifier sees a text's content: frequencies of hashed byte pairs and rates of repetition, case and symbols.
The other sees only metadata: source, language, declared length. In each round both score every document without a
label, and each hands documents that it is sure of, by calibrated probability, to the other as pseudo-labels. At last a
logistic model of both calibrated scores, fitted on labelled documents that neither was trained on, scores every document.

Labelled rows are a sample of bounded size: about LABELLED labelled documents, and in each round for each view and
class a share of HAND_OVER of all documents that the other view is sure of, those whose hashes are least. Scoring
reads all documents whole, in one pass: the content score is a mean of weights over a text's byte pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LABELLED, ROUNDS, SURE, HAND_OVER = 4000, 3, 0.97, 400
#: Ridge penalty of both views' models.
DECAY = 1e-3
#: A document is kept if it is of good quality with at least this probability.
LEAST = 0.5
PAIRS, RATES, SOURCES, LANGS, SIZES = 1024, 14, 256, 64, 24

_UPPER, _DIGIT, _MARK, _WIDE = (np.zeros(256, np.float32) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = _WIDE[128:] = 1
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?!"]] = 1
_LOUD = np.zeros(256, np.float32)
_LOUD[[33, 63]] = 1
_FEED = np.zeros(256, np.float32)
_FEED[10] = 1


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[at])


def content(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every byte pair, the text of each, how many pairs each text has, and each text's rates."""
    buf, offsets = common.pack(texts)
    n = len(texts)
    size = np.diff(offsets) - 1  # bytes
    pair = ((buf[:-1].astype(np.uint32) << np.uint32(8) | buf[1:]) * np.uint32(0x9E3779B1) >> np.uint32(22)).astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), size + 1)[: len(pair)]  # a text's last pair is its last byte and the end
    start, end = common.words(buf)
    h = common.word_hashes(buf, start, end)
    word_at = np.searchsorted(start, offsets)
    of = np.repeat(np.arange(n), np.diff(word_at))
    words = np.maximum(np.diff(word_at), 1)
    rates = [_sums(x[buf], offsets) / np.maximum(size, 1) for x in (_UPPER, _DIGIT, _MARK, _WIDE, _LOUD, _FEED)]
    for lag in (1, 2, 3):
        same = np.zeros(len(h))
        same[lag:] = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
        rates.append(_sums(same, word_at) / words)
    # Words that follow the same word as they did before: it tells repetition at any distance.
    follow = np.zeros(len(h))
    if len(h) > 1:
        both = common.mix(h[1:] + common.mix(h[:-1])) ^ of[1:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(both, kind="stable")
        again = both[order[1:]] == both[order[:-1]]
        follow[order[1:][again] + 1] = 1
    rates.append(_sums(follow, word_at) / words)
    rates.append(_sums(end - start, word_at) / words / 10)
    rates.append(np.log1p(np.diff(word_at)) / 10)
    rates.append(np.diff(word_at) / np.maximum(size, 1) * 5)
    rates.append((np.diff(word_at) == 0).astype(float))
    return pair, doc, size, np.stack(rates, 1).astype(np.float32)


def content_rows(texts: list[str | None]) -> np.ndarray:
    pair, doc, size, rates = content(texts)
    count = np.bincount(doc.astype(np.int64) * PAIRS + pair, minlength=len(texts) * PAIRS).reshape(len(texts), PAIRS)
    return np.concatenate([count / np.maximum(size, 1)[:, None], rates], 1).astype(np.float32)


def content_scores(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    """content_rows(texts) @ w, without the rows."""
    pair, doc, size, rates = content(texts)
    return np.bincount(doc, w[:PAIRS][pair], len(texts)) / np.maximum(size, 1) + rates @ w[PAIRS:]


def metadata_rows(source: list, lang: list, n_chars: list) -> np.ndarray:
    def column(values, width):
        out = np.zeros((len(values), width + 1), np.float32)
        for i, v in enumerate(values):
            out[i, width if v is None else xxhash.xxh64_intdigest(str(v).encode("utf-8", "replace")) % width] = 1
        return out

    sizes = np.zeros((len(n_chars), SIZES + 1), np.float32)
    for i, v in enumerate(n_chars):
        sizes[i, SIZES if v is None or v < 0 else min(int(v).bit_length(), SIZES - 1)] = 1
    return np.concatenate([column(source, SOURCES), column(lang, LANGS), sizes], 1)


def logistic(x: np.ndarray, y: np.ndarray, decay: float = DECAY, steps: int = 30) -> np.ndarray:
    """Weights and intercept (last) of a logistic model with standardised columns, fitted by Newton's method with halved
    steps where a whole one doesn't help."""
    mean, sd = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    use = sd > 1e-9
    scale = np.where(use, 1 / np.where(use, sd, 1), 0)
    z = np.concatenate([(x - mean) * scale, np.ones((len(x), 1))], 1)
    ridge = np.append(np.full(x.shape[1], decay * len(y)), 1e-6 * len(y))

    def loss(w):
        v = z @ w
        return float(np.logaddexp(0, v).sum() - v @ y + (ridge * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(z @ w)
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + np.diag(ridge), grad)
        for half in range(12):
            new = loss(w - step / 2**half)
            if new < now:
                w, gain, now = w - step / 2**half, now - new, new
                break
        else:
            break
        if gain < 1e-7 * len(y):
            break
    out = w[:-1] * scale
    return np.append(out, w[-1] - mean @ out)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Views:
    """Both views' training rows, weights and calibrations. One in four labelled rows calibrates and trains neither view."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        hold = np.arange(len(y)) % 4 == 3
        self.rows = [[text[~hold], y[~hold]], [meta[~hold], y[~hold]]]
        self.held, self.truth = (text[hold], meta[hold]), y[hold]
        self.w, self.cal = [np.zeros(0)] * 2, [np.zeros(0)] * 2
        self.refit()

    def refit(self) -> None:
        for k in range(2):
            self.w[k] = logistic(*self.rows[k])
            self.cal[k] = logistic((self.held[k] @ self.w[k][:-1] + self.w[k][-1])[:, None], self.truth, 1e-2)
        common.tidy()

    def quotas(self, most: int = HAND_OVER) -> dict[int, int]:
        """Documents that a view takes in a round, by label: in proportion to the classes."""
        base = float(self.truth.mean())
        return {1: max(1, int(most * base)), 0: max(1, int(most * (1 - base)))}

    def take(self, to: int, label: int, rows: np.ndarray) -> None:
        if len(rows):
            self.rows[to] = [np.concatenate([self.rows[to][0], rows]), np.concatenate([self.rows[to][1], np.full(len(rows), label)])]

    def arrays(self) -> dict[str, np.ndarray]:
        z = [self.cal[k][0] * (self.held[k] @ self.w[k][:-1] + self.w[k][-1]) + self.cal[k][1] for k in range(2)]
        return {"text": self.w[0], "meta": self.w[1], "text_cal": self.cal[0], "meta_cal": self.cal[1], "both": logistic(np.stack(z, 1), self.truth, 1e-2)}


def sure_of(rows: DataFrame, m, quotas: dict[int, int], taken: list[set[int]], sure: float = SURE) -> DataFrame:
    """(to, label, h): of all rows(text, source, lang, n_chars, h) that view 1 - `to` gives the label with probability
    `sure` at least and that view `to` hasn't taken yet, those of the least hashes, as many as quotas tells. Equal rows
    have the same h and count once. A task passes on so many at most; hashes alone are moved, and merged in two steps."""

    @common.tidied
    def run(batches):
        best: dict[tuple[int, int], np.ndarray] = {(to, label): np.zeros(0, np.int64) for to in range(2) for label in range(2)}
        gone = [np.array(sorted(t), np.int64) for t in taken]
        for batch in batches:
            h = batch.column(4).to_numpy()
            t = [batch.column(i).to_pylist() for i in range(4)]
            for a, b in common.chunks(t[0]):
                p = score(*(x[a:b] for x in t), m)[:2]
                for (to, label), held in best.items():
                    own = h[a:b][(p[1 - to] if label else 1 - p[1 - to]) >= sure]
                    best[to, label] = np.unique(np.concatenate([held, own[~np.isin(own, gone[to])]]))[: quotas[label]]
        for (to, label), held in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([to] * len(held), pa.int32()), pa.array([label] * len(held), pa.int32()), pa.array(held)], names=["to", "label", "h"])

    found = rows.select("text", "source", "lang", "n_chars", "h").mapInArrow(run, "to int, label int, h bigint").distinct()
    most = F.when(F.col("label") == 1, quotas[1]).otherwise(quotas[0])
    for part in (["to", "label", F.pmod(F.xxhash64("h"), F.lit(64))], ["to", "label"]):
        first = F.row_number().over(Window.partitionBy(*part).orderBy("h"))
        found = found.withColumn("place", first).filter((F.col("place") <= max(quotas.values())) & (F.col("place") <= most)).drop("place")
    return found


@common.tidied
def features(batches):
    """Batches of (text, source, lang, n_chars, …) -> (x, m, …): what each view sees."""
    for batch in batches:
        if batch.num_rows:
            t = [batch.column(i).to_pylist() for i in range(4)]
            x = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (content_rows(t[0]), metadata_rows(*t[1:]))]
            yield pa.RecordBatch.from_arrays([*x, *batch.columns[4:]], names=["x", "m", *batch.schema.names[4:]])


def fit(docs: DataFrame, labels: DataFrame, cols: dict[str, str], label_col: str, labelled: int = LABELLED, rounds: int = ROUNDS, hand_over: int = HAND_OVER) -> dict[str, np.ndarray]:
    """A document labelled more than once takes the majority, and good at a tie; null labels are none."""
    votes = common.pick(labels, vote_id=cols["id"], y=label_col).filter("vote_id IS NOT NULL AND y IS NOT NULL").groupBy("vote_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    some = votes.filter(common.share(F.col("vote_id"), labelled, votes.count()))
    own = common.pick(docs, **cols)
    own = own.withColumn("h", F.xxhash64(*own.columns))
    # `some` has about `labelled` rows, whatever the input: its size is bounded.
    known = own.join(F.broadcast(some), F.col("id") == F.col("vote_id"))
    rest = own.join(F.broadcast(some.select("vote_id")), F.col("id") == F.col("vote_id"), "left_anti")

    own_columns = ["text", "source", "lang", "n_chars"]
    rows = known.select(*own_columns, "y", "h").mapInArrow(features, "x binary, m binary, y int, h bigint").collect()
    rows.sort(key=lambda r: (r.h, r.x))
    y = np.array([r.y for r in rows], float)
    hold = np.arange(len(y)) % 4 == 3
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:  # nothing to tell apart
        return {}
    x, m = (_matrix([r[k] for r in rows]) for k in "xm")
    views = Views(x, m, y)
    taken: list[set[int]] = [set(), set()]
    for _ in range(rounds):
        sent = common.Model(docs.sparkSession, "views", views.arrays())
        found = sure_of(rest, sent, views.quotas(hand_over), taken).collect()  # at most four quotas
        if not found:
            break
        wanted = F.broadcast(docs.sparkSession.createDataFrame([(r.h,) for r in found], "wanted bigint").distinct())
        seen = rest.join(wanted, F.col("h") == F.col("wanted")).select(*own_columns, "h").mapInArrow(features, "x binary, m binary, h bigint")
        by = {r.h: r for r in seen.dropDuplicates(["h"]).collect()}
        for to in range(2):
            for label in range(2):
                views.take(to, label, _matrix([by[h]["xm"[to]] for h in sorted(r.h for r in found if (r.to, r.label) == (to, label))]))
            taken[to] |= {r.h for r in found if r.to == to}
        views.refit()
    return views.arrays()


def _matrix(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.float32)


def score(texts, source, lang, n_chars, m) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of good quality: by content, by metadata, by both."""
    w, v = np.asarray(m["text"]), np.asarray(m["meta"])
    a = m["text_cal"][0] * (content_scores(texts, w[:-1]) + w[-1]) + m["text_cal"][1]
    b = m["meta_cal"][0] * (metadata_rows(source, lang, n_chars) @ v[:-1] + v[-1]) + m["meta_cal"][1]
    return _sigmoid(a), _sigmoid(b), _sigmoid(m["both"][0] * a + m["both"][1] * b + m["both"][2])


def _columns(id_col, text_col, source_col, lang_col, size_col) -> dict[str, str]:
    return {"id": id_col, "text": text_col, "source": source_col, "lang": lang_col, "n_chars": size_col}


def _scored(batch_columns, model, fitted: bool):
    texts, source, lang, n_chars = batch_columns
    for a, b in common.chunks(texts):
        if fitted:
            yield (a, b, *score(texts[a:b], source[a:b], lang[a:b], n_chars[a:b], model))
        else:
            yield a, b, *(np.full(b - a, np.nan),) * 2, np.ones(b - a)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", label_col: str = "quality", least: float = LEAST) -> DataFrame:
    """(id_col, p_content, p_metadata, p DOUBLE, keep BOOLEAN): one row for each row of docs.

    Null text counts as empty; null metadata is a value of its own. Whole texts are read. Without labels of both kinds
    nothing can be told apart: p is 1, the views' are null, all are kept. Null and repeated ids are passed on with their
    own rows. Other columns are not read, whatever their names; where id_col is called as one of the results is, that one
    gets an underscore. An empty table gives none.
    """
    cols = _columns(id_col, text_col, source_col, lang_col, size_col)
    m = fit(docs, labels, cols, label_col)
    model = common.Model(docs.sparkSession, "quality", m)

    @common.tidied
    def run(batches, model):
        for batch in batches:
            for a, b, content_p, meta_p, p in _scored([batch.column(i).to_pylist() for i in range(1, 5)], model, bool(m)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.round(x, 6), pa.float64(), from_pandas=True) for x in (content_p, meta_p, p)), pa.array(p >= least)], names=["id", "p_content", "p_metadata", "p", "keep"])

    done = common.pick(docs, **cols).mapInArrow(partial(run, model=model), f"id {common.kind(docs, id_col)}, p_content double, p_metadata double, p double, keep boolean")
    return common.named(done, id_col, "p_content", "p_metadata", "p", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", label_col: str = "quality", least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that score_quality() keeps. Null and empty texts are judged as it does, by what their
    metadata say too; rows that occur twice stay or go alike; columns may have any names; an empty table stays empty."""
    cols = _columns(id_col, text_col, source_col, lang_col, size_col)
    m = fit(docs, labels, cols, label_col)
    model = common.Model(docs.sparkSession, "quality", m)
    wanted = [common.place(docs, c) for c in list(cols.values())[1:]]

    @common.tidied
    def run(batches, model):
        for batch in batches:
            keep = [p >= least for *_, p in _scored([batch.column(i).to_pylist() for i in wanted], model, bool(m))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return common.sift(docs, partial(run, model=model))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
