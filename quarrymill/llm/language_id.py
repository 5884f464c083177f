"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text. A document is
parsed into phrases, each the longest match from where the last ended (a character that the text lacks is a phrase
of its own). Phrases times log2 of the labelled text's length, by the document's length, estimates the bits a
symbol costs in that language; the language with the fewest wins. Automata are dense tables that workers
memory-map; many stretches of documents are parsed in lockstep. Each stretch is parsed as if it began a phrase, and then
again from the state that the one before it ended in, until both parses begin a phrase at the same place, from where they
are the same: so the phrases are those of whole documents.

A document is rejected if no mixture of the languages explains it: its bits with the best language for each stretch, which
a document of two known languages passes, are beyond REJECT times what held-out text takes, and SLACK phrases more, which
only matters to short ones.

Symbols are the bytes of lower-case letters and of all other scripts; whatever else lies between is one separator.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents sampled per language, and symbols of them that make its automaton, at most PIECE of one document,
#: from a place chosen by its hash; the rest calibrates.
SAMPLE, TRAIN_SYMBOLS, PIECE = 96, 32_768, 1024
#: Symbols parsed in a row in lockstep. The phrases don't depend on it.
STRETCH = 256
#: A document is rejected beyond so many times the bits that held-out text takes in the median, and so many phrases more.
REJECT, SLACK = 1.6, 8


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters' bytes, 0 for a separator; and where each text begins (and the end)."""
    buf, offsets = common.pack([t and t.lower() for t in texts])
    letter = common.WORDY[buf] & ~((buf >= 48) & (buf <= 57))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep &= np.append(buf[:-1] != 0, True) | letter if len(buf) else keep
    out = np.where(letter, buf, 0).astype(np.uint8)
    keep &= buf != 0
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return out[keep], at


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; 0 is the start, and every path from it spells a substring."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        now = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return go


def dense(automata: list[list[dict[int, int]]]) -> dict[str, np.ndarray]:
    """One table for all: entries are rows' beginnings, -1 where a phrase ends. The last row of each automaton is the
    state behind a character that it lacks."""
    seen = sorted({c for a in automata for row in a for c in row})
    width = len(seen) + 1
    of = np.full(256, width - 1, np.uint8)
    of[seen] = np.arange(len(seen))
    tables, roots, base = [], [], 0
    for a in automata:
        t = np.full((len(a) + 1, width), -1, np.int32)
        for s, row in enumerate(a):
            for c, to in row.items():
                t[s, of[c]] = (base + to) * width
        roots.append(np.where(t[0] < 0, (base + len(a)) * width, t[0]))
        tables.append(t)
        base += len(a) + 1
    return {"table": np.concatenate(tables).ravel(), "roots": np.array(roots, np.int32), "of": of}


def parse(sym: np.ndarray, at: np.ndarray, m, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(stretches, languages): the phrases of whole documents that begin in each stretch; and each stretch's document."""
    table, roots = (np.asarray(m[k]) for k in ("table", "roots"))
    n = np.diff(at)
    lanes = -(-n // stretch)
    doc = np.repeat(np.arange(len(n)), lanes)
    out = np.zeros((len(doc), len(roots)), np.int64)
    if not len(doc):
        return out, doc
    k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = at[doc] + k * stretch
    size = np.minimum(at[doc + 1] - begin, stretch)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.where(k > 0, place[np.arange(len(doc)) - 1], -1)[order]  # the lane of the stretch before
    after = np.full(len(order), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    begin, size = begin[order], size[order]
    c = np.asarray(m["of"])[sym]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # lanes longer than each step
    steps = [c[begin[:a] + i] for i, a in enumerate(active)]
    new = np.zeros((len(steps), len(order)), bool)  # where a phrase begins
    for lang in range(len(roots)):
        root = roots[lang]
        state = root[steps[0]]  # the first symbol begins a phrase, known or not
        new[:] = False
        new[0] = True
        for i, (a, now) in enumerate(zip(active[1:].tolist(), steps[1:]), 1):
            to = table.take(state[:a] + now)
            miss = np.less(to, 0, out=new[i, :a])
            np.copyto(to, root[now], where=miss)
            state[:a] = to
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            lane, at_, other, i = todo, state[before[todo]], [], 0
            while len(lane):
                over = size[lane] <= i
                if over.any():  # the parses didn't meet: what follows has to begin otherwise
                    state[lane[over]] = at_[over]
                    other.append(lane[over])
                    lane, at_ = lane[~over], at_[~over]
                    if not len(lane):
                        break
                now = c[begin[lane] + i]
                to = table.take(at_ + now)
                miss = to < 0
                stay = ~(miss & new[i, lane])
                new[i, lane] = miss
                lane, at_ = lane[stay], np.where(miss, root[now], to)[stay]
                i += 1
            todo = after[np.concatenate(other)] if other else np.zeros(0, np.int64)
            todo = np.sort(todo[todo >= 0])
        out[order, lang] = new.sum(0)
    return out, doc


def phrases(sym: np.ndarray, at: np.ndarray, m, stretch: int = STRETCH) -> np.ndarray:
    """(texts, languages): phrases of each text's parse; 0 for a text without symbols."""
    each, doc = parse(sym, at, m, stretch)
    return np.stack([np.bincount(doc, each[:, j], len(at) - 1) for j in range(each.shape[1])], 1).astype(np.int64)


def bits(texts: list[str | None], m) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, languages) bits per symbol; bits of all symbols by the best language for each stretch; the number of symbols,
    and of those other than separators."""
    sym, at = symbols(texts)
    n = np.diff(at)
    letters = np.concatenate([[0], np.cumsum(sym != 0)])[at]
    each, doc = parse(sym, at, m)
    each = each * np.asarray(m["scale"])
    whole = np.stack([np.bincount(doc, each[:, j], len(n)) for j in range(each.shape[1])], 1)
    return whole / np.maximum(n, 1)[:, None], np.bincount(doc, each.min(1, initial=np.inf), len(n)), n, np.diff(letters)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, train: int = TRAIN_SYMBOLS):
    """(languages, arrays), from about `sample` labelled documents of each language, chosen by hash; the size of the
    automata is bounded by `train`. Languages come in alphabetical order, which decides ties."""
    labelled = common.pick(docs, id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    total = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not total:
        return [], {}
    pick = reduce(lambda a, b: a | b, [(F.col("lang") == k) & common.share(F.struct("id", "text"), sample, n) for k, n in total.items()])
    by: dict[str, list[str]] = {}
    for lang, text in sorted(map(tuple, labelled.filter(pick).select("lang", "text").collect())):
        by.setdefault(lang, []).append(text)
    names, automata, scale, rest = [], [], [], []
    for lang in sorted(by):
        texts = np.random.default_rng(7).permutation(np.array(sorted(set(by[lang])), object)).tolist()
        sym, at = symbols(texts)
        size = np.minimum(np.diff(at), PIECE)  # a long document must not make the automaton alone
        cut = min(int(np.searchsorted(np.cumsum(size), train)) + 1, max(1, len(texts) * 2 // 3))
        skip = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) % (b - a - k + 1) for t, a, b, k in zip(texts, at.tolist(), at[1:].tolist(), size.tolist())]
        own = np.concatenate([sym[a + s : a + s + k] for a, s, k in zip(at[:cut].tolist(), skip, size[:cut].tolist())])[:train]
        if not (own != 0).any():
            continue
        names.append(lang)
        automata.append(suffix_automaton(own.tolist()))
        scale.append(np.log2(len(own) + 1))
        rest.append(texts[cut:])
    if not names:
        return [], {}
    m = dense(automata) | {"scale": np.array(scale)}
    limit = []
    for texts in rest:
        _, low, n, letters = bits(texts, m) if texts else (None, np.zeros(0), np.zeros(0), np.zeros(0))
        low, n = low[letters > 0], n[letters > 0]
        limit.append(float(np.median(low / n)) * REJECT if len(low) else np.inf)
    return names, m | {"limit": np.array(limit)}


def judge(texts: list[str | None], names: list[str], m) -> tuple[list, list, list, list]:
    """Language, its bits per symbol, how many more the next one takes, and whether the text is in a known language."""
    if not names:
        return [None] * len(texts), [None] * len(texts), [None] * len(texts), [False] * len(texts)
    cost, mixed, n, letters = bits(texts, m)
    best = cost.argmin(1)
    row = np.arange(len(texts))
    low = cost[row, best]
    near = np.partition(cost, 1, 1)[:, 1] - low if len(names) > 1 else np.full(len(texts), np.inf)
    keep = (letters > 0) & (mixed <= np.asarray(m["limit"])[best] * n + SLACK * np.asarray(m["scale"])[best])
    some = (letters > 0).tolist()
    return ([names[b] if s else None for b, s in zip(best, some)], [round(float(x), 6) if s else None for x, s in zip(low, some)],
            [round(float(x), 6) if s and np.isfinite(x) else None for x, s in zip(near, some)], keep.tolist())


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, language STRING, bits DOUBLE, margin DOUBLE, keep BOOLEAN): one row for each row of docs.

    lang_col labels the sample that the automata are made of; nulls in it are no labels. A null text and one without
    a letter have null language, bits and margin and aren't kept, and so it is for all if there is no labelled text.
    Other texts are kept if their bits with the best language for each stretch are at most REJECT times those of held-out
    text and SLACK phrases: of short texts, too, those in a script or a mix of letters that no language has are rejected.
    Whole texts are parsed. Of languages that cost the same the first in the alphabet is taken. Null and repeated ids
    are passed on with their own rows. Other columns are not read, whatever their names; where id_col is called as one of
    the results is, that one gets an underscore. An empty table gives none.
    """
    names, m = fit(docs, id_col, text_col, lang_col)
    model = common.Model(docs.sparkSession, "languages", m)

    @common.tidied
    def run(batches, model):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.chunks(texts, 2 * common.CHUNK):
                lang, cost, margin, keep = judge(texts[a:b], names, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(cost, pa.float64()), pa.array(margin, pa.float64()), pa.array(keep, pa.bool_())], names=["id", "language", "bits", "margin", "keep"])

    done = common.pick(docs, id=id_col, text=text_col).mapInArrow(partial(run, model=model), f"id {common.kind(docs, id_col)}, language string, bits double, margin double, keep boolean")
    return common.named(done, id_col, "language", "bits", "margin", "keep")


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that identify_language() keeps: null and empty texts and those without a letter go;
    of a table without labels all go. Rows that occur twice stay or go alike; columns may have any names; an empty table
    stays empty."""
    names, m = fit(docs, id_col, text_col, lang_col)
    model, at = common.Model(docs.sparkSession, "languages", m), common.place(docs, text_col)

    @common.tidied
    def run(batches, model):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [k for a, b in common.chunks(texts, 2 * common.CHUNK) for k in judge(texts[a:b], names, model)[3]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.sift(docs, partial(run, model=model))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(common.table(spark, sf_dir, "documents"))
