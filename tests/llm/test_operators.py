"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on edge cases."""

import base64
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import bpe, chat, common, decontamination, html_blocks, language_id, near_dedup, neighbours, quality, token_counts, url_filter

DATA = "/root/testdata/sf0.001"
LONG = "word and more words " * 60_000


def docs(spark, rows, schema="doc_id bigint, text string"):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, schema)
    for c in ("rid", "comp", "size", "place", "h", "root", "a", "b", "v", "sig", "key", "word", "n", "turns", "id"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


EDGES = [(1, "a plain text of words"), (2, ""), (3, None), (None, "no id here"), (4, "twice"), (4, "twice"), (5, "   \n\t "), (6, LONG), (7, "🙂 ñandú x \x00 \r\n")]


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


def slow_count(unit, scores, unk):
    chars = list(unit)
    best = [(0.0, 0)] + [None] * len(chars)
    for i in range(1, len(chars) + 1):
        top = None
        for j in range(i):  # longest piece first
            p = "".join(chars[j:i])
            if p in scores and best[j] and (top is None or best[j][0] + scores[p] > top[0]):
                top = (best[j][0] + scores[p], best[j][1] + 1)
        if chars[i - 1] not in scores and (top is None or best[i - 1][0] + unk > top[0]):
            top = (best[i - 1][0] + unk, best[i - 1][1] + len(chars[i - 1].encode()))
        best[i] = top
    return best[-1][1]


def test_token_counts_by_brute_force():
    rng = random.Random(1)
    pieces = [("".join(rng.choices(" abcé", k=rng.randint(1, 4))), -float(rng.randint(1, 9))) for _ in range(60)]
    scores = dict(pieces)
    m = token_counts.automaton(list(scores.items()))
    units = ["".join(rng.choices(" abcé😀", k=rng.randint(1, 14))) for _ in range(400)]
    assert token_counts.count_units(units, m).tolist() == [slow_count(u, scores, m["unk"][0]) for u in units]


def test_token_counts_of_whole_texts():
    vocab = token_counts.vocabulary()
    scores = {p.replace("▁", " "): s for p, s in vocab}
    m = token_counts.automaton(vocab)
    texts = ["Hello there,  world", "a\nb  c ", " ", "naïve 漢字"]
    assert token_counts.count_texts(texts, m, "t") == [slow_count(" " + t, scores, m["unk"][0]) for t in texts]


def test_token_count_edges(spark):
    got = rows(token_counts.token_counts(docs(spark, EDGES)))
    assert len(got) == len(EDGES) and {i: n for i, n in got if i in (2, 3)} == {2: 0, 3: None} and sum(i is None for i, _ in got) == 1
    assert dict(got)[6] > 200_000 and [n for i, n in got if i == 4] == [dict(got)[4]] * 2
    assert rows(token_counts.token_counts(docs(spark, []))) == []


# 2


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 8))).astype(np.float32)
    x[200:230] = x[200]  # copies, more than k
    df = docs(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = pd.DataFrame(rows(neighbours.nearest_neighbours(df, k=5, leaf=64, branch=6, probes=100, cell=300)), columns=["i", "rank", "j", "d"])
    assert len(got) == 7500 and (got["i"] != got["j"]).all()
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = np.round(1 - (u @ u.T).astype(np.float64), 6) + 0.0
    np.fill_diagonal(d, 9)
    hit = 0
    for i, g in got.sort_values("rank").groupby("i"):
        assert np.abs(d[i, g["j"]] - g["d"]).max() < 2e-6 and g["d"].is_monotonic_increasing
        hit += len(set(g["j"]) & set(np.lexsort((np.arange(1500), d[i]))[:5]))
    assert hit / 7500 >= 0.9
    assert got[got["i"] == 210].sort_values("rank")["j"].tolist() == [200, 201, 202, 203, 204]


def test_neighbour_edges(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (1, [1.0, 0.0]), (8, [-1.0, 0.0]), (8, [0.0, 1.0])]
    got = rows(neighbours.nearest_neighbours(docs(spark, data, "vec_id bigint, embedding array<float>"), k=2))
    by = {i: [(j, round(d, 3)) for k, _, j, d in sorted(got, key=lambda r: r[1]) if k == i] for i in (1, 2, 8)}
    assert {r[0] for r in got} == {1, 2, 8} and by[1] == [(2, 0.005), (8, 1.0)] and by[2] == [(1, 0.005), (8, 0.9)]
    assert rows(neighbours.nearest_neighbours(docs(spark, [], "vec_id bigint, embedding array<float>"))) == []
    assert rows(neighbours.nearest_neighbours(docs(spark, [(1, [1.0])], "vec_id bigint, embedding array<float>"))) == []


def test_best_bin_first_yields_all_leaves_in_order():
    tree = {"centre": np.array([[0, 0], [1, 0], [0, 1], [2, 0], [0.5, 0]], np.float32), "begin": np.array([1, 3, 0, 0, 0]), "end": np.array([3, 5, 0, 0, 0])}
    t = neighbours.Tree(tree)
    assert list(t.leaves(np.array([1, 0], np.float32))) == [4, 2, 3] or set(t.leaves(np.array([1, 0], np.float32))) == {2, 3, 4}
    assert t.descend(np.array([[2, 0], [0.4, 0], [0, 2]], np.float32)).tolist() == [3, 4, 2]


# 3


def slow_leaks(texts, items, least, least_overlap):
    """By words as strings and BM25 written out; none of the operator's code."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    own = {i: words(t) for i, t in items}
    own = {i: w for i, w in own.items() if w}
    mean, n = np.mean([len(w) for w in own.values()]), len(own)

    def weight(word, w):
        df = sum(word in x for x in own.values())
        tf = w.count(word)
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    impact = {i: {x: weight(x, w) for x in set(w)} for i, w in own.items()}
    impact = {i: {x: v / sum(ws.values()) for x, v in ws.items()} for i, ws in impact.items()}

    def parts(text):
        p = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", x)]
        return words(" ".join(p[:-1])), words(p[-1])

    def share(part, passage):
        k = min(3, len(part))
        grams = lambda w: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        return len(grams(part) & grams(passage)) / len(grams(part))

    half, out = max(64, *(len(w) for w in own.values())), {}
    qa = {i: parts(t) for i, t in items}
    for d, text in enumerate(texts):
        w = words(text)
        for lo in range(0, max(1, len(w) - half), half):
            passage = w[lo : lo + 2 * half]
            for i in own:
                score = sum(v for x, v in impact[i].items() if x in set(passage))
                if score >= least - 1e-9:
                    q, a = (share(x, passage) for x in qa[i])
                    if q >= least_overlap and a >= least_overlap:
                        out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, q, a))
    return out


def test_decontamination_by_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    items = [(i, say(rng.randint(8, 20)) + ". " + say(rng.randint(2, 8))) for i in range(60)]
    texts = []
    for i in range(90):
        t = say(rng.randint(0, 300)).split()
        if i % 3 == 0:
            leak = items[rng.randrange(60)][1].split()
            t[rng.randint(0, len(t)) : 0] = [w for w in leak if rng.random() < rng.choice([1, 0.8])]
        texts.append(" ".join(t))
    m = decontamination.build_index(items)
    got = {(d, i): x for d, i, *x in decontamination.find_leaks(texts, m)}
    want = slow_leaks(texts, items, decontamination.LEAST_SCORE, decontamination.LEAST_OVERLAP)
    assert len(want) > 12 and set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_decontamination_edges(spark):
    item = "What is the tallest mountain range of the old world? It is the Himalaya."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "null id item words"), (4, item)], "item_id bigint, text string")
    d = docs(spark, [*EDGES, (8, "before " * 300 + item.upper() + " after" * 300), (9, item), (9, item), (10, "What is the tallest mountain range?")])
    got = sorted((i, j) for i, j, *_ in rows(decontamination.benchmark_leaks(d, bench)))
    assert got == [(8, 1), (8, 4), (9, 1), (9, 1), (9, 4), (9, 4)]
    assert sorted(str(r[0]) for r in rows(decontamination.drop_leaks(d, bench))) == sorted(str(r[0]) for r in [*EDGES, (10,)])
    assert rows(decontamination.benchmark_leaks(d, bench.limit(0))) == [] == rows(decontamination.benchmark_leaks(d.limit(0), bench))


# 4


def slow_repair(roles):
    """Least cost by all sequences of edits of bounded length."""
    best = math.inf
    seen = {}
    todo = [(0, 0, 0)]
    while todo:
        cost, i, q = todo.pop()
        if seen.get((i, q), math.inf) <= cost:
            continue
        seen[i, q] = cost
        if i == len(roles) and q == chat.FINAL:
            best = min(best, cost)
        for role, to in chat.NEXT[q].items():
            todo.append((cost + chat.INSERT, i, to))
            if i < len(roles):
                todo.append((cost + (0 if role == roles[i] else chat.RELABEL if roles[i] in chat.ROLES else chat.UNKNOWN), i + 1, to))
        if i < len(roles) and q:
            role = chat.ROLES[q - 1]
            todo.append((cost + chat.MERGE + (0 if role == roles[i] else chat.RELABEL if roles[i] in chat.ROLES else chat.UNKNOWN), i + 1, q))
    return best


@pytest.mark.parametrize("n", range(1, 6))
def test_chat_repair_by_brute_force(n):
    for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
        cost, edits = chat.repair(roles)
        assert cost == slow_repair(roles), roles
        turns = [r for what, r in edits if what not in ("merge", "remerge")]
        body = turns[1:] if turns[0] == "system" else turns
        assert body and body == ["user", "assistant"] * (len(body) // 2)
        assert sum(w != "insert" for w, _ in edits) == n


def test_chat_edges(spark):
    data = [(1, 2, "assistant", "yes <|im_end|>"), (1, 1, " USER ", "hi"), (2, 1, "user", None), (2, 2, "user", "b"), (2, None, "assistant", LONG), (None, 1, None, "x"), (3, 1, "user", "q"), (3, 1, "user", "q"), (3, 2, "assistant", "z"), (None, 1, "assistant", "y")]
    got = {r.conv_id: r for r in chat.format_chats(docs(spark, data, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes < |im_end|><|im_end|>\n" and got[1].cost == 0
    assert got[2].merges == 1 and len(got[2].chat) > len(LONG) and got[3].merges == 1 and "q\nq" in got[3].chat
    alone = [r for r in chat.format_chats(docs(spark, data, "conv_id bigint, turn bigint, role string, text string")).collect() if r.conv_id is None]
    assert sorted((r.turns_in, r.turns_out) for r in alone) == [(1, 2), (1, 2)]  # each by itself
    assert rows(chat.format_chats(docs(spark, [], "conv_id bigint, turn bigint, role string, text string"))) == []


# 5


def reference_bpe():
    import public_tokenizers as P
    import tiktoken

    with open(bpe.VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(spark):
    rng = random.Random(5)
    texts = [t for _, t in EDGES] + ["".join(rng.choices("ab  \n'sté1.🙂\t\u2029\x1d\r", k=rng.randint(0, 60))) for _ in range(600)] + ["x" * 3000, " " * 500, "<|endoftext|>", "\n\n a\n \nb"]
    df = docs(spark, list(enumerate(texts)))
    enc = reference_bpe()
    out = bpe.bpe_encode(df, least_share=50)  # a small lexicon, so both ways are taken
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].tokens == (None if t is None else enc.encode_ordinary(t)) and got[i].lossless == (None if t is None else True)
    back = dict(rows(bpe.bpe_decode(out)))
    assert all(back[i] == t for i, t in enumerate(texts))
    assert rows(bpe.bpe_encode(docs(spark, []))) == []
    assert len(rows(bpe.bpe_encode(docs(spark, EDGES)))) == len(EDGES)


def test_word_counts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED", 2000)  # passed on many times
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab  \n's.\u2029", k=rng.randint(0, 40))) for _ in range(400)] + ["", " ", None, " lead", "trail "]
    want = {}
    for t in texts:
        for w in bpe.PATTERN.findall(t or ""):
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in bpe.word_counts(docs(spark, list(enumerate(texts)))).collect()} == want


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): np.array([i, i + 1], np.int32).tobytes() for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é"])}
    m = bpe.transducer(words)
    assert bpe.look_up([*words, b"to", b"topsy", b"", b"x"], m) == [*words.values(), None, None, None, None]
    assert len(m["lex_final"]) == 8  # a tree of these words has 17


# 6


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choices("aeiouthnrs", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 120))]
        out.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "src1" if good == (rng.random() < 0.8) else "src2", "en", 500, int(good)))
    return out


def test_quality_on_held_out_documents(spark):
    data = labelled(900, 1)
    d = docs(spark, [(*r[:5],) for r in data], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], r[5]) for r in data[:450]] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.score_quality(d, labels).collect()}
    assert np.mean([got[r[0]].keep == (r[5] == 1) for r in data[450:]]) > 0.95
    assert np.mean([(got[r[0]].p_metadata >= 0.5) == (r[5] == 1) for r in data[450:]]) > 0.6
    assert sorted(r.doc_id for r in quality.keep_good(d, labels).collect()) == sorted(i for i, r in got.items() if r.keep)


def test_exchange_by_brute_force(spark):
    """What views hand to each other, against scores of all documents one by one."""
    data = labelled(700, 3)
    d = docs(spark, [(*r[:5],) for r in data] + [(*data[650][:5],)], "doc_id bigint, text string, source string, lang string, n_chars bigint").repartition(5)
    x, m = quality.content_rows([r[1] for r in data]), quality.metadata_rows(*zip(*((r[2], r[3], r[4]) for r in data)))
    y = np.array([r[5] for r in data], float)
    views = quality.Views(x[:200], m[:200], y[:200])
    w, quotas, sure = views.arrays(), views.quotas(60), 0.6
    own = d.filter("doc_id >= 200").select("doc_id", "text", "source", "lang", "n_chars").withColumn("h", F.xxhash64("doc_id", "text"))
    h = {r.doc_id: r.h for r in own.collect()}
    taken = [set(list(h.values())[:30]), set()]
    got = {k: [] for k in itertools.product(range(2), range(2))}
    for r in quality.sure_of(own, w, quotas, taken, sure).collect():
        got[r.to, r.label].append(r.h)
    p = [[quality._sigmoid(w[f"{v}_cal"][0] * (row[i].astype(float) @ w[v][:-1] + w[v][-1]) + w[f"{v}_cal"][1]) for i in range(700)] for v, row in (("text", x), ("meta", m))]
    for (to, label), hashes in got.items():
        want = sorted(h[i] for i in h if (p[1 - to][i] if label else 1 - p[1 - to][i]) >= sure and h[i] not in taken[to])
        assert sorted(hashes) == want[: quotas[label]]
    assert sum(map(len, got.values())) > 60


def test_metadata_of_like_names():
    a, b = quality.metadata_rows(["news.example.com", "spam.example.com"], ["en", "en"], [1, 1])
    assert (a != b).any()


def test_quality_ties(spark):
    """A document that is voted good as often as bad is good; null votes are none."""
    d = docs(spark, [(*r[:5],) for r in labelled(200, 4)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    votes = [(r[0], r[5]) for r in labelled(200, 4)]
    tie = [(i, 1 - y) for i, y in votes if y]  # every good one is a tie now, and stays good
    schema = "doc_id bigint, quality int"
    once, twice = (rows(quality.score_quality(d, spark.createDataFrame(v, schema)).orderBy("doc_id")) for v in (votes, votes + tie + [(1, None)]))
    assert once == twice


def test_quality_edges(spark):
    d = docs(spark, [(*r, None, None, None) for r in EDGES], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = rows(quality.score_quality(d, none))
    assert len(got) == len(EDGES) and all(r[3] == 1 and r[4] and r[1] is None for r in got)
    data = labelled(200, 2)
    some = docs(spark, [(*r[:5],) for r in data], "doc_id bigint, text string, source string, lang string, n_chars bigint").unionByName(d.withColumn("doc_id", F.col("doc_id") + 10_000))
    assert len(rows(quality.score_quality(some, spark.createDataFrame([(r[0], r[5]) for r in data], none.schema)))) == 200 + len(EDGES)
    assert rows(quality.score_quality(d.limit(0), none)) == []


# 7


def slow_phrases(text, train):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_by_brute_force():
    rng = random.Random(7)
    trains = [bytes(rng.choices(range(1, 5), k=400)), bytes(rng.choices(range(1, 4), [5, 2, 1], k=300)), b"\1\1\1\1\1\2\2"]
    m = language_id.dense([language_id.suffix_automaton(list(t)) for t in trains])
    texts = [bytes(rng.choices(range(1, 6), k=rng.choice([0, 1, 5, 50, 90, 700]))) for _ in range(60)]
    texts += [b"\1" * 1000, b"\1" * 31 + b"\2" * 64 + b"\1" * 500, trains[0][100:] + trains[0][:300]]  # parses from other places never meet
    at = np.cumsum([0, *map(len, texts)])
    for stretch in (32, 7, 1, 5000):
        got = language_id.phrases(np.frombuffer(b"".join(texts), np.uint8), at, m, stretch)
        assert got.tolist() == [[slow_phrases(t, tr) for tr in trains] for t in texts]


def test_language_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_language(d).join(d.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("n > 200")
    share = got.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.avg(F.col("keep").cast("int"))).first()
    assert share[0] > 0.98 and share[1] > 0.98


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_unknown_languages_are_rejected(spark, lang):
    """Each language is left out in turn: its documents are rejected, those of others are not. Odd ids only; the limit was
    chosen on even ones."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 10 = 1")
    got = language_id.identify_language(d.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang"))))
    known, unknown = got.join(d.select("doc_id", (F.col("lang") == lang).alias("own"), F.length("text").alias("n")), "doc_id").filter("n > 100").agg(
        F.avg(F.when(~F.col("own"), F.col("keep").cast("int"))), F.avg(F.when(F.col("own"), F.col("keep").cast("int")))).first()
    assert known > 0.99 and unknown < 0.05, (known, unknown)


def test_short_texts_of_no_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "привет как дела сегодня у тебя все хорошо", None), (-2, "q x z q w v k j x z w q k v x j z " * 3, None), (-3, "of the that was in the", None)]
    got = {r.doc_id: r.keep for r in language_id.identify_language(d.union(spark.createDataFrame(odd, d.schema))).filter("doc_id < 0").collect()}
    assert got == {-1: False, -2: False, -3: True}


def test_language_edges(spark):
    d = docs(spark, [(*r, None) for r in EDGES] + [(100 + i, f"the cat sat on mat number {'abcdefgh'[i]} again", "en") for i in range(8)] + [(200 + i, f"le chat est sur la table {'abcdefgh'[i]} encore", "fr") for i in range(8)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_language(d).collect()}
    assert got[3].language is None and not got[3].keep and got[2].language is None and got[5].language is None
    assert all(got[100 + i].language == "en" for i in range(8)) and all(got[200 + i].language == "fr" for i in range(8))
    none = language_id.identify_language(d.withColumn("lang", F.lit(None).cast("string")))
    assert all(r[1] is None and not r[4] for r in rows(none))
    assert rows(language_id.identify_language(d.limit(0))) == [] == rows(language_id.keep_known_languages(d.limit(0)))


# 8


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    say = lambda n: rng.choices(words, k=n)
    texts, family = [], []
    for f in range(40):
        base = say(rng.randint(30, 200))
        for c in range(1 if f % 2 else rng.choice([2, 3, 60])):
            t = list(base)
            for _ in range(len(t) // 40 if c else 0):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
            family.append(f)
    got = rows(near_dedup.near_duplicates(docs(spark, list(enumerate(texts)))))
    group = {i: g for i, g, *_ in got}
    shingle = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingle[i] & shingle[j]) / len(shingle[i] | shingle[j]) >= 0.8]
    found = sum(group.get(i, -1) == group.get(j, -2) for i, j in near)
    assert found / len(near) >= 0.98
    assert all(family[i] == family[g] for i, g in group.items()) and all((i == g) == k for i, g, _, k in got)
    size = {g: sum(x == g for x in group.values()) for g in set(group.values())}
    assert all(n == size[g] - 1 for _, g, n, _ in got)
    hot = near_dedup.classes(docs(spark, list(enumerate(texts))), hot=8)  # regions shared by tasks of two blocks each
    assert {(r["id"], r["first"]) for r in hot.collect()} == set(group.items())


def test_large_regions_by_all_pairs():
    rng = np.random.default_rng(10)
    least = near_dedup.needed(near_dedup.THRESHOLD)
    keys = rng.integers(0, 256, (3000, near_dedup.VALUES), np.uint8)
    for i in range(1, 3000, 2):  # each has one near copy with just enough equal bytes, elsewhere in the order
        same = rng.permutation(near_dedup.VALUES)[: least + i // 2 % 6 - 1]
        keys[i, same] = keys[i - 1, same]
    keys[:, :3] = 7  # all in one region
    keys = keys[np.lexsort(keys.T[::-1])]
    want = {(i, j) for i in range(3000) for j in (np.flatnonzero((keys[i + 1 :] == keys[i]).sum(1) >= least) + i + 1).tolist()}
    got = near_dedup.region_edges(keys, least)
    assert len(want) > 1200 and {(min(e), max(e)) for e in got} == want
    keys[:, 50:] = 9  # and all alike
    edges = near_dedup.region_edges(keys, least)
    assert len(edges) >= 2999 and set(parts(3000, edges)) == {0}


def parts(n, edges):
    """The least row that edges join each one to."""
    at = list(range(n))

    def top(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_regions_of_classes_by_all_pairs(seed):
    """Classes of many rows that drift away from each other, so that pivots alone don't tell."""
    rng = np.random.default_rng(seed)
    least, out = near_dedup.needed(near_dedup.THRESHOLD), []
    for _ in range(30):
        row = rng.integers(0, 256, near_dedup.VALUES, np.uint8)
        for _ in range(int(rng.integers(1, 60))):
            row = row.copy()
            row[rng.integers(3, near_dedup.VALUES, int(rng.integers(1, 60)))] = rng.integers(0, 256)
            out.append(row)
    keys = np.array(out)
    keys[:, :3] = 7
    keys[:, rng.permutation(np.arange(3, near_dedup.VALUES))[:30]] = 5  # all have a common part, as by a shared passage
    keys = np.unique(keys, axis=0)
    near = [(i, j) for i in range(len(keys)) for j in (np.flatnonzero((keys[i + 1 :] == keys[i]).sum(1) >= least) + i + 1).tolist()]
    got = near_dedup.region_edges(keys, least, region=16)
    assert {(min(e), max(e)) for e in got} <= set(near) and parts(len(keys), got) == parts(len(keys), near)


def test_regions_over_batches():
    rng = np.random.default_rng(12)
    region, sig = np.sort(rng.integers(0, 40, 400)), rng.integers(0, 2, (400, near_dedup.VALUES), np.uint8)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(region[a:b]), pa.array([x.tobytes() for x in sig[a:b]]), pa.array(np.arange(a, b))], names=["region", "sig", "rid"])
    pairs = lambda batches: sorted(p for x in near_dedup.edges_of_regions(iter(batches), least=70) for p in zip(*(c.to_pylist() for c in x.columns)))
    whole = pairs([batch(0, 400)])
    assert len(whole) > 50 and all(pairs([batch(i, min(i + n, 400)) for i in range(0, 400, n)]) == whole for n in (1, 3, 7, 150))


def test_near_duplicate_recall_at_the_threshold(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(20_000)]
    texts = []
    for _ in range(1500):
        t = rng.choices(words, k=150)
        texts.append(" ".join(t))
        for i in rng.sample(range(150), rng.randint(15, 20)):
            t[i] = rng.choice(words)
        texts.append(" ".join(t))
    sig = near_dedup.signatures(texts)[0]
    same = (sig[::2] == sig[1::2]).sum(1)
    near = np.flatnonzero((same >= near_dedup.needed(near_dedup.THRESHOLD)) & (same <= 0.7 * near_dedup.VALUES)) * 2
    group = {i: g for i, g, *_ in rows(near_dedup.near_duplicates(docs(spark, list(enumerate(texts)))))}
    found = sum(group.get(i, -1) == group.get(i + 1, -2) for i in near.tolist())
    assert len(near) > 400 and found / len(near) >= 0.99, (found, len(near))


def test_near_duplicate_edges(spark):
    d = docs(spark, [*EDGES, (11, "One TWO three four"), (10, "one two, three four!"), (12, "one"), (13, "One."), (14, LONG + "x")])
    got = rows(near_dedup.near_duplicates(d))
    groups = {}
    for i, g, _, k in got:
        groups.setdefault(g, []).append((i, k))
    assert sorted((g, sorted(v)) for g, v in groups.items()) == [(4, [(4, False), (4, True)]), (6, [(6, True), (14, False)]), (10, [(10, True), (11, False)]), (12, [(12, True), (13, False)])]
    left = near_dedup.drop_near_duplicates(d)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, None, 4, 5, 6, 7, 10, 12]))
    assert rows(near_dedup.near_duplicates(d.limit(0))) == [] == rows(near_dedup.drop_near_duplicates(d.limit(0)))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {v: top(v) for v in parent if top(v) != v}


# 9


def test_segmentation_by_brute_force():
    rng = random.Random(10)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -float(rng.randint(2, 12)) for _ in range(25)}

    def cost(parts):
        return sum(words[p] if p in words else url_filter.NO_WORD + url_filter.NO_WORD_CHAR * len(p) for p in parts)

    for _ in range(200):
        name = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        splits = [[name[i:j] for i, j in zip((0, *c), (*c, len(name)))] for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k)]
        got = url_filter.segment(name, words)
        assert "".join(got) == name and cost(got) == pytest.approx(max(map(cost, splits)))


def test_words_of_hosts():
    split = url_filter.splitter(url_filter.VOCAB)
    assert split("cheappills.com")[:2] == ["cheap", "pills"] and split("casino-win24.net") == ["casino", "win", "24", "net"] and split("freebets") == ["free", "bets"] and split("") == []


def test_url_filter_finds_company_of_seeds(spark):
    urls = [f"http://casinojackpot{i}.com/play" for i in range(30)] + [f"https://www.daily-news.org/story/{i}" for i in range(300)] + [f"http://jackpotplay{i}.com/play" for i in range(5)]
    d = docs(spark, [*enumerate(urls), (1000, None), (1001, ""), (None, "x"), (1002, "http://a.com/" + "p/" * 50_000), (3, urls[3])], "page_id bigint, url string")
    got = rows(url_filter.filter_urls(d))
    verdict = {i: b for i, _, _, b in got}
    assert len(got) == len(urls) + 5 and all(verdict[i] for i in [*range(30), *range(330, 335)]) and not any(verdict[i] for i in [*range(30, 330), 1000, 1001])
    plain = rows(url_filter.filter_urls(d.filter("url LIKE '%news%'")))
    assert not any(r[3] for r in plain) and rows(url_filter.filter_urls(d.limit(0))) == []


def test_bayes_by_brute_force(spark):
    """Scores of all URLs, with counts and logarithms written out over plain dictionaries of tokens."""
    rng = random.Random(14)
    hosts = ["casino-win.example.com", "poker-win.example.net", "bestwin.example.org", "news-paper.example.com", "catalog.example.org", "win-forum.example.com"]
    urls = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['a', 'play', 'read'])}/{rng.randint(1, 999)}") for i in range(300)]
    split = url_filter.splitter(url_filter.VOCAB)
    seeds, seen = {"casino", "poker"}, {}
    count = {True: {}, False: {}}
    n = {True: 0, False: 0}
    for i, u in urls:
        words, t = url_filter.tokens(u, split)
        seen[i], bad = t, bool(seeds & set(words))
        n[bad] += 1
        for x in t:
            count[bad][x] = count[bad].get(x, 0) + 1
    kinds = len(set(count[True]) | set(count[False]))
    odds = lambda t: math.log(n[True] / n[False]) + sum(math.log((count[True].get(x, 0) + 0.5) / (sum(count[True].values()) + 0.5 * kinds)) - math.log((count[False].get(x, 0) + 0.5) / (sum(count[False].values()) + 0.5 * kinds)) for x in t)
    got = {r.page_id: r for r in url_filter.filter_urls(docs(spark, urls, "page_id bigint, url string"), seeds=list(seeds)).collect()}
    assert all(abs(got[i].score - odds(t)) < 1e-5 and got[i].blocked == (got[i].score >= 0) for i, t in seen.items())


def test_hidden_seeds_are_found_by_their_company(spark):
    """Half of the seed words are hidden: of the farms' hosts that have only hidden ones most are found, of others none."""
    rng = random.Random(15)
    seeds = sorted(url_filter.SEEDS)
    shown = seeds[::2]
    farm, plain = ["win", "free", "bonus", "deal", "click", "instant"], ["garden", "music", "river", "school", "city", "paper", "train", "stone"]
    urls, hidden = [], set()
    for i in range(2000):
        if i % 5 == 0:
            word = rng.choice(seeds)
            urls.append((i, f"http://{rng.choice(farm)}{word}{rng.choice(farm)}.example.com/{rng.choice(farm)}/{i}"))
            if word not in shown:
                hidden.add(i)
        else:
            urls.append((i, f"http://{rng.choice(plain)}{rng.choice(plain)}.example.com/{rng.choice(plain)}/{i}"))
    got = {r.page_id: r.blocked for r in url_filter.filter_urls(docs(spark, urls, "page_id bigint, url string"), seeds=shown).collect()}
    assert len(hidden) > 150 and np.mean([got[i] for i in hidden]) > 0.9 and not any(b for i, b in got.items() if i % 5)


def test_segmentation_ties():
    """Of equal scores the split of fewest parts, then that whose last part is longest."""
    words = {"ab": -2.0, "cd": -2.0, "a": -1.0, "b": -1.0, "abcd": -4.0, "abc": -2.0, "d": -2.0}
    assert url_filter.segment("abcd", words) == ["abcd"]
    del words["abcd"]
    assert url_filter.segment("abcd", words) == ["ab", "cd"]


# 10

PAGE = "<html><head><title>t</title><style>x</style></head><body><nav><ul><li><a href=/a>home</a></ul></nav><div class=ad>buy now</div><article><h1>Head</h1><p>A long <b>text</b> of words &amp; more.<br>Another line.</article><!-- c --><script>no()</script><footer>&copy; foot</footer></body>"


def test_blocks():
    got = [(t, p[-1] if p else None, a) for t, p, a in html_blocks.blocks(PAGE)]
    assert got == [("t", "title", 0), ("home", "li", 4), ("buy now", "div.ad", 0), ("Head", "h1", 0), ("A long text of words & more.", "p", 0), ("Another line.", "p", 0), ("© foot", "footer", 0)]
    assert html_blocks.blocks(None) == html_blocks.blocks("") == html_blocks.blocks("<p> </p><!--") == [] and html_blocks.blocks("1 < 2")[0][0] == "1 < 2"
    assert [html_blocks.label(p) for _, p, _ in html_blocks.blocks(PAGE)] == [0, 0, 0, 1, 1, 1, 0]
    assert len(html_blocks.blocks("<div>x" * 20_000)) == 20_000


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    x, live = html_blocks.padded(rng.normal(size=(9, html_blocks.WIDTH)).astype(np.float32), np.array([4, 2, 3]))
    p, weight = html_blocks.initial(), rng.normal(size=(4, 3, html_blocks.HIDDEN)).astype(np.float32)
    loss = lambda w: float((html_blocks.run_lstm(x, live, w, p["cf"]).astype(np.float64) * weight * live[:, :, None]).sum())
    saved = []
    html_blocks.run_lstm(x, live, p["wf"], p["cf"], saved)
    dw, _ = html_blocks.lstm_gradient(x, live, p["wf"], saved, weight * live[:, :, None])
    for i, j in ((0, 0), (5, 20), (html_blocks.WIDTH + 3, 40), (html_blocks.WIDTH + 9, 60)):
        up, down = p["wf"].copy(), p["wf"].copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        assert dw[i, j] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=2e-3)


def test_labeller_on_held_out_pages(spark):
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").select("html").collect()]
    found = [html_blocks.blocks(p) for p in pages]
    p = html_blocks.train(found[:120], turns=12)
    # The held-out pages don't name their parts.
    hidden = [[(t, tuple(x for x, h in zip(path, html_blocks.hints(path)) if h < 0), a) for t, path, a in page] for page in found[120:]]
    odds = html_blocks.classify(hidden, p)
    right = [(z > 0) == (html_blocks.label(b[1]) == 1) for page, o in zip(found[120:], odds) for b, z in zip(page, o.tolist()) if html_blocks.label(b[1]) >= 0]
    assert np.mean(right) > 0.95
    alone = [html_blocks.classify([x], p)[0] for x in hidden[:20]]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(alone, odds))


def test_extraction_edges(spark):
    d = docs(spark, [(1, PAGE), (2, ""), (3, None), (None, PAGE), (4, PAGE), (4, PAGE), (5, "<p>" + LONG), (6, "<<<>>> </ <a href='")] + [(10 + i, PAGE) for i in range(30)], "page_id bigint, html string")
    got = rows(html_blocks.extract_text(d))
    by = {r[0]: r for r in got}
    assert len(got) == 38 and by[3] == (3, None, 0, 0) and by[2] == (2, "", 0, 0) and by[1][2] == 7 and "A long text of words & more." in by[1][1] and "foot" not in by[1][1]
    assert by[5][2] == 1
    assert rows(html_blocks.extract_text(d.limit(0))) == []
    assert rows(html_blocks.extract_text(docs(spark, [(1, "<p>a<p>b")], "page_id bigint, html string"))) == [(1, "a\nb", 2, 2)]


def test_chunks_cover_all():
    texts = ["a" * 10, None, "", "b" * 50, "c"]
    parts = list(common.chunks(texts, 20))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and list(common.chunks([])) == []


def test_forward_pass_by_brute_force():
    """The labeller's log-odds against a bidirectional LSTM written out for one block at a time."""
    rng = np.random.default_rng(16)
    p = {k: (v + 0.1 * rng.normal(size=v.shape)).astype(np.float32) for k, v in html_blocks.initial().items()}
    pages = [[(f"some words {i} here {'and more ' * (i % 4)}.", ("html", "div.a.b" if i % 2 else "nav", "p"), i % 3) for i in range(n)] for n in (1, 7, 3, 12)]
    hidden, sig = html_blocks.HIDDEN, lambda z: 1 / (1 + np.exp(-z))

    def run(x, w, c0):
        h, c, out = np.zeros(hidden), np.zeros(hidden), []
        for row in x:
            z = np.concatenate([row, h]) @ w + c0
            c = sig(z[hidden : 2 * hidden]) * c + sig(z[:hidden]) * np.tanh(z[2 * hidden : 3 * hidden])
            h = sig(z[3 * hidden :]) * np.tanh(c)
            out.append(h)
        return np.array(out)

    for page, got in zip(pages, html_blocks.classify(pages, p)):
        x = html_blocks.features([page]).astype(float)
        seen = np.concatenate([run(x, p["wf"], p["cf"]), run(x[::-1], p["wb"], p["cb"])[::-1], x], 1)
        assert np.allclose(got, seen @ p["out"] + p["bias"][0], atol=1e-4)


def test_all_words_of_all_roles_count():
    found = html_blocks.blocks("<div id=x class='big sidebar'><p>one</p></div><div class='a.b main'>two</div>")
    assert found[0][1] == ("div.x.big.sidebar", "p") and [html_blocks.label(b[1]) for b in found] == [0, 1]


def test_rare_marks_train(spark):
    """Pages of plain divs by the thousand, and copies of one, don't keep the few marked ones from training."""
    marked = [(i, f"<nav><p>menu {i}</p></nav><article><p>{'a long story of many words. ' * 5}{i}</p></article>") for i in range(12)]
    plain = [(100 + i, f"<div><p>text {i % 300}</p></div>") for i in range(1500)] + [(5000 + i, marked[0][1]) for i in range(500)]
    got = {r.page_id: r for r in html_blocks.extract_text(docs(spark, marked + plain, "page_id bigint, html string")).collect()}
    assert all(got[i].kept == 1 and "story" in got[i].text for i in range(12))


# all


def test_one_memo_of_a_worker():
    m = bpe.merge_tables(bpe.read_ranks())
    m |= bpe.transducer({})
    for key in ("one", "two", "three"):
        bpe.encode_texts(["some text of words " + "x" * 5000, "and others"], m, key)
    assert common._memo_key == "three" and set(common._memos) == {"units", "words"}
    assert all(0 < memo.held < 10_000 and not any(len(k) > 1000 for k in memo) for memo in common._memos.values())
    small = common.memo("four", "x", 2000)
    late = small.learn({f"key{i}" for i in range(50)}, lambda new: [b"v"] * len(new))
    assert len(small) == 50 and len(late) >= 40 and small.held <= 2000
    small.forget(late)
    assert len(small) == 50 - len(late) and set(common._memos) == {"x"}


OPERATORS = {
    "op1": lambda d, i: token_counts.token_counts(d, i),
    "op3": lambda d, i: decontamination.benchmark_leaks(d, d.sparkSession.createDataFrame([("q1", "word and more words word and more words. word and")], "doc_id string, text string"), i, item_col="doc_id"),
    "op5": lambda d, i: bpe.bpe_encode(d, i),
    "op6": lambda d, i: quality.score_quality(d, d.sparkSession.createDataFrame([(1, 0), (2, 1)], f"`{i}` bigint, quality int"), i),
    "op7": lambda d, i: language_id.identify_language(d, i),
    "op8": lambda d, i: near_dedup.near_duplicates(d, i),
    "op9": lambda d, i: url_filter.filter_urls(d, i, "text"),
    "op10": lambda d, i: html_blocks.extract_text(d, i, "text"),
    "op4": lambda d, i: chat.format_chats(d, i, "n_chars", "lang", "source"),
    "op2": lambda d, i: neighbours.nearest_neighbours(d, i),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("id_col", ["tokens", "sig", "rank", "text_"])
def test_clashing_names(spark, name, id_col):
    """Ids called as results or inner columns are, and columns that differ from others by case alone or look like inner ones."""
    d = spark.createDataFrame([(1, "word and more words " * 20, "en", "s", 3), (2, "word and more words " * 20, "en", "s", 3), (3, None, None, None, None)], f"`{id_col}` bigint, text string, lang string, source string, n_chars bigint")
    clash = d.columns + ["TEXT", id_col.upper(), "__quarrymill_place", "__quarrymill_n", "__quarrymill_id", "c0", "c1", "rid", "times", "id", "item", "h"]
    d = d.select("*", *(F.lit("clash") for _ in clash[5:])).toDF(*clash)
    if name == "op2":
        d = d.toDF(*(f"c{i}" for i in range(len(clash)))).withColumn("v", F.array(F.lit(1.0), F.col("c0").cast("double"))).toDF(*clash, "embedding")
    out = OPERATORS[name](d, id_col)
    assert out.columns[0] == id_col and len({c.lower() for c in out.columns}) == len(out.columns)
    assert {r[0] for r in out.collect()} <= {1, 2, 3, None}


@pytest.mark.parametrize("keep", ["good", "known", "one", "leaks"])
def test_filters_with_clashing_names(spark, keep):
    d = spark.createDataFrame([(1, "word and more words " * 20, "en", "s", 3), (2, "word and more words " * 20, "en", "s", 3), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = d.columns + ["TEXT", "DOC_ID", "__quarrymill_place", "c0", "rid", "keep", "times"]
    d = d.select("*", *(F.lit("clash") for _ in names[5:])).toDF(*names)
    one = d.sparkSession.createDataFrame([(1, "word and more words word and more words. word and")], "item_id bigint, text string")
    labels = d.sparkSession.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    out = {"good": lambda: quality.keep_good(d, labels), "known": lambda: language_id.keep_known_languages(d), "one": lambda: near_dedup.drop_near_duplicates(d), "leaks": lambda: decontamination.drop_leaks(d, one)}[keep]()
    assert out.columns == names and {"good": 3, "known": 2, "one": 2, "leaks": 1}[keep] == len(rows(out))
