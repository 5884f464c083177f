"""Operator 5: byte-level BPE encoding and decoding with a lexicon of frequent words.

The words that make up at least one in LEAST_SHARE of the corpus' words (counted over all documents) are
merged once and compiled into a minimal acyclic transducer: an automaton that shares prefixes and suffixes
and whose arcs carry numbers that add up to the word's index among the id outputs. Workers memory-map it.
Words that it lacks are merged exactly, by rank, leftmost first. Which words are in it never changes a result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from functools import partial
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCAB = f"{common.TOKENIZERS}/byte_bpe_50k.tiktoken"
#: How the tokenizer splits text into words before merging.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as the pattern has it. Two in a row, and the units of text that hold such.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUN = re.compile(f"[{_SPACE}]{{2}}")
UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A word is frequent if it makes one in so many of all words; so there are at most so many of them.
LEAST_SHARE = 1 << 20
#: Bytes of units, and of words, that a worker remembers; bytes of distinct units that it counts before passing them on.
#: Only speed depends on them.
MEMO, COUNTED = 64 << 20, 64 << 20
INF = np.iinfo(np.int32).max
LONG = 256


def read_ranks(path: str = VOCAB) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_tables(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """Ids of single bytes; an open hash table from pairs of ids to the id of their merge; the bytes of each id."""
    keys, values = [], []
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            a, b = ranks.get(word[:i]), ranks.get(word[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(rank)
    bits = max(8, (3 * len(keys)).bit_length())
    slots, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, INF, np.int32)
    for k, v in zip(keys, values):
        at = _slot(np.array([k], np.int64), bits)[0]
        while slots[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        slots[at], merged[at] = k, v
    size = max(ranks.values()) + 1
    words = [b""] * size
    for word, rank in ranks.items():
        words[rank] = word
    return {"bytes": np.array([ranks[bytes([b])] for b in range(256)], np.int32), "slots": slots, "merged": merged,
            "blob": np.frombuffer(b"".join(words), np.uint8), "blob_at": np.cumsum([0, *map(len, words)])}


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pair_ranks(a: np.ndarray, b: np.ndarray, m) -> np.ndarray:
    slots, merged = m["slots"], m["merged"]
    keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
    bits = len(slots).bit_length() - 1
    at = _slot(keys, bits)
    found = slots[at]
    out = merged[at]
    todo = np.flatnonzero((found != keys) & (found >= 0))
    out[(found != keys)] = INF
    while len(todo):
        at[todo] = (at[todo] + 1) & (len(slots) - 1)
        found = slots[at[todo]]
        hit = found == keys[todo]
        out[todo[hit]] = merged[at[todo[hit]]]
        todo = todo[~hit & (found >= 0)]
    return out


def _merge_long(raw: bytes, m) -> bytes:
    """One long word, with a heap of pairs."""
    ids = np.asarray(m["bytes"])[np.frombuffer(raw, np.uint8)]
    first = pair_ranks(ids[:-1], ids[1:], m)
    heap = [(int(r), int(i), int(ids[i]), int(ids[i + 1])) for i, r in enumerate(first) if r < INF]
    heapq.heapify(heap)
    n = len(ids)
    tokens, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

    def push(i: int, j: int) -> None:
        r = int(pair_ranks(np.array([tokens[i]]), np.array([tokens[j]]), m)[0])
        if r < INF:
            heapq.heappush(heap, (r, i, tokens[i], tokens[j]))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if tokens[i] != a or j >= n or tokens[j] != b:
            continue
        tokens[i], tokens[j] = r, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            push(i, after[j])
        if before[i] >= 0:
            push(before[i], i)
    return np.array([t for t in tokens if t >= 0], np.int32).tobytes()


def merge_words(raw: list[bytes], m) -> list[bytes]:
    """Exact merges of many words in lockstep: a lane is a word, each step merges every lane's pair of least rank."""
    out: list[bytes] = [b""] * len(raw)
    size = np.array([len(r) for r in raw])
    of_byte = np.asarray(m["bytes"])
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = _merge_long(raw[i], m)
    order = np.argsort(size, kind="stable")
    order = order[(size[order] > 0) & (size[order] <= LONG)]
    at = 0
    while at < len(order):
        longest = max(6, int(size[order[at]]) * 5 // 4)
        end = min(int(np.searchsorted(size[order], longest, "right")), at + (1 << 21) // longest)
        lanes = order[at:end]
        at = end
        n, width = len(lanes), int(size[lanes[-1]])
        text = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in lanes), np.uint8).reshape(n, width)
        length = size[lanes]
        tokens = of_byte[text]
        place = np.arange(width)
        alive = place < length[:, None]
        tokens = np.concatenate([np.where(alive, tokens, -1), np.full((n, 1), -1, np.int32)], 1)
        rank = np.full((n, width + 1), INF, np.int32)
        if width > 1:
            both = alive[:, 1:]
            rank[:, : width - 1][both] = pair_ranks(tokens[:, :-2][both], tokens[:, 1:-1][both], m)
        after = np.tile(np.minimum(place + 1, width), (n, 1))
        before = np.tile(place - 1, (n, 1))
        row = np.arange(n)
        while len(row):
            i = rank[row].argmin(1) if len(row) < n else rank.argmin(1)
            best = rank[row, i]
            go = best < INF
            row, i, best = row[go], i[go], best[go]
            if not len(row):
                break
            j = after[row, i]
            k = after[row, j]
            tokens[row, i] = best
            tokens[row, j] = -1
            rank[row, j] = INF
            after[row, i] = k
            inside = k < width
            before[row[inside], k[inside]] = i[inside]
            right = tokens[row, k]
            some = (right >= 0) & inside
            rank[row, i] = INF
            rank[row[some], i[some]] = pair_ranks(best[some], right[some], m)
            h = before[row, i]
            some = h >= 0
            rank[row[some], h[some]] = pair_ranks(tokens[row[some], h[some]], best[some], m)
        kept = tokens[:, :width] >= 0
        flat = tokens[:, :width][kept].tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        begin = 0
        for lane, stop in zip(lanes.tolist(), ends):
            out[lane] = flat[begin:stop]
            begin = stop
    return out


def transducer(entries: dict[bytes, bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of the words (as keys), built in sorted order; the ids of each as int32 bytes.

    key: state * 256 + byte, sorted; to: next state; skip: what the arc adds to the index; final: accepting.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in register:
            register[shape] = len(states)
            states.append(shape)
        return register[shape]

    path: list[list] = [[False, []]]  # from the root: accepting, arcs that are done
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(labels) > depth:
            node = path.pop()
            path[-1][1].append((labels.pop(), freeze(node)))

    words, last = sorted(entries), b""
    for word in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same)
        for b in word[same:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(path[0])
    below = []
    key, to, skip = [], [], []
    for s, (final, arcs) in enumerate(states):  # a state's targets come before it
        n = int(final)
        for b, t in arcs:
            key.append(s << 8 | b)
            to.append(t)
            skip.append(n)
            n += below[t]
        below.append(n)
    ids = [entries[w] for w in words]
    return {"lex_key": np.array(key, np.int64), "lex_to": np.array(to, np.int32), "lex_skip": np.array(skip, np.int32),
            "lex_final": np.array([f for f, _ in states], bool), "lex_root": np.array([root], np.int32),
            "lex_ids": np.frombuffer(b"".join(ids), np.int32), "lex_at": np.cumsum([0, *(len(x) // 4 for x in ids)])}


def look_up(raw: list[bytes], m) -> list[bytes | None]:
    """The transducer's output for each word, or None."""
    key, to, skip, final = (np.asarray(m[k]) for k in ("lex_key", "lex_to", "lex_skip", "lex_final"))
    out: list[bytes | None] = [None] * len(raw)
    if not len(key):
        return out
    size = np.array([len(r) for r in raw])
    ends = np.cumsum(size)
    text = np.frombuffer(b"".join(raw), np.uint8)
    lane = np.argsort(-size, kind="stable")
    state = np.full(len(raw), int(m["lex_root"][0]), np.int64)
    index = np.zeros(len(raw), np.int64)
    done = []
    step = 0
    while len(lane):
        over = size[lane] == step
        stop = lane[over]
        done.append(stop[final[state[stop]]])
        lane = lane[~over]
        if not len(lane):
            break
        want = state[lane] << 8 | text[ends[lane] - size[lane] + step]
        arc = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[arc] == want
        lane, arc = lane[hit], arc[hit]
        index[lane] += skip[arc]
        state[lane] = to[arc]
        step += 1
    ids, at = m["lex_ids"], m["lex_at"]
    for i in np.concatenate(done).tolist() if done else []:
        k = int(index[i])
        out[i] = np.asarray(ids[at[k] : at[k + 1]]).tobytes()
    return out


def units(text: str) -> list[str]:
    """Parts of a text whose words are the text's words: a space belongs to what follows it, and white space in a row
    to itself. The pattern has to split each distinct part only once. (Parts of a text without white space in a row
    may hold several lines.)"""
    if RUN.search(text):
        return UNIT.findall(text)
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


def encode_words(new: list[str], m) -> list[bytes]:
    raw = [w.encode("utf-8", "replace") for w in new]
    ids = look_up(raw, m)
    rest = [i for i, x in enumerate(ids) if x is None]
    for i, x in zip(rest, merge_words([raw[i] for i in rest], m)):
        ids[i] = x
    return ids


#: White space that no unit has which is split with others; between units the pattern takes it for a word of its own.
GAP, _GAP_IDS = "\u2029", np.array([-1], np.int32).tobytes()
_ODD = re.compile(f"^$|[{_SPACE}{GAP}]$|^[{_SPACE}](?:[{_SPACE}]|$)|{GAP}")


def split_units(some: list[str]) -> tuple[list[str], list[list[str]]]:
    """The words of all units but odd ones in a row, with a GAP before and between units, by one call of the pattern; and the
    words of each odd one, which begins or ends with white space that GAP would join."""
    odd = [PATTERN.findall(u) for u in some if _ODD.search(u)]
    rest = [u for u in some if not _ODD.search(u)] if odd else some
    return PATTERN.findall(GAP + GAP.join(rest)) if rest else [], odd


def encode_units(new: list[str], m, of_word: common.Memo) -> list[bytes]:
    """Ids of different units."""
    plain, odd = split_units(new)
    words = set(plain)
    words.discard(GAP)
    late = of_word.learn(words.union(chain.from_iterable(odd)), lambda x: encode_words(x, m))
    flat = b"".join([_GAP_IDS if w == GAP else of_word[w] for w in plain])
    ends = (np.append(np.flatnonzero(np.frombuffer(flat, np.int32) == -1)[1:], len(flat) // 4) * 4).tolist() if flat else []
    begin, out = 4, []
    for end in ends:
        out.append(flat[begin:end])
        begin = end + 4
    own = iter([b"".join(map(of_word.__getitem__, x)) for x in odd])
    of_word.forget(late)
    if odd:
        rest = iter(out)
        out = [next(own) if _ODD.search(u) else next(rest) for u in new]
    return out


def encode_texts(texts: list[str], m, key: str = "") -> list[bytes]:
    """Ids of each text, as int32 bytes."""
    of_unit, of_word = common.memo(key, "units", MEMO), common.memo(key, "words", MEMO // 2)
    split = [units(t) for t in texts]
    flat = list(chain.from_iterable(split))
    got = list(map(of_unit.get, flat))
    todo = list(compress(range(len(flat)), map(not_, got)))
    if todo:
        new = list(set(map(flat.__getitem__, todo)))
        made = dict(zip(new, encode_units(new, m, of_word)))
        for i in todo:
            got[i] = made[flat[i]]
        of_unit.keep(made)
    out, at = [], 0
    for x in split:
        out.append(b"".join(got[at : at + len(x)]))
        at += len(x)
    return out


class Known:
    """Units by their hash, as arrays: an open table of hashes, and the ids of each unit in a row. It takes units until it
    has SLOTS / 2 of them or as many ids as twice SLOTS; later ones aren't held."""

    SLOTS = 1 << 21

    def __init__(self):
        self.hashes, self.index = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.at, self.ids, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0
        self.shift = np.uint64(65 - self.SLOTS.bit_length())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash' unit, or -1."""
        place = (h >> self.shift).astype(np.int64)
        seen = self.hashes[place]
        out = np.where(seen == h, self.index[place], -1)
        todo = np.flatnonzero((seen != h) & (seen != 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & (self.SLOTS - 1)
            seen = self.hashes[place[todo]]
            hit = seen == h[todo]
            out[todo[hit]] = self.index[place[todo[hit]]]
            todo = todo[~hit & (seen != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Takes new units of different hashes, as many as there is room for; ends: of each one's ids."""
        room = min(self.SLOTS // 2 - self.n, int(np.searchsorted(ends, 2 * self.SLOTS - self.at[self.n], "right")))
        h, ends = h[: max(0, room)], ends[: max(0, room)]
        if not len(h):
            return
        begin = int(self.at[self.n])
        more = int(ends[-1])
        while len(self.at) <= self.n + len(h):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.ids) < begin + more:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[begin : begin + more] = ids[:more]
        self.at[self.n + 1 : self.n + 1 + len(h)] = begin + ends
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        place, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.hashes[place[todo]] == 0]
            self.hashes[place[free]] = h[free]  # of two at one place the last stays
            mine = self.hashes[place[free]] == h[free]
            self.index[place[free[mine]]] = number[free[mine]]
            done = np.zeros(len(h), bool)
            done[free[mine]] = True
            todo = todo[~done[todo]]
            place[todo] = (place[todo] + 1) & (self.SLOTS - 1)


def unit_starts(texts: list[str], raw: list[bytes], buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units() begin in the texts' bytes, which stand in a row from `at` on."""
    new = buf == 32
    new[at[:-1][np.diff(at) > 0]] = True
    for i, t in enumerate(texts):
        if RUN.search(t):
            new[at[i] : at[i + 1]] = False
            sizes = [len(u) for u in UNIT.findall(t)] if len(raw[i]) == len(t) else [len(u.encode("utf-8", "replace")) for u in UNIT.findall(t)]
            new[at[i] + np.cumsum([0, *sizes[:-1]])] = True
    return np.flatnonzero(new)


#: Bytes up to which a chunk is hashed at once; longer ones, of one text, are split into units as strings.
HASHED = 8 << 20


def encode_chunk(texts: list[str], m, key: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, how many each text has, and whether they decode to its bytes.

    Units are told apart by hashes of 64 bits. If two that differ had the same, the text would not decode to itself: such
    a text is encoded once more without hashes.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    whole = b"".join(raw)
    at = np.cumsum([0, *map(len, raw)])
    if len(whole) > HASHED:
        each = encode_texts(texts, m, key)
        flat, size = np.frombuffer(b"".join(each), np.int32), np.array([len(x) // 4 for x in each], np.int64)
    else:
        known = common.kept(key, "known", Known)
        buf = np.frombuffer(whole, np.uint8)
        start = unit_starts(texts, raw, buf, at)
        end = np.append(start[1:], len(whole)) if len(start) else start
        h = common.word_hashes(buf, start, end) | np.uint64(1)
        found = known.find(h)
        begin, count = known.at[found], known.at[found + 1] - known.at[found]
        pool = known.ids
        miss = np.flatnonzero(found < 0)
        if len(miss):
            fresh, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            new = [whole[a:b].decode("utf-8") for a, b in zip(start[miss[first]].tolist(), end[miss[first]].tolist())]
            made = encode_units(new, m, common.memo(key, "words", MEMO))
            ids, ends = np.frombuffer(b"".join(made), np.int32), np.cumsum([len(x) // 4 for x in made])
            begin[miss] = len(pool) + ends[which] - np.diff(ends, prepend=0)[which]
            count[miss] = np.diff(ends, prepend=0)[which]
            pool = np.concatenate([pool, ids])
            known.add(fresh, ids, ends)
        ends = np.cumsum(count)
        flat = pool[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        size = np.diff(np.concatenate([[0], ends])[np.searchsorted(start, at)])
    same = np.ones(len(texts), bool)
    if decode_ids(flat, m) != whole:
        to = np.concatenate([[0], np.cumsum(size)])
        parts = [flat[to[i] : to[i + 1]] for i in range(len(texts))]
        for i, r in enumerate(raw):
            if decode_ids(parts[i], m) != r:
                parts[i] = np.frombuffer(encode_texts([texts[i]], m, key)[0], np.int32)
                same[i] = decode_ids(parts[i], m) == r
        flat, size = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return flat, size, same


def decode_ids(ids: np.ndarray, m) -> bytes:
    at = np.asarray(m["blob_at"])
    begin = at[ids]
    size = at[ids + 1] - begin
    ends = np.cumsum(size)
    return np.asarray(m["blob"])[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often the tokenizer's pattern yields each word, over all texts."""

    @common.tidied
    def run(batches):
        counter: Counter = Counter()  # whole units, and what stands behind a single space
        spaced: Counter = Counter()

        def flush():
            words: dict[str, int] = {}
            some, times = [*counter, *map(" ".__add__, spaced)], [*counter.values(), *spaced.values()]
            plain, odd = split_units(some)
            strange = [bool(odd) and _ODD.search(u) is not None for u in some]
            n, rest = 0, iter([n for n, x in zip(times, strange) if not x])
            for w in plain:
                if w == GAP:
                    n = next(rest)
                else:
                    words[w] = words.get(w, 0) + n
            for x, n in zip(odd, [n for n, x in zip(times, strange) if x]):
                for w in x:
                    words[w] = words.get(w, 0) + n
            counter.clear()
            spaced.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        held = 0
        for batch in batches:
            for text in batch.column(0):
                text, before = text.as_py() or "", len(counter) + len(spaced)
                if RUN.search(text):
                    counter.update(UNIT.findall(text))
                else:
                    first, *rest = text.split(" ")
                    counter[first] += 1
                    spaced.update(rest)
                if (new := len(counter) + len(spaced) - before):  # all the text's length counts: an upper bound
                    held += 160 * new + len(text)
                if held > COUNTED:
                    yield flush()
                    held = 0
        yield flush()

    return common.pick(docs, text=text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str, m, least_share: int = LEAST_SHARE) -> dict[bytes, bytes]:
    """Frequent words and their ids. The counts go to the shared folder, so that the corpus is counted once."""
    common.shared_dir(docs.sparkSession)
    counts = word_counts(docs, text_col).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = [r[0].encode() for r in counts.filter(F.col("n") * least_share >= total).select("word").toLocalIterator()]
    return dict(zip(words, merge_words(words, m)))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, least_share: int = LEAST_SHARE) -> DataFrame:
    """(id_col, n_tokens BIGINT, tokens ARRAY<INT>, lossless BOOLEAN): one row for each row of docs.

    lossless: the ids were decoded again and gave the text's bytes. A null text has nulls; an empty one has 0,
    an empty array and true. Null and repeated ids are passed on with their own rows. Texts are encoded whole,
    whatever their length. Other columns are not read, whatever their names; where id_col is called as one of the
    results is, that one gets an underscore. An empty table gives none.
    """
    spark = docs.sparkSession
    tables = merge_tables(read_ranks(vocab))
    model = common.Model(spark, "bpe", tables | transducer(lexicon(docs, text_col, tables, least_share)))

    @common.tidied
    def run(batches, model):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.chunks(texts):
                part = texts[a:b]
                flat, size, same = encode_chunk([t or "" for t in part], model, model.key)
                null = np.array([t is None for t in part])
                at = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, mask=null), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat), mask=pa.array(null)), pa.array(same, mask=null)],
                    names=["id", "n", "tokens", "lossless"],
                )

    done = common.pick(docs, id=id_col, text=text_col).mapInArrow(partial(run, model=model), f"id {common.kind(docs, id_col)}, n bigint, tokens array<int>, lossless boolean")
    return common.named(done, id_col, "n_tokens", "tokens", "lossless")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocab: str = VOCAB) -> DataFrame:
    """(id_col, text): the text of each row's ids; null ids give null, an empty array gives ''. Bytes that are not
    UTF-8, as after cutting an array, become replacement characters; an id outside the vocabulary is an error."""
    spark = encoded.sparkSession
    model = common.Model(spark, "bpe-decoder", {k: v for k, v in merge_tables(read_ranks(vocab)).items() if k.startswith("blob")})

    @common.tidied
    def run(batches, model):
        for batch in batches:
            texts = [None if x is None else decode_ids(np.array(x, np.int64), model).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    done = common.pick(encoded, id=id_col, tokens=tokens_col).mapInArrow(partial(run, model=model), f"id {common.kind(encoded, id_col)}, text string")
    return common.named(done, id_col, "text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(common.table(spark, sf_dir, "documents"))
