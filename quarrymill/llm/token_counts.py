"""Operator 1: token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each byte, longest first,
and dynamic programming carries only the best score and its number of pieces. Both run over all new words
of a chunk at once: a lane is a word, a step is a byte.

The vocabulary and its scores are read from a public SentencePiece file and used as a unigram model:
spaces become a mark, one is put before the text, a character without a piece of its own costs ten less
than the least score and yields its bytes. Rule for ties: at each end the longest piece is tried first and
only a strictly better score replaces it. No piece has a mark behind another character and none has a line
feed, so the best path of a text is that of its units (marks and the word behind them, or one line feed),
and each unit is solved once. Scores are added in doubles: whole numbers, hence exact.
"""

from __future__ import annotations

import re
from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

UNIT = re.compile(r" *[^ \n]+| +|\n")
UNK_PENALTY = 10.0
#: Bytes of units that a worker remembers. Only speed depends on it.
MEMO = 64 << 20


def vocabulary(path: str = f"{common.TOKENIZERS}/piece_bpe_32k.model") -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file and their scores."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (s.id_to_piece(i), s.get_score(i))
        for i in range(s.get_piece_size())
        if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))
    ]


def automaton(pieces: list[tuple[str, float]]) -> dict[str, np.ndarray]:
    """Aho-Corasick over UTF-8 bytes as a full table: next state, length and score of the longest piece that
    ends in a state (0: none), and the state of the next shorter one."""
    children: list[dict[int, int]] = [{}]
    length, score = [0], [0.0]
    for piece, s in pieces:
        at, raw = 0, piece.replace("▁", " ").encode()
        if not raw:
            continue
        for b in raw:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                length.append(0)
                score.append(0.0)
            at = children[at][b]
        length[at], score[at] = len(raw), s
    n = len(children)
    go, fail, shorter = np.zeros((n, 256), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    todo = deque([0])
    while todo:
        at = todo.popleft()
        row = go[fail[at]].copy() if at else go[0]
        for b, to in children[at].items():
            fail[to] = row[b] if at else 0
            row[b] = to
            todo.append(to)
        go[at] = row
        if at:
            f = fail[at]
            shorter[at] = f if length[f] else shorter[f]
    size = np.array(length, np.int32)
    return {"go": go, "length": size, "score": np.array(score), "shorter": shorter, "first": np.where(size > 0, np.arange(n), shorter).astype(np.int32),
            "unk": np.array([min((s for _, s in pieces), default=0.0) - UNK_PENALTY])}


def count_units(units: list[str], m) -> np.ndarray:
    """Pieces of each unit's best path; m: arrays of automaton()."""
    raw = [u.encode("utf-8", "replace") for u in units]
    size = np.array([len(r) for r in raw], np.int64)
    out = np.zeros(len(raw), np.int64)
    go, length, score, shorter, first, unk = (np.asarray(m[k]) for k in ("go", "length", "score", "shorter", "first", "unk"))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):  # lanes of about the same length, so that little is padded
        longest = max(8, int(size[order[at]]) * 5 // 4)
        end = min(int(np.searchsorted(size[order], longest, "right")), at + max(1, (1 << 22) // longest))
        lanes = order[at:end]
        at = end
        steps, n = int(size[lanes[-1]]), len(lanes)
        text = np.frombuffer(b"".join(raw[i].ljust(steps, b"\0") for i in lanes), np.uint8).reshape(n, steps).T
        best = np.full((steps + 1, n), -np.inf)
        count = np.zeros((steps + 1, n), np.int32)
        best[0] = 0
        state = np.zeros(n, np.int32)
        every = np.arange(n)
        opened = np.zeros(n, np.int64)  # start of the present character
        for i in range(steps):
            b = text[i]
            starts = (b & 0xC0) != 0x80
            opened[starts] = i
            state = go[state, b]
            ends = np.ones(n, bool) if i + 1 == steps else (text[i + 1] & 0xC0) != 0x80
            on, st, single = every, first[state], np.zeros(n, bool)
            while True:
                hit = st > 0
                on, st = on[hit], st[hit]
                if not len(on):
                    break
                begin = i + 1 - length[st]
                value = best[begin, on] + score[st]
                better = value > best[i + 1, on]
                who = on[better]
                best[i + 1, who] = value[better]
                count[i + 1, who] = count[begin[better], who] + 1
                single[on[begin == opened[on]]] = True
                st = shorter[st]
            who = every[ends & ~single]
            if len(who):
                begin = opened[who]
                value = best[begin, who] + unk[0]
                better = value > best[i + 1, who]
                who, begin = who[better], begin[better]
                best[i + 1, who] = value[better]
                count[i + 1, who] = count[begin, who] + (i + 1 - begin)
        out[lanes] = count[size[lanes], every]
    return out


def count_texts(texts: list[str | None], model, key: str = "") -> list[int | None]:
    memo = common.memo(key, "counts", MEMO)
    out: list[int | None] = []
    for a, b in common.chunks(texts):
        split = [None if t is None else UNIT.findall(" " + t.replace("▁", " ")) if t else [] for t in texts[a:b]]
        late = memo.learn({u for x in split if x for u in x}, lambda new: count_units(new, model).tolist(), lambda n: 8)
        out += [None if x is None else sum(map(memo.__getitem__, x)) for x in split]
        memo.forget(late)
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = f"{common.TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """(id_col, n_tokens BIGINT), one row for each row of docs, in one pass without a shuffle.

    A null text has null tokens, an empty one 0; texts of any length are counted whole. A null or repeated
    id is passed on with its own row. Columns other than the two are not read, whatever their names; an id column
    called n_tokens makes the counts n_tokens_. An empty table gives none.
    """
    spark = docs.sparkSession
    model = common.Model(spark, "unigram", automaton(vocabulary(vocab)))

    @common.tidied
    def run(batches, model):
        for batch in batches:
            counts = count_texts(batch.column(1).to_pylist(), model, model.key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n"])

    done = common.pick(docs, id=id_col, text=text_col).mapInArrow(partial(run, model=model), f"id {common.kind(docs, id_col)}, n bigint")
    return common.named(done, id_col, "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
