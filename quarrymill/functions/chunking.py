"""Recursive text chunks with forward overlap. Sizes are tokens of four UTF-16 units."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .batches import by_parts

#: Where a text may be cut, best first; None is its middle.
PLAIN: tuple[str | None, ...] = ("\n", ".。．", "?!", ";", ":", ",，、", ")]}", " ", "-", None)
MARKDOWN: tuple[str | None, ...] = (*PLAIN[1:9], "\n\r", None)
LINE_TOKENS, TOKENS_A_WORD = 100, 1.33

Counter = Callable[[str], int]


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def count(text: str) -> int:
    return units(text) >> 2


def _wide(text: str) -> str:
    """Each character beyond 16 bits as its two halves, so that indices are UTF-16 units."""
    return text if text.isascii() or max(text) <= "\uffff" else "".join(c if c <= "\uffff" else chr(0xD800 + (ord(c) - 0x10000 >> 10)) + chr(0xDC00 + (ord(c) - 0x10000 & 0x3FF)) for c in text)


def _narrow(text: str) -> str:
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _cut(text: str, separators: str | None) -> int:
    """Behind the separator closest to the middle; the last unit is no place to cut. The comparison is with the cut, that
    is the place behind the best separator so far (-1: none), so of two as close the earlier one stays."""
    half, best = len(text) // 2, -1
    if separators is None:
        return half
    if len(text) > 2:
        for m in _class(separators).finditer(text, 0, len(text) - 1):
            i = m.start()
            if abs(half - i) < abs(half - best):
                best = i + 1
            elif i > half:  # none behind it is closer
                break
    return best


@lru_cache(64)
def _class(separators: str) -> re.Pattern:
    return re.compile("[" + re.escape(separators) + "]")


def _halve(text: str, most: int, separators: str | None, trim: bool, tokens: Counter, out: list[str]) -> bool:
    """Puts the pieces into out; whether a piece is still too long. Pieces wait on a stack, so depth has no bound."""
    late, todo = False, [text]
    while todo:
        piece = todo.pop()
        if tokens(piece) > most:
            at = _cut(piece, separators)
            if at > 0:
                a, b = piece[:at], piece[at:]
                todo += [b.strip(), a.strip()] if trim else [b, a]
                continue
            late = True
        out.append(piece.strip() if trim else piece)
    return late


def split_lines(text: str, most: int, trim: bool, separators: tuple[str | None, ...] = PLAIN, tokens: Counter = count) -> list[str]:
    """Pieces of at most `most` tokens, cut at the best kind of separator that does it."""
    pieces = [text.replace("\r\n", "\n")]
    for kind in separators:
        out: list[str] = []
        late = [_halve(p, most, kind, trim, tokens, out) for p in pieces]
        pieces = out
        if not any(late):
            break
    return pieces


def paragraphs(lines: list[str], most: int, overlap: int, header: str | None = None, separators: tuple[str | None, ...] = PLAIN, tokens: Counter = count) -> list[str]:
    """Lines put together to paragraphs below `most` tokens, each followed by the first piece of the next one."""
    if most <= 0:
        raise ValueError("the size must be positive")
    if most <= overlap:
        raise ValueError("the overlap must be less than the size")
    room = most - overlap - (tokens(header) if header else 0)
    found: list[str] = []
    held = ""
    for line in (x for part in lines for x in split_lines(part.replace("\r\n", "\n").replace("\r", "\n"), room, False, separators, tokens)):
        if held:
            size = tokens(line) + 1
            if size >= room or size + tokens(held) >= room:
                found.append(held.strip())
                held = ""
        held += line + "\n"
    if held:
        found.append(held.strip())
    if len(found) > 1 and tokens(found[-1]) < room // 4:
        a, b = ([w for w in p.split(" ") if w] for p in found[-2:])
        if len(a) + len(b) <= room:
            found[-2:] = [" ".join(a + b)]
    out = []
    for i, p in enumerate(found):
        if overlap > 0 and i + 1 < len(found):
            p += " " + split_lines(found[i + 1], overlap, False, separators, tokens)[0]
        out.append((header or "") + p)
    return out


def chunk(text: str | None, size: int = 150, overlap: int = 30, header: str | None = None, separators: tuple[str | None, ...] = PLAIN, tokens: Counter | None = None) -> list[str]:
    """Chunks of about `size` words; none of a blank text."""
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be in [0, chunk size)")
    if not text or not text.strip():
        return []
    own = tokens is None
    lines = split_lines(_wide(text) if own else text, LINE_TOKENS, True, separators, tokens or (lambda t: len(t) >> 2))
    found = paragraphs(lines, int(size * TOKENS_A_WORD), int(overlap * TOKENS_A_WORD), header, separators, tokens or (lambda t: len(t) >> 2))
    return [_narrow(c) for c in found] if own else found


def markdown_lines(text: str, most: int, tokens: Counter = count) -> list[str]:
    """Trimmed pieces of markdown, in which a line's end is the last place to cut at."""
    return split_lines(text, most, True, MARKDOWN, tokens)


def markdown_paragraphs(lines: list[str], most: int, overlap: int = 0, header: str | None = None, tokens: Counter = count) -> list[str]:
    return paragraphs(lines, most, overlap, header, MARKDOWN, tokens)


def chunks(text: Column, size: int = 150, overlap: int = 30, header: str | None = None, separators: tuple[str | None, ...] = PLAIN) -> Column:
    """chunk() of a column, an array; sizes are checked when the plan is made."""
    chunk("x", size, overlap)

    @F.arrow_udf(ArrayType(StringType()))
    def run(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return by_parts(lambda part: pa.array([chunk(t, size, overlap, header, separators) for t in part.to_pylist()], kind), kind, x)

    return run(text)
