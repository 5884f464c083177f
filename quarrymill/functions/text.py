"""Search text: query syntax, full-text tokens with Porter stems, highlighting."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .batches import by_parts, parts, tidy

SITE = r"(^|\s)[sS][iI][tT][eE]:(\S+)"


@dataclass(frozen=True)
class Query:
    """The free text of a query, and the hosts of its site: tokens."""

    text: str
    sites: tuple[str, ...]


def site_host(token: str) -> str:
    """The host of a site: token: scheme, path and port cut off, dots around it too. ('' if nothing is left.)"""
    rest = token.partition("://")[2] if "://" in token else token
    return rest.partition("/")[0].partition(":")[0].strip(".").lower()


def parse_query(query: str | None) -> Query:
    """site: counts only at a token's start and with something behind it; a token whose host is empty filters nothing."""
    sites: list[str] = []

    def take(m: re.Match) -> str:
        if h := site_host(m[1]):
            sites.append(h)
        return " "

    rest = re.sub(r"(?:(?<=\s)|^)site:(\S+)", take, query or "", flags=re.I)
    return Query(" ".join(rest.split()), tuple(sites))


def query_text(query: Column) -> Column:
    """parse_query().text of a column."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"(?<=^|\s)(?i:site):\S+", " "), r"(?U)\s+", " "))


def query_sites(query: Column) -> Column:
    """parse_query().sites of a column."""
    found = F.regexp_extract_all(query, F.lit(r"(?<=^|\s)(?i:site):(\S+)"), F.lit(1))

    def site(t: Column) -> Column:
        rest = F.regexp_replace(t, r"^.*?://", "")
        return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "/.*$", ""), ":.*$", ""), r"^\.+|\.+$", ""))

    return F.filter(F.transform(found, site), lambda h: h != "")


def collapse(text: Column) -> Column:
    """Runs of space, tab, line feed and carriage return become one space; those at the ends go. Others stay."""
    return F.btrim(F.regexp_replace(text, "[ \\n\\r\\t]+", " "))


# Porter's stemmer (Porter 1980), for tokens of 3 to 64 bytes as full-text indexes use it.

_VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWELS and (c != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(">")) for x in text.split()]


_STEP2 = _pairs("ational>ate tional>tion enci>ence anci>ance izer>ize logi>log bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble")
_STEP3 = _pairs("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replace(w: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


@lru_cache(1 << 17)
def stem(w: str) -> str:
    if not w.isascii():  # the rules see bytes; those beyond ASCII are consonants
        raw = w.encode("utf-8", "replace")
        return _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore") if 3 <= len(raw) <= 64 else w
    return _stem(w) if 3 <= len(w) <= 64 else w


def _stem(w: str) -> str:
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _STEP2)
    w = _replace(w, _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
                w = left
            break
    if w.endswith("e"):
        left = w[:-1]
        m = _measure(left)
        if m > 1 or m == 1 and not _cvc(left):
            w = left
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_ASCII = re.compile(r"[0-9a-z]+")
#: Letters and digits of any kind, and characters of private use.
_WORD = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    """Runs of letters and digits of any script, lower-case, without diacritics, stemmed."""
    if not text:
        return []
    if text.isascii():
        found = _ASCII.findall(text.lower())
    else:
        flat = unicodedata.normalize("NFD", text.lower())
        if marks := "".join(sorted(c for c in set(flat) if unicodedata.category(c) == "Mn")):
            flat = re.sub(f"[{marks}]", "", flat)
        found = _WORD.findall(flat)
    return [stem(t) for t in found] if stemmed else found


@F.arrow_udf(ArrayType(StringType()))
def token_array(text: pa.Array) -> pa.Array:
    """tokens() of a column; null for null."""
    kind = pa.list_(pa.string())
    return by_parts(lambda x: pa.array([None if t is None else tokens(t) for t in x.to_pylist()], kind), kind, text)


def stem_counts(texts: DataFrame) -> DataFrame:
    """(stem, times) of a column of texts. A worker counts the words of some texts before it stems each of them once."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(0, batch.num_rows, 2048):
                words: Counter[str] = Counter()
                for (x,) in parts(batch.column(0).slice(i, 2048)):
                    for t in x.to_pylist():
                        words.update(tokens(t, False))
                stems: dict[str, int] = {}
                for w, n in words.items():
                    s = stem(w)
                    stems[s] = stems.get(s, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(list(stems), pa.string()), pa.array(list(stems.values()), pa.int64())], names=["stem", "n"])
                del words, stems
            tidy()

    return texts.mapInArrow(run, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("times"))


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of word characters, without stems; in the JVM alone."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1))


STOP = frozenset("a an and are as at be by for from in is it of on or that the to with".split())


def highlight(text: Column, query: str) -> Column:
    """Words of the raw query in <mark>, without case; words of one letter and frequent ones are left alone."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 1 and w not in STOP]
    if not words:
        return text
    either = "|".join(re.escape(w).replace("/", r"\/") for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"(?iu)({either})", "<mark>$1</mark>")
