"""Full text over chunks: phrases, all-terms, and BM25 order.

A chunk's tokens are an array made once, when it is indexed. A query is a conjunction of phrases; what it matches is
found by one scan with array functions that stay in the JVM, or by the postings, whose Parquet has runs sorted by term,
where they exist. Ranks are BM25 with k1 1.2 and b 0.75, a phrase counting as one term; the idf has a floor of 1e-6.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import tokens
from ..sources.shared import shared_dir

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_TERM = re.compile(r"\w+")
#: Tokens of which a task sorts the postings at a time.
RUN = 1 << 21


def phrase_of(query: str, stemmed: bool = True) -> list[list[str]]:
    """The query as one phrase; none if it has no token."""
    t = tokens(query, stemmed)
    return [t] if t else []


def terms_of(query: str, stemmed: bool = True) -> list[list[str]]:
    """Every word of the query; a word that splits into tokens is a phrase of them. None for less than two words, or if a
    word has no token at all (it matches nothing)."""
    words = [tokens(w, stemmed) for w in _TERM.findall(query)]
    return words if len(words) > 1 and all(words) else []


def count_phrase(toks: Column, phrase: list[str]) -> Column:
    """How often the tokens stand in a row."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    # The lambdas see elements alone: an expression for the tokens that stood in one would be evaluated for each element.
    hits = F.transform(toks, lambda t: t == phrase[0])
    for j, word in enumerate(phrase[1:], 2):
        hits = F.zip_with(hits, F.slice(toks, j, F.size(toks)), _and(word))
    return F.size(F.filter(hits, lambda h: h))


def _and(word: str):
    return lambda h, t: h & (t == word)


def has_all(toks: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(toks, w) for w in dict.fromkeys(words)])


def matches(chunks: DataFrame, phrases: list[list[str]], tokens_col: str = "tokens") -> DataFrame:
    """chunks that have every phrase, and tf ARRAY<INT>: how often each."""
    if not phrases:
        return chunks.filter(F.lit(False)).withColumn("tf", F.array().cast("array<int>"))
    hit = chunks.filter(has_all(F.col(tokens_col), [w for p in phrases for w in p]))
    counted = hit.withColumn("tf", F.array(*(count_phrase(F.col(tokens_col), p) for p in phrases)))
    return counted.filter(F.forall("tf", lambda n: n > 0))


def _rank(n_phrases: int, length: Column, digits: int | None) -> Column:
    """BM25 from tf, n, n0…, length (the mean) and a chunk's own length; less is better."""

    def part(i: int) -> Column:
        v = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(v > 0, v).otherwise(F.lit(LEAST_IDF))
        tf = F.element_at("tf", i + 1).cast("double")
        return idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("length"))))

    rank = -reduce(lambda a, b: a + b, [part(i) for i in range(n_phrases)])
    return rank if digits is None else F.round(rank, digits)


def counted(chunks: DataFrame, phrases: list[list[str]], id_col: str = "id", tokens_col: str = "tokens") -> tuple[DataFrame, int, float | None]:
    """(id, length, tf0, tf1, …) of chunks that have any of the phrases, how many chunks there are, and their mean length.

    One pass, in which the tokens are made once: numbers alone go to the shared folder, and the totals are observed on the way.
    """
    shared_dir(chunks.sparkSession)
    toks, seen = F.col(tokens_col), Observation()
    rows = chunks.select(F.col(id_col), tokens_col).select(id_col, F.size(toks).alias("own"), toks.isNotNull().alias("there"), *(F.coalesce(count_phrase(toks, p), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)))
    rows = rows.observe(seen, F.count_if("there").alias("n"), F.avg(F.when(F.col("there"), F.col("own")).cast("double")).alias("length"))
    hits = rows.filter(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(phrases))])).drop("there").checkpoint()
    return hits, seen.get["n"], seen.get["length"]


def ranked(hits: DataFrame, n: int, length: float | None, which: list[int], k: int, id_col: str = "id", digits: int | None = None) -> DataFrame:
    """(id, rank): the k best of counted() that have all the phrases of these numbers. The phrases' counts are a single row."""
    both = hits.select(id_col, "own", F.array(*(F.col(f"tf{i}") for i in which)).alias("tf"))
    stats = both.agg(F.lit(n).alias("n"), F.lit(length).cast("double").alias("length"), *(F.count_if(F.element_at("tf", j + 1) > 0).alias(f"n{j}") for j in range(len(which))))
    scored = both.filter(F.forall("tf", lambda t: t > 0)).crossJoin(F.broadcast(stats)).select(id_col, _rank(len(which), F.col("own"), digits).alias("rank"))
    return scored.orderBy("rank", id_col).limit(k)


def top_k(chunks: DataFrame, phrases: list[list[str]], k: int, id_col: str = "id", tokens_col: str = "tokens", digits: int | None = None) -> DataFrame:
    """The k best of matches() by `rank` (less is better), then id; without tokens and tf. Ids are unique."""
    rest = [c for c in chunks.columns if c != tokens_col]
    if not phrases:
        return chunks.select(rest).filter(F.lit(False)).withColumn("rank", F.lit(0.0))
    best = ranked(*counted(chunks, phrases, id_col, tokens_col), list(range(len(phrases))), k, id_col, digits)
    if rest == [id_col]:
        return best
    return chunks.select(rest).join(F.broadcast(best), id_col).select(*rest, "rank").orderBy("rank", id_col)  # k rows


def postings(chunks: DataFrame, id_col: str = "id", tokens_col: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, keep…, positions ARRAY<INT>, n_tokens): the inverted index, positions from 0; keep: columns that the id
    determines. Ids are unique. A chunk's rows are made where it is, nothing is shuffled: runs of chunks of about RUN tokens, each
    sorted by term."""
    fields = {f.name: f for f in chunks.schema.fields}
    kind = StructType([StructField("term", StringType()), fields[id_col], *(fields[c] for c in keep), StructField("positions", ArrayType(IntegerType())), StructField("n_tokens", IntegerType())])
    return chunks.select(id_col, *keep, tokens_col).mapInArrow(_runs(kind.names), kind)


def _runs(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), RUN), "right")
            for i, j in zip(at, [*at[1:], len(size)]):
                if j > i:
                    found = _run(batch.slice(i, j - i), size[i:j], names)
                    for k in range(0, found.num_rows, 1 << 16):
                        yield found.slice(k, 1 << 16)

    return run


def _run(batch: pa.RecordBatch, size: np.ndarray, names: list[str]) -> pa.RecordBatch:
    coded = batch.column(batch.num_columns - 1).flatten().dictionary_encode()
    by = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(by) + 1, np.int64)
    place[by], place[-1] = np.arange(len(by)), len(by)
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    key = place[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)] * len(size) + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    term, row = np.divmod(key[first], max(1, len(size)))
    terms = coded.dictionary.take(pa.array(by)).take(pa.array(term, mask=term == len(by)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([terms, *(batch.column(c).take(at) for c in range(batch.num_columns - 1)), lists, pa.array(size[row], pa.int32())], names=names)


def dictionary(chunks: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(term, documents, occurrences). Each chunk's tokens and different tokens are counted where they are, by term alone. Chunks
    whose id occurs more than once (they are looked for first) are put together by id."""
    ids = chunks.groupBy(id_col).agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col(id_col).alias("__id"))

    def each(some: DataFrame) -> DataFrame:
        toks = F.col(tokens_col)
        both = some.select(F.explode(F.array(F.struct(F.array_distinct(toks).alias("x"), F.lit(1).alias("d")), F.struct(toks.alias("x"), F.lit(0).alias("d")))).alias("s"))
        return both.select("s.d", F.explode("s.x").alias("term"))

    if ids.isEmpty():
        counted = each(chunks)
    else:
        again = F.col(id_col).eqNullSafe(F.col("__id"))
        whole = chunks.join(ids, again, "left_semi").groupBy(id_col).agg(F.flatten(F.collect_list(tokens_col)).alias(tokens_col))
        counted = each(chunks.join(ids, again, "left_anti")).union(each(whole))
    return counted.groupBy("term").agg(F.sum("d").alias("documents"), F.sum(1 - F.col("d")).alias("occurrences"))


def _lists(index: DataFrame, words: list[str], id_col: str) -> DataFrame:
    """(id, n_tokens, at MAP<term, positions>) of what has any of the words; the filter reaches the scan."""
    lists = [x for w in words for x in (F.lit(w), F.array_sort(F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions"))))))]
    found = index.filter(F.col("term").isin(words)).groupBy(id_col).agg(F.first("n_tokens").alias("n_tokens"), F.create_map(*lists).alias("at"))
    return found.withColumn("at", F.map_filter("at", lambda _, p: F.size(p) > 0))


def _times(phrase: list[str]) -> Column:
    def shifted(word: str, by: int) -> Column:
        return F.transform(F.element_at("at", word), lambda x: x - by)

    every = reduce(lambda a, b: a & b, [F.map_contains_key("at", w) for w in dict.fromkeys(phrase)])
    return F.when(every, F.size(reduce(F.array_intersect, [shifted(w, j) for j, w in enumerate(phrase)]))).otherwise(F.lit(0))


def match_postings(index: DataFrame, phrases: list[list[str]], id_col: str = "id") -> DataFrame:
    """(id, tf): matches() by the postings alone."""
    wanted = list(dict.fromkeys(w for p in phrases for w in p))
    if not wanted:
        return index.select(id_col, F.array().cast("array<int>").alias("tf")).filter(F.lit(False))
    hit = _lists(index, wanted, id_col).filter(F.size("at") == len(wanted))
    return hit.select(id_col, F.array(*map(_times, phrases)).alias("tf")).filter(F.forall("tf", lambda n: n > 0))


def top_k_postings(index: DataFrame, lengths: DataFrame, phrases: list[list[str]], k: int, id_col: str = "id", digits: int | None = None) -> DataFrame:
    """(id, rank): top_k() by the postings. lengths: (n_tokens), a row for each chunk; of the postings only the query's
    terms are read."""
    wanted = list(dict.fromkeys(w for p in phrases for w in p))
    if not wanted:
        return index.select(id_col, F.lit(0.0).alias("rank")).filter(F.lit(False))
    counted = _lists(index, wanted, id_col).select(id_col, "n_tokens", F.array(*map(_times, phrases)).alias("tf"))
    stats = lengths.agg(F.count("n_tokens").alias("n"), F.avg(F.col("n_tokens").cast("double")).alias("length")).crossJoin(
        counted.agg(*(F.count_if(F.element_at("tf", i + 1) > 0).alias(f"n{i}") for i in range(len(phrases))))
    )
    hit = counted.filter(F.forall("tf", lambda n: n > 0)).crossJoin(F.broadcast(stats))
    return hit.select(id_col, _rank(len(phrases), F.col("n_tokens"), digits).alias("rank")).orderBy("rank", id_col).limit(k)
