"""The pipeline against its operators' verdicts and a public encoder, on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import common, decontamination, language_id, near_dedup, quality

from .test_operators import DATA, reference_bpe


def test_stages_do_what_the_operators_say(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = common.table(spark, DATA, "documents")
    good = {r.doc_id for r in quality.score_quality(docs, common.table(spark, DATA, "labels")).filter("keep").collect()}
    docs = docs.filter(docs.doc_id.isin(list(good)))
    known = {r.doc_id for r in language_id.identify_language(docs).filter("keep").collect()}
    docs = docs.filter(docs.doc_id.isin(list(known)))
    copies = {r.doc_id for r in near_dedup.near_duplicates(docs).filter("NOT kept").collect()}
    left = docs.filter(~docs.doc_id.isin(list(copies)))
    leaks = {r.doc_id for r in decontamination.benchmark_leaks(left, common.table(spark, DATA, "benchmark")).collect()}
    want = {r.doc_id: r.text for r in left.collect() if r.doc_id not in leaks}
    enc = reference_bpe()
    assert set(got) == set(want) and 100 < len(got) < 200 and leaks and copies
    assert all(got[i].tokens == enc.encode_ordinary(t) and got[i].lossless for i, t in want.items())


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "bpe"]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the a of and to in is it was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()


def good(seed, n=70):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, an empty table."""
    rows = [(i, good(i), "en", "src1", 80) for i in range(30)]
    rows += [(100, None, "en", "src1", 3), (101, "", "en", None, None), (None, good(50), None, "src2", 5), (102, good(51), "en", "src1", 5), (102, good(51), "en", "src1", 5)]
    rows += [(103, good(52, 400_000), "en", "src1", 9), (104, "\x00 12 \t", "en", "src1", 1)]
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "What is the name of the test? It is none of these."), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    names = [*docs.columns, "TEXT", "rid", "c0", "tokens", "__quarrymill_n"]
    docs = docs.select("*", *(F.lit("clash") for _ in names[5:])).toDF(*names)
    out = stage(spark, docs, str(tmp_path))
    got = sorted((r[0] is None, r[0] or 0) for r in out.collect())
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert out.columns == (["doc_id", "n_tokens", "tokens", "lossless"] if last else names)
    everything = sorted((r[0] is None, r[0] or 0) for r in rows)
    gone = {"keep_known_languages": [(False, 100), (False, 101), (False, 104)], "keep_one_of_each_group": [(False, 102)]}.get(stage.__name__, [])
    for x in gone:
        everything.remove(x)
    assert got == everything
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
