"""A training corpus from `documents`: quality, language, near duplicates, benchmark leaks, token ids.

Each stage reads what its predecessor wrote. run() writes the stages' results as Parquet to a folder of its own in the
shared folder that spark.checkpoint.dir names, so a lost executor costs no more than its tasks; a stage's input goes when
its result is written.

Rows may be null in any column, texts empty or of any length, rows repeated, columns besides those of documents have any
names: all stages but the last pass on all columns of the rows that they keep. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, common, decontamination, language_id, near_dedup, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that op6 rejects. Null and empty texts are judged by what else is known of them; equal rows
    have the same verdict; without labels of both kinds all stay."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that op7 rejects: null and empty texts and those without a letter go, and what no language
    explains; equal rows have the same verdict."""
    return language_id.keep_known_languages(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each of op8's classes, that of the least id (null is the greatest), and of a repeated row one. Null
    texts and those without a word are alike to none and stay."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak a test item by op3. Null and empty texts stay; equal rows have the same verdict."""
    return decontamination.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, lossless) by op5, a row for each row: decoding gave the text again where lossless. A null
    text has nulls, an empty one no tokens."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]
#: SQL can't express the stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. An empty table of documents gives none; nulls, long texts and repeated rows are as the
    stages say."""
    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
