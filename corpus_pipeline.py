"""Corpus pipeline over ``documents``: quality rules, language identification,
near-duplicates, mixing, encoding. Each stage calls one operator of
``editlake.llm`` on all rows that the stage before kept; all but the last
return the columns of ``documents``.

Defined results: a text that the quality rules reject, one without a language
(no letter) or with a best language under ``MIN_SCORE`` goes (if no row is
labelled, only texts without a letter go); of each group of near-duplicates the
row of the smallest id stays; the mix repeats or drops rows to meet its sources'
targets; the last stage has one line per row of the mix. An empty table passes
through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlake.llm import byte_bpe, language, mixing, quality, simhash
from editlake.llm.common import documents, drop_folder, new_folder

#: With L languages a best share lies above 1 / L; only texts that fit none go.
MIN_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("quality.kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs, language.may_learn())
    if model is None:  # no row has a language: nothing to judge by, so only texts without a letter go
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identify(docs, model)
    fits = (F.col("language.lang_pred") != language.UNKNOWN) & (F.col("language.score") >= MIN_SCORE)
    return found.where(fits).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=4, max_bits=4, seed=42)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: The language model, XXH64 fingerprints and BPE are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage returns is written to the
    cluster's shared folder and read again, so no stage is computed twice. Only
    the last folder outlives the call: the result is read from it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
