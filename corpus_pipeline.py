"""The corpus pipeline: five stages over documents, each written and read again by the next.

Language ID drops what it rejects, the n-gram Jaccard join keeps one document of each group,
the suffix array cuts repeated passages, mixing draws the sources to their target weights, and
byte-pair encoding turns the texts into tokens, which its decoder turns back into text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, jaccard, language, mixing, suffixes
from tidemark.settings import release, settle, work_paths

_made: list[str] = []


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose own work tables go when the next stage starts, as its result is written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _made)
        before = set(work_paths(spark))
        out = work(docs)
        _made[:] = [p for p in work_paths(spark) if p not in before]
        return out

    run_stage.__doc__ = work.__doc__
    return run_stage


def identify(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised; a missing lang is filled in."""
    return language.accepted(docs, language.train(docs, F.lit(False)))


def collapse(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs)


def cut_passages(docs: DataFrame) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier document holds."""
    return suffixes.clean_documents(docs)


def draw_mix(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), most=3.0)


def tokenise(docs: DataFrame) -> DataFrame:
    """Token ids of every text, and the digest of the text they decode to."""
    return bpe.training_rows(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", _stage(identify)),
    ("jaccard_join", _stage(collapse)),
    ("suffix_array_dedup", _stage(cut_passages)),
    ("mixing", _stage(draw_mix)),
    ("bpe", _stage(tokenise)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
