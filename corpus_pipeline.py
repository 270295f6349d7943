"""Corpus pipeline: quality rules, exact and near deduplication, mixing, encoding.

Each stage gets what the stage before kept, written as Parquet and read again, and all but the
last return the columns of ``documents``.  The mix repeats a row as often as it takes it, so the last
stage encodes repeated rows too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import fuse_dedup, mixing, pieces, quality_rules, shingle_links
from ridgeline.llm.common import table
from ridgeline.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half; others go."""
    return quality_rules.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id."""
    return fuse_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (Jaccard similarity of five-word shingles at least 0.8) the row with the smallest id."""
    return shingle_links.keep_one(docs, size=5, percent=80, seed=42)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3; whole epochs and a weighted sample for the rest."""
    return mixing.mixed_rows(docs, weights=(1, 2, 3), most=3.0, seed=7)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each row."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Fingerprints and token ids are beyond SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
