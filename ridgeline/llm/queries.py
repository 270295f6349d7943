"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import (
    bk_simhash,
    entropy_scan,
    fuse_dedup,
    katz,
    lemp_search,
    mixing,
    phrase_automata,
    pieces,
    quality_rules,
    shard_tree,
    site_suffixes,
    token_counts,
    zstd_quality,
)
from ridgeline.llm.common import held_out, table

#: Vocabulary files are parameters of the operators; these are the ones the queries use.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Words and up to two predecessors; the order is a parameter of the operator."""
    docs = table(spark, folder, "documents")
    scored, _ = katz.train_and_score(docs, order=3, is_held_out=katz.crc32_held_out(7, 2))
    return scored


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_tree.shard(table(spark, folder, "documents"), shard_tree.tree(8))
    return placed.withColumn("law", F.lit("key"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(BYTE_MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), weights=(1, 2, 3), most=3.0, seed=7)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fuse_dedup.deduplicate(table(spark, folder, "documents"), batches=3)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return entropy_scan.report(table(spark, folder, "documents"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from labelled rows that are not held out, at most 1,500 of each label."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = zstd_quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), per_label=1500)
    scored = zstd_quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return bk_simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4, seed=42)


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lemp_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=20)


def op12_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return site_suffixes.extract(table(spark, folder, "pages"), words=8, share=10)


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_automata.collocations(table(spark, folder, "documents"), least=10, share=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash": op10_simhash,
    "op11_lexical_search": op11_lexical_search,
    "op12_page_text": op12_page_text,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {
    "op4_sharding": shard_tree.oracle(8),
    "op6_mixing": mixing.ORACLE,
    "op7_exact_dedup": fuse_dedup.ORACLE,
    "op11_lexical_search": lemp_search.ORACLE,
    "op13_phrases": phrase_automata.ORACLE,
}
