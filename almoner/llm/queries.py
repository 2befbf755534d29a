"""The operators as queries over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almoner.llm import (
    cover_tree,
    decontamination,
    hard_negatives,
    html_consensus,
    jaccard_join,
    language_id,
    lm_bloom,
    quality_fm,
    quality_rules,
    sentencepiece_codec,
    sharding,
    spelling_groups,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_model(path: str | None = None) -> bytes:
    """The bytes of a SentencePiece model file; the public one if none is named."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_model())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score_corpus(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "group_size")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "equal_tokens", "overlap_tokens")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.link_vectors(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (
        op1_sentencepiece,
        op2_quality_classifier,
        op3_url_filter,
        op4_html_extraction,
        op5_sharding,
        op6_quality_rules,
        op7_lm_scoring,
        op8_jaccard_join,
        op9_decontamination,
        op10_language_id,
        op11_embedding_dedup,
        op12_hard_negatives,
        op13_spelling_groups,
    )
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": sharding.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op11_embedding_dedup": cover_tree.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
    }
