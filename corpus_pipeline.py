"""A training-data pipeline over ``documents``: bad texts, near copies and benchmark leaks go, the rest is tokenised.

``STAGES`` are functions of (spark, docs, sf_dir); each takes what the one before it kept. All but the last return the columns
of ``documents``; the last returns the tokens.

Rows: other columns, also such with names that the operators use, come through all stages but the last as they are. Null and empty texts are scored
and judged like any (the rules reject them); rows without an id take part and are never learnt from. Repeated rows are copies, of which
one stays. Without labels the classifier gives one score to all and rejects none, and with labels of one kind it
keeps or rejects all; without a benchmark nothing leaks. A stage that keeps nothing, or an empty table, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almoner.llm import decontamination, jaccard_join, quality_fm, quality_rules, sentencepiece_codec
from almoner.llm.common import staged
from almoner.llm.queries import table, tokenizer_model


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows among ``docs`` and drops what it scores as bad."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.keep_good(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, tokenizer_model(), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", tokens),
]

# The classifier, the similarity join and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
