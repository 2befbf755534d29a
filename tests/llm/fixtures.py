"""Awkward rows for every operator: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SENTENCE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree near our house today"
OTHER = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix vingt trente cent"
ROWS = [
    (1, SENTENCE, "en", "a", len(SENTENCE)),
    (2, SENTENCE, "en", "a", len(SENTENCE)),
    (2, SENTENCE, "en", "a", len(SENTENCE)),
    (3, SENTENCE + " indeed", "en", "b", None),
    (4, OTHER, "fr", None, 5),
    (5, None, "fr", "b", None),
    (6, "", None, "b", 0),
    (6, "", None, "b", 0),
    (7, " \n\t ", "en", "b", 4),
    (8, "1234 ### $$$", "en", "b", 12),
    (9, "Été 日本語 \x00 emoji 😀 \u00a0 end", None, "c", 20),
    (None, OTHER + " fin", "fr", "c", 7),
    (None, None, None, None, None),
    (10, "x" * 50_000, "en", "c", 50_000),
    (11, "word " * 30_000, "en", "c", 150_000),
    (12, "\n".join([SENTENCE, OTHER] * 4), "en", "c", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "score class n h seed work ledger row kept key id copies bucket shard word host path label size held_out listed_id".split()


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(2)


def with_clashes(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.lit(name) for name in CLASHING})


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows(df: DataFrame) -> list[str]:
    return sorted(map(repr, df.collect()))
