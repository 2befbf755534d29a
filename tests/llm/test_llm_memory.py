"""What stays in a Python worker between the stages of the pipeline, and how large the rows are that hold many tokens."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from almoner.llm import common, lm_bloom, quality_fm


def test_fit_starts_no_python_worker(spark, monkeypatch):
    """Rows dealt out from the driver's Python come back through a worker of another kind, which stays beside those of the stages."""

    def refused(*args, **kwargs):
        raise AssertionError("rows were dealt out by Python")

    docs = spark.sql("SELECT id AS doc_id, concat('words of row ', id, if(id % 2 = 0, ' are fine', ' ## ##')) AS text FROM range(60)").cache()
    labels = spark.sql("SELECT id AS doc_id, CAST(1 - id % 2 AS INT) AS quality FROM range(60)").cache()
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    model = quality_fm.train(docs, labels)
    assert model.linear is not None and model.score("words of row 8 are fine", None) > model.score("words of row 9 ## ##", None)


def test_workers_give_arrow_memory_back(spark, monkeypatch):
    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)
    run = common.map_batches(frame, lambda batches: (b.slice(1) for b in batches), "n bigint")
    released = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(True)))
    batches = [pa.RecordBatch.from_pydict({"n": [i, i + 1]}) for i in range(3)]
    assert [b.to_pydict()["n"] for b in run(iter(batches))] == [[1], [2], [3]]
    assert released == [True]


@pytest.mark.parametrize("lower", [False, True])
def test_hash_tables_are_small_and_pieces_do_not_matter(monkeypatch, lower):
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = [f"Word{i} " * 3 + "\n" * (i % 3) + "x" * (i % 50) for i in range(20_000)] + [None, "", "y" * (3 * common.PIECE_BYTES)]
    found, counts = common.word_hashes(texts[:-1], lower)
    assert sum(table.nbytes for table in common._powers) <= 2 << 20
    long, n = common.word_hashes(texts, lower)
    monkeypatch.setattr(common, "PIECE_BYTES", 1 << 20)
    whole, again = common.word_hashes(texts, lower)
    assert len(found) > 60_000 and (long == whole).all() and (n == again).all()
    assert (whole[: len(found)] == found).all() and (again[:-1] == counts).all()


def test_no_row_of_the_language_model_holds_a_whole_chunk(spark, monkeypatch):
    """Spark and Arrow hold rows whole, and several of them at once."""
    kept = {}

    def staged(df, purpose, *options):
        kept[purpose] = common.staged(df, purpose, *options)
        return kept[purpose]

    monkeypatch.setattr(lm_bloom, "staged", staged)
    words = "array_join(transform(sequence(1, 10000), i -> concat('w', (i * (id + 1)) % 30011)), ' ')"
    docs = spark.sql(f"SELECT id AS doc_id, {words} AS text FROM range(40)").coalesce(1)
    scores = lm_bloom.score_corpus(docs).agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    assert tuple(scores) == (400_040, 40)
    tokens = [sum(r["size"]) for r in kept["lm-chunks"].select("size").collect()]
    assert sum(tokens) == 400_040 and max(tokens) <= 1 << 18


def test_a_chunk_read_by_many_tasks_scores_the_same(spark, monkeypatch):
    text = "if(id % 17 = 3, null, array_join(transform(sequence(0, id % 13), i -> concat('W', (i * id) % 29)), ' '))"
    docs = spark.sql(f"SELECT if(id % 19 = 5, null, id % 150) AS doc_id, {text} AS text FROM range(200)").coalesce(2).cache()
    expected = sorted(map(repr, lm_bloom.score_corpus(docs).collect()))
    kept = {}

    def staged(df, purpose, *options):
        kept[purpose] = common.staged(df, purpose, *options)
        return kept[purpose].repartition(7) if purpose == "lm-chunks" else kept[purpose]

    monkeypatch.setattr(lm_bloom, "staged", staged)
    monkeypatch.setattr(lm_bloom, "PIECE_TOKENS", 40)
    assert sorted(map(repr, lm_bloom.score_corpus(docs).collect())) == expected
    chunks, pieces = kept["lm-chunks"].agg(F.countDistinct("chunk"), F.count(F.lit(1))).first()
    runs = kept["lm-answers"].select("chunk", "run").distinct().count()
    assert chunks == 2 < runs <= pieces
