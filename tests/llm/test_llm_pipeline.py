"""The pipeline on awkward tables."""

from __future__ import annotations

import pytest
from fixtures import OTHER, SENTENCE, documents, no_documents, rows, with_clashes

import corpus_pipeline

LABELS = "doc_id bigint, quality int, toxic int"
ITEMS = "item_id bigint, text string"
GOOD = "Every morning the village baker walks slowly across the wide stone bridge, carrying warm bread for the children of the small school near river {}."


def written(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def some_documents(spark):
    """Awkward rows, among them some that every rule lets through, two near copies and one that holds a benchmark passage."""
    texts = [(100 + i, " ".join(f"{w}{i}" if k % 3 == 0 else w for k, w in enumerate(GOOD.split())).replace("{}", str(i))) for i in range(12)]
    texts += [(200, texts[0][1]), (201, texts[1][1] + " " + SENTENCE), (None, texts[2][1])]
    more = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], documents(spark).schema)
    return with_clashes(documents(spark).unionByName(more))


@pytest.mark.parametrize("case", ["all", "no labels or items", "all bad", "empty"])
def test_pipeline_on_awkward_tables(spark, tmp_path, case):
    docs = no_documents(spark) if case == "empty" else some_documents(spark)
    labels = [(i, 0 if case == "all bad" else 1, 0) for i in range(100, 112)] + [(None, 1, 0), (3, None, 0)]
    if case == "all":
        labels += [(8, 0, 0), (10, 0, 0), (11, 0, 0)]
    items = [(1, SENTENCE), (2, None), (None, OTHER)]
    if case == "no labels or items":
        labels, items = [], []
    folder = written(spark, tmp_path, docs, labels, items)
    given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = set(rows(kept)), corpus_pipeline.staged(stage(spark, kept, folder), f"test-{name}")
        assert kept.columns == given.columns and set(rows(kept)) <= before
    left = {r.doc_id for r in kept.collect()}
    if case in ("all bad", "empty"):
        assert not left
    else:
        # One of each pair of copies stays (the smaller id), the near copies of others do, and the passage goes if it is one.
        assert {100, 103} <= left and 200 not in left and None not in left
        assert (201 in left) == (case != "all")
    # Each stage is what the run does; the whole of it once.
    out = corpus_pipeline.run(spark, folder) if case == "all" else corpus_pipeline.tokens(spark, kept, folder)
    assert {r.doc_id for r in out.collect()} == left
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
