"""Each operator on awkward rows: a row for every row, other columns without influence, empty tables."""

from __future__ import annotations

import pyarrow as pa
import pytest
from fixtures import OTHER, ROWS, SENTENCE, documents, no_documents, rows, with_clashes

from almoner.llm import decontamination, jaccard_join, language_id, lm_bloom, quality_fm, quality_rules, sharding
from almoner.llm import common, html_consensus, sentencepiece_codec, url_filter
from almoner.llm.queries import tokenizer_model


def _labels(spark, given=((1, 1), (2, 1), (2, None), (3, 1), (4, 1), (8, 0), (9, 0), (11, 0), (None, 1))):
    return spark.createDataFrame([(i, q, 0) for i, q in given], "doc_id bigint, quality int, toxic int")


def _benchmark(spark):
    items = [(1, SENTENCE), (1, SENTENCE), (2, None), (3, ""), (4, "too short"), (None, OTHER)]
    return spark.createDataFrame(items, "item_id bigint, text string")


OPERATORS = {
    "sentencepiece": lambda d: sentencepiece_codec.encode_documents(d, tokenizer_model()),
    "quality_fm": lambda d: quality_fm.classify(d, _labels(d.sparkSession)),
    "sharding": sharding.shard_documents,
    "quality_rules": quality_rules.judge,
    "lm_bloom": lm_bloom.score_corpus,
    "jaccard_join": jaccard_join.join_similar,
    "language_id": language_id.identify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    operator = OPERATORS[name]
    plain = operator(documents(spark))
    assert sorted(map(str, (r["doc_id"] for r in plain.collect()))) == sorted(str(r[0]) for r in ROWS)
    assert rows(operator(with_clashes(documents(spark)))) == rows(plain)
    empty = operator(no_documents(spark))
    assert empty.columns == plain.columns and empty.count() == 0


def test_decontamination_edges(spark):
    found = lambda d: decontamination.find_overlaps(d, _benchmark(spark)).select("doc_id", "item_id")
    expected = sorted(
        map(repr, [(1, 1), (2, 1), (2, 1), (3, 1), (4, None), (None, None), (12, 1), (12, None)])
    )
    assert sorted(repr(tuple(r)) for r in found(documents(spark)).collect()) == expected
    assert rows(found(with_clashes(documents(spark)))) == rows(found(documents(spark)))
    assert found(no_documents(spark)).count() == 0
    none = _benchmark(spark).limit(0)
    assert decontamination.find_overlaps(documents(spark), none).count() == 0


FILTERS = {
    "quality_fm": lambda d: quality_fm.keep_good(d, quality_fm.train(d, _labels(d.sparkSession))),
    "quality_rules": quality_rules.keep_good,
    "jaccard_join": jaccard_join.drop_near_copies,
    "decontamination": lambda d: decontamination.drop_contaminated(d, _benchmark(d.sparkSession)),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_return_the_rows_as_they_came(spark, name):
    for given in (documents(spark), with_clashes(documents(spark))):
        kept = FILTERS[name](given)
        assert kept.schema.simpleString() == given.schema.simpleString()
        assert set(rows(kept)) <= set(rows(given)) and kept.count()
    assert FILTERS[name](no_documents(spark)).count() == 0


def test_near_copies_keep_the_smallest_id_once(spark):
    kept = [r["doc_id"] for r in jaccard_join.drop_near_copies(documents(spark)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 4, 5, 6, 6, 7, 8, 9, None, 10, 11, 12]))


PAGES = [
    (1, "https://a.com/x", "<article><p>one two</p></article><footer>f</footer>"),
    (2, None, None),
    (3, "no scheme", ""),
    (4, "http://", "<p>a<p>b"),
    (None, "HTTP://WWW.Example.COM/en/1?q#f", "<div class=content><p>x &amp; y&nbsp;z</div>"),
    (1, "https://a.com/x", "<article><p>one two</p></article><footer>f</footer>"),
    (6, "https://a.com:80", "<b>" * 3000 + "deep"),
    (7, "ftp://x.net/es/\n1", "a < b &notanentity; <unclosed"),
]


@pytest.mark.parametrize("operator", [url_filter.judge, html_consensus.extract])
def test_pages(spark, operator):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    plain = operator(pages)
    assert sorted(str(r["page_id"]) for r in plain.collect()) == sorted(str(p[0]) for p in PAGES)
    assert rows(operator(with_clashes(pages))) == rows(plain)
    assert operator(pages.limit(0)).count() == 0


def test_constant_and_missing_labels(spark):
    docs = documents(spark)
    for given, score in (((), 0.5), (((1, 1), (3, 1)), 1.0), (((1, 0), (3, 0)), 0.0)):
        got = {round(r["score"], 3) for r in quality_fm.classify(docs, _labels(spark, given)).collect()}
        assert got == {score}


def test_und(spark):
    answers = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(documents(spark)).where("doc_id IS NOT NULL").collect()}
    assert [i for i, (lang, _) in answers.items() if lang == "und"] == [5, 6, 7, 8]
    assert all(0 <= score <= 1 for _, score in answers.values())


def test_a_short_item_repeated_in_a_long_text(spark):
    """40,000 times one word, which is an item, and items of two and three of it: a row for each, not for each place."""
    docs = spark.createDataFrame([(1, "the " * 40_000), (2, "of the sea"), (2, "of the sea"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the the"), (3, "The, the: the"), (4, "sea")], "item_id bigint, text string")
    found = decontamination.find_overlaps(docs, items).select("doc_id", "item_id", "shift", "equal_tokens").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0, 1), (1, 2, 0, 2), (1, 3, 0, 3), (2, 1, 1, 1), (2, 1, 1, 1), (2, 4, 2, 1), (2, 4, 2, 1)]


def test_an_over_long_labelled_text_does_not_change_the_model(spark, monkeypatch):
    monkeypatch.setattr(quality_fm, "SAMPLE_CHARS", 20_000)
    texts = [(i, f"{SENTENCE} number {i}" if i % 2 else f"zz ## {i} !! zz ## zz", "en", "a", 1) for i in range(200)]
    texts += [(i, "very long " * 5_000, "en", "a", 1) for i in range(200, 230)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(230)], "doc_id bigint, quality int, toxic int")
    model = quality_fm.train(docs, labels)
    assert model.linear is not None
    scores = [(i, model.score(t, None)) for i, t, *_ in texts[:200]]
    assert min(s for i, s in scores if i % 2) > max(s for i, s in scores if not i % 2)


def test_scores_are_sums_over_pairs():
    """The margin in linear time is that of every pair of features."""
    import numpy as np

    rng = np.random.default_rng(1)
    model = quality_fm.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    for n in (0, 1, 2, 9):
        index, value = rng.choice(50, n, replace=False), rng.normal(size=n)
        pairs = sum(model.vectors[index[i]] @ model.vectors[index[j]] * value[i] * value[j] for i in range(n) for j in range(i))
        assert np.isclose(model.margin(index, value), 0.3 + model.linear[index] @ value + pairs)


def test_urls_of_one_class_without_words(spark):
    pages = spark.createDataFrame([(1, "http://casino.net/", ""), (2, None, ""), (3, "x", "")], "page_id bigint, url string, html string")
    assert sorted(r.page_id for r in url_filter.judge(pages).collect()) == [1, 2, 3]


def test_deep_pages_and_pages_of_links_only():
    import tracemalloc

    linked = html_consensus.Page("<body><nav>x</nav><article><p><a href=x>All of it</a></p></article></body>")
    assert linked.text(None) == "All of it"
    for tag in ("div", "font"):
        tracemalloc.start()
        page = html_consensus.Page(f"<article><p>{SENTENCE}</p>" + f"<{tag} class='a b'>x " * 16_000)
        text = page.text(max(page.votes(), key=page.votes().get))
        assert text.startswith(SENTENCE) and tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.stop()


def test_batches_are_bounded_by_bytes(spark):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    setting, texts = "spark.sql.execution.arrow.maxBytesPerBatch", [(i, "x" * 100_000) for i in range(120)]
    before = spark.conf.getAll.get(setting)
    documents = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    try:
        for given, largest in ((None, common.BATCH_BYTES), ("1000000", 1_000_000)):
            spark.conf.unset(setting) if given is None else spark.conf.set(setting, given)
            sizes = common.map_batches(documents, batch_sizes, "n bigint").collect()
            assert len(sizes) > 1 and max(r.n for r in sizes) < largest + 200_000  # a session's own bound is left alone
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
