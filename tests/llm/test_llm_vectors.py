"""Near-duplicate vectors, hard negatives and spelling variants against brute force, and on awkward rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from almoner.llm import cover_tree, hard_negatives, spelling_groups

VECTORS = "vec_id bigint, embedding array<float>, label int"
CLASHING = "node cell block group copies k1 k2 links component part dim k score positive wanted anchors word n form run h home".split()


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(name) for name in CLASHING if name not in df.columns})


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- cover trees --------------------------------------------------------------


def groups_of(vectors, threshold=cover_tree.THRESHOLD):
    """Links and smallest linked id of (id, vector) pairs, pair by pair."""
    ids = [i for i, _ in vectors]
    raw = np.array([v for _, v in vectors], np.float64)
    cosine = (raw @ raw.T) / np.sqrt((raw * raw).sum(1)[:, None] * (raw * raw).sum(1)[None, :])
    near = cosine >= threshold
    np.fill_diagonal(near, False)
    group = list(range(len(ids)))
    for _ in ids:
        group = [min([group[i], *(group[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    least = {g: min(ids[i] for i in range(len(ids)) if group[i] == g) for g in set(group)}
    return sorted((ids[i], int(near[i].sum()), least[group[i]], ids[i] == least[group[i]]) for i in range(len(ids)))


def clustered(n, dim, seed):
    """Vectors of clusters of very different width, some equal, and some far from all."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    width = np.array([0.0, 0.01, 0.05, 0.1, 0.2, 1.0])
    pick = rng.integers(0, 6, n)
    out = centres[pick] + rng.normal(size=(n, dim)) * width[pick][:, None]
    return (out * rng.uniform(0.5, 3, n)[:, None]).astype(np.float32)


@pytest.mark.parametrize("dim,seed", [(2, 1), (8, 2), (33, 3)])
def test_a_tree_covers_its_points(dim, seed):
    points = cover_tree.unit(clustered(700, dim, seed))
    tree, order = cover_tree.build(points)
    assert sorted(order) == list(range(700)) and np.allclose(points[order], tree.points)
    for k in range(len(tree.start)):
        inside = tree.points[tree.start[k] : tree.end[k]].astype(float)
        centre = tree.points[tree.centre[k]].astype(float)
        assert np.sqrt(((inside - centre) ** 2).sum(1)).max() <= tree.radius[k] + 1e-6
        assert tree.start[k] <= tree.centre[k] < tree.end[k]
        children = range(tree.first[k], tree.last[k])
        if tree.end[k] - tree.start[k] == 1:
            assert not children
            continue
        assert len(children) > 1
        # Children share the points out, nested levels keep the centre, and radii halve.
        assert [tree.start[c] for c in children] == [tree.start[k], *(tree.end[c] for c in children)][:-1]
        assert any(tree.centre[c] == tree.centre[k] for c in children)
        power = 2.0 ** np.ceil(np.log2(tree.radius[k]))
        assert all(tree.radius[c] <= power / 2 + 2 * np.sqrt(2 * cover_tree._slack(dim)) for c in children)


@pytest.mark.parametrize("small", [1, 64])
@pytest.mark.parametrize("dim,seed", [(2, 4), (8, 5), (33, 6)])
def test_traversals_count_every_pair(dim, seed, small, monkeypatch):
    monkeypatch.setattr(cover_tree, "SMALL", small)
    raw = clustered(400, dim, seed)
    ids, copies = np.arange(400), np.ones(400, np.int64)

    def block(part):
        tree, order = cover_tree.build(cover_tree.unit(raw[part]))
        return cover_tree.Block(ids[part][order], copies[part][order], raw[part][order], tree)

    whole = block(ids)
    label = cover_tree.Traversal(whole, whole).run()
    expected = {i: (n, g) for i, n, g, _ in groups_of(list(zip(ids.tolist(), raw)))}
    assert {i: n for i, n in zip(whole.ids.tolist(), whole.links().tolist())} == {i: n for i, (n, _) in expected.items()}
    least = {}
    for i, at in zip(whole.ids.tolist(), label.tolist()):
        least[at] = min(least.get(at, i), i)
    assert {i: least[at] for i, at in zip(whole.ids.tolist(), label.tolist())} == {i: g for i, (_, g) in expected.items()}
    # Two halves with themselves and each other find the same links.
    a, b = block(ids[::2]), block(ids[1::2])
    cover_tree.Traversal(a, a).run()
    cover_tree.Traversal(b, b).run()
    cover_tree.Traversal(a, b).run()
    halves = dict(zip(a.ids.tolist(), a.links().tolist())) | dict(zip(b.ids.tolist(), b.links().tolist()))
    assert halves == {i: n for i, (n, _) in expected.items()}


def test_links_of_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAST_BLOCK", 40)
    monkeypatch.setattr(cover_tree, "SEEDS", 12)
    raw = clustered(300, 8, 7)
    given = [(i * 3, v.tolist()) for i, v in enumerate(raw)]
    df = spark.createDataFrame([(i, v, 0) for i, v in given], VECTORS)
    assert tuples(cover_tree.link_vectors(df)) == sorted(groups_of(given), key=repr)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 0.0, 0.0], [0.96, 0.28, 0.0]
    rows = [(5, a), (5, a), (4, b), (9, None), (10, []), (11, [0.0, 0.0, 0.0]), (12, [nan, 1.0, 0.0]), (13, [inf, 1.0, 0.0])]
    rows += [(14, [None, 1.0, 0.0]), (15, [1.0, 0.0]), (16, [2.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 7.0]), (None, None)]
    rows += [(20, [0.0, 1.0, 0.0]), (21, [0.0, 0.94999, (1 - 0.94999**2) ** 0.5])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    expected = [
        (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (15, 1, 15, True), (16, 1, 15, False), (20, 0, 20, True),
        (21, 0, 21, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True),
        *((i, 0, i, True) for i in (9, 10, 11, 12, 13, 14)),
    ]
    assert tuples(cover_tree.link_vectors(with_clashes(df))) == sorted(expected, key=repr)
    empty = cover_tree.link_vectors(df.limit(0))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0


def test_a_hot_vector_is_one_class(spark):
    """A third of the rows are one vector: no pair of its copies is looked at."""
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, float(i + 1)], 0) for i in range(600)]
    found = cover_tree.link_vectors(spark.createDataFrame(rows, VECTORS))
    assert {(r.n_links, r.component_id) for r in found.collect()} == {(399, 1), (199, 0)}


# -- hard negatives -----------------------------------------------------------


def mined(rows, every=100):
    """The same, row by row."""
    take = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        take.append((i, whole, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for anchor, v, label in take:
        if anchor % every:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), i, other) for i, w, other in take if len(w) == len(v) and i != anchor]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for score, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score]
            out += [(anchor, positive, rank, i, score, s) for rank, (s, i, _) in enumerate(fits[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 5, 64])
def test_bounds_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    rows, anchor = np.floor(rng.normal(size=(200, dim)) * 300), np.floor(rng.normal(size=(1, dim)) * 300)
    scores, every = rows @ anchor[0], np.arange(200)
    widths = []
    for of, own in zip(hard_negatives.summaries(rows), hard_negatives.summaries(anchor)):
        low, high = hard_negatives.bounds(tuple(x[0] for x in own), of, every)
        assert (low <= scores).all() and (scores <= high).all()
        widths.append((high - low).mean())
    # Finer segments bound more closely.
    assert all(a >= b - 1e-3 for a, b in zip(widths, widths[1:]))


@pytest.mark.parametrize("block,group", [(4096, 1024), (50, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "MOST_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    raw = clustered(400, 6, 8)
    rng = np.random.default_rng(8)
    rows = [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(raw)]
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), every=20)
    assert tuples(found) == sorted(mined(rows, 20), key=repr)


def test_awkward_negatives(spark):
    nan = float("nan")
    one, two = [1.0, 1.0], [1.0, 0.9]
    rows = [(100, one, 1), (100, one, 1), (1, two, 1), (2, two, 1), (3, two, 2), (4, two, 2), (4, two, 2), (5, one, 2)]
    rows += [(7, two, 0), (6, None, 1), (8, [], 1), (9, [nan, 1.0], 2), (10, [None, 1.0], 2), (11, one, None), (None, one, 2)]
    rows += [(12, [1.0], 2), (13, [1.0, 1.0, 1.0], 2), (200, [-1.0, -1.0], 3), (300, [1.0, 1.0], 5), (14, [1e30, 1e30], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    expected = [x for x in mined(rows) if abs(x[4]) < 1 << 63]
    assert expected and tuples(hard_negatives.mine(with_clashes(df))) == sorted(expected, key=repr)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("vec_id < 100")).count() == 0


# -- spelling variants --------------------------------------------------------


def variants(texts):
    """The same, word by word, with near words found by leaving out each letter in turn."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts = Counter()
    for ident, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (shorter := w[:k] + w[k + 1 :]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(
        ((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=repr
    )


TEXTS = "doc_id bigint, text string"


@pytest.mark.parametrize("cell", [spelling_groups.CELL, 60])
def test_variants_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling_groups, "CELL", cell)
    monkeypatch.setattr(spelling_groups, "QUERIES", cell)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = tuples(spelling_groups.group_variants(df))
    assert found == variants(texts) and len(found) > 1000


def test_awkward_words(spark):
    long = "ab" * 40_000
    texts = [(None, "Straßen Straßen STRAßEN"), (1, None), (2, ""), (3, "a b cc 123 !!"), (4, "naïveté naïvetÉ naïvete naïvete")]
    texts += [(5, f"{long} {long} {long}c {long}c {long}"), (5, f"{long}"), (6, "listens " * 25 + "silents silents enlists enlists tinsels tinsels")]
    texts += [(7, "hundreds " * 210 + "hundredz " * 20 + "hundrebz hundrebz"), (8, "été×÷ÿabcĀdef " * 3), (8, "x" * 7 + "\n" + "x" * 8)]
    texts += [(9, "xxxxxxx xxxxxxxx xxxxxxxxx xxxxxxx xxxxxxxx xxxxxxxxx abcdefg abcdefg Abcdefgh ABCDEFGH")]
    df = spark.createDataFrame(texts, TEXTS)
    expected = variants(texts)
    assert tuples(spelling_groups.group_variants(with_clashes(df))) == expected
    # hundrebz, by way of hundredz, leads to hundreds.
    assert ("hundrebz", "hundredz", "hundreds") in {x[:3] for x in expected}
    for nothing in (df.limit(0), df.where("doc_id < 4")):
        empty = spelling_groups.group_variants(nothing)
        assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_range_search_finds_all_within_reach():
    rng = np.random.default_rng(3)
    points, queries = (rng.poisson(0.6, (n, spelling_groups.DIMS)).astype(np.int16) for n in (300, 200))
    points[:100] = points[0]
    queries[:50, :] = points[50:100]
    for reach in (0, 1, 2, 6):
        found = [p for q, h in spelling_groups.range_search(points, queries, reach) for p in zip(q.tolist(), h.tolist())]
        away = np.abs(queries[:, None, :].astype(int) - points[None, :, :]).sum(2)
        assert sorted(found) == sorted(map(tuple, np.argwhere(away <= reach).tolist()))
