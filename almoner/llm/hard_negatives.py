"""Hard negatives by inner product, found through segment summaries.

A vector is cut into segments. For each the mean and the deviation (the length of what is left when the mean is taken
out) are stored; the product of two vectors' segments lies within (length * product of means) plus or minus the product of
deviations. Sums over the segments bound a score. Bounds of one segment come first; what they cannot settle is refined by twice
as many segments, and so on (``LEVELS``); what is left then is scored exactly, in whole numbers.

A row is wanted while it can still be among an anchor's ``n`` best: the ``n``-th largest lower bound of the rows that
certainly qualify is a score that ``n`` rows reach, so a row whose upper bound is below it goes.

In Spark, rows are dealt into blocks and anchors into groups; a task has one block and one group and returns, for each anchor,
its ``n`` best in the block. The best of all blocks are taken from these. This runs twice: for the positives, and then
for the negatives between ``LEAST_SHARE`` and all of each positive's score.

Rows: those without id or label, and with a null, empty or non-finite vector, take no part; nor do anchors without positives.
Vectors of other lengths are never compared. Rows equal in id, label and vector count once; a row is no other row of an
anchor with the same id. Ties go to the smaller id. Components become floor(256 * x); where sums do not fit
into 53 bits, scores are summed as Python's unbounded integers and held to the range of a long. Only ``vec_id``, ``embedding`` and
``label`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from almoner.llm.common import ship_package, staged

EVERY = 100
POSITIVES = NEGATIVES = 5
LEAST_SHARE = 80
LEVELS = 4
SCALE = 256
GROUP = 1024
LEAST_BLOCK, MOST_BLOCK = 4096, 32768
_LONG = 1 << 63
EVERYTHING = (-100 * _LONG, 100 * _LONG)


# -- summaries ----------------------------------------------------------------


Level = tuple[np.ndarray, ...]
Range = tuple[int, int]


def summaries(vectors: np.ndarray) -> list[Level]:
    """For each level the means (times the root of the segment's length, so that products need no factor), the deviations,
    and the vectors' squared lengths."""
    dim, levels = vectors.shape[1], []
    length = (vectors * vectors).sum(1)
    for level in range(LEVELS):
        cuts = np.unique(np.arange(1 << level) * dim >> level)
        size = np.diff(np.append(cuts, dim))
        mean = np.add.reduceat(vectors, cuts, 1) / size
        left = vectors - np.repeat(mean, size, 1)
        levels.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(left * left, cuts, 1)), length))
    return levels


def _times(matrix: np.ndarray, vector: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The products of rows at ``places`` with a vector; most rows are not copied first."""
    return (matrix @ vector)[places] if 2 * len(places) > len(matrix) else matrix[places] @ vector


def bounds(
    a: Level, x: Level, places: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of one anchor (its level) with the rows at ``places`` (their level)."""
    middle = _times(x[0], a[0], places)
    # A little more than what rounding may take: the means' products are at most as large as the lengths'.
    spread = _times(x[1], a[1], places) + 1e-9 * np.sqrt((a[0] @ a[0] + a[1] @ a[1]) * x[2][places]) + 1e-6
    return middle - spread, middle + spread


def exact(a: np.ndarray, x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whole-number inner products of one vector with the rows at ``places``; both hold whole numbers."""
    if len(places) and np.abs(x).max() * np.abs(a).max(initial=0) * len(a) >= 2.0**53:
        whole = [int(v) for v in a]
        sums = (sum(p * int(q) for p, q in zip(whole, row)) for row in x[places])
        return np.array([min(max(s, -_LONG), _LONG - 1) for s in sums], np.int64)
    return _times(x, a, places).astype(np.int64)


def best(
    a: list[Level], vector: np.ndarray, rows: list[Level], vectors: np.ndarray, ids: np.ndarray, alive: np.ndarray, n: int, ranges: list[Range]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range of scores (given as 100 times its ends) places and scores of the ``n`` best among the places
    ``alive``: highest score first, then the smallest id."""
    for level, of in zip(a, rows):
        if len(alive) <= n:
            break
        lower, upper = bounds(level, of, alive)
        keep = np.zeros(len(alive), bool)
        for low, high in ranges:
            may = (100 * upper >= low) & (100 * lower <= high)
            certain = lower[(100 * lower >= low) & (100 * upper <= high)]
            if len(certain) >= n:
                may &= upper >= np.partition(certain, len(certain) - n)[len(certain) - n]
            keep |= may
        alive = alive[keep]
    scores = exact(vector, vectors, alive)
    return [_first(alive, scores, ids, n, *ends) for ends in ranges]


def _first(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    least, most = max(-(-low // 100), -_LONG), min(high // 100, _LONG - 1)
    good = np.flatnonzero((scores >= least) & (scores <= most)) if least <= most else np.zeros(0, np.int64)
    if len(good) > n:
        floor = np.partition(scores[good], len(good) - n)[len(good) - n]
        good = good[scores[good] >= floor]
    # The complement of a whole number turns its order round and never overflows.
    good = good[np.lexsort((ids[places[good]], ~scores[good]))[:n]]
    return places[good], scores[good]


# -- Spark --------------------------------------------------------------------


def _takes_part(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: the rows that count, once each, with whole components."""
    finite = F.expr(
        "size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Spark's floor gives a long, which a very large component does not fit; Python's does not end there.
    whole = F.expr(f"transform(embedding, x -> CAST(x AS DOUBLE) * {SCALE})")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole.alias("vector"))
    return rows.distinct()


_PACKED = "dim int, ids array<bigint>, labels array<bigint>, vectors array<double>"


def _packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """A row for each block: its ids, labels and vectors."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        vectors = np.floor(group.column("vector").combine_chunks().flatten().to_numpy())
        lists = [group.column("vec_id").to_numpy(), group.column("label").to_numpy(), vectors]
        arrays = [pa.array([k.as_py()], pa.int32()) for k in key]
        for values in lists:
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)))
        return pa.Table.from_arrays(arrays, [name, "dim", "ids", "labels", "vectors"])

    dealt = rows.select("vec_id", "label", "vector", F.size("vector").alias("dim"), block.cast("int").alias(name))
    return staged(dealt.groupBy(name, "dim").applyInArrow(run, f"{name} int, {_PACKED}"), "vector-blocks")


def _opened(group: pa.Table, is_anchor: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = group.column("anchors").to_pylist().index(is_anchor)
    ids, labels, vectors = (group.column(c)[k].values.to_numpy() for c in ("ids", "labels", "vectors"))
    return ids, labels, vectors.reshape(len(ids), -1)


def _meetings(anchors: DataFrame, blocks: DataFrame, n_groups: int, n_blocks: int) -> DataFrame:
    """Each group of anchors beside each block of rows: two rows for every pair of them."""
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("anchors", F.lit(True))
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumn("anchors", F.lit(False))
    tasks = max(1, min(n_groups * n_blocks, 8 * anchors.sparkSession.sparkContext.defaultParallelism))
    return left.unionByName(right, allowMissingColumns=True).repartition(tasks, "part", "block").groupBy("part", "block", "dim")


def _best_first(rows: DataFrame, by: list[str], n: int, kept: str) -> DataFrame:
    """The ``n`` best rows of each key; each task has sent its own ``n`` best only."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id", "other_label")
    return rows.withColumn(kept, F.row_number().over(order)).where(F.col(kept) <= n)


def _positives(group: pa.Table) -> Iterator[tuple]:
    ids, labels, vectors = _opened(group, False)
    a_ids, a_labels, a_vectors = _opened(group, True)
    levels, a_levels = summaries(vectors), summaries(a_vectors)
    places = {label: np.flatnonzero(labels == label) for label in np.unique(a_labels)}
    for k, (anchor, label) in enumerate(zip(a_ids.tolist(), a_labels.tolist())):
        alive = places[label]
        alive = alive[ids[alive] != anchor]
        own = [tuple(x[k] for x in level) for level in a_levels]
        found, scores = best(own, a_vectors[k], levels, vectors, ids, alive, POSITIVES, [EVERYTHING])[0]
        for at, score in zip(found.tolist(), scores.tolist()):
            yield k, anchor, label, int(ids[at]), label, score, None


def _negatives(group: pa.Table) -> Iterator[tuple]:
    ids, labels, vectors = _opened(group, False)
    a_ids, a_labels, a_vectors = _opened(group, True)
    at = group.column("anchors").to_pylist().index(True)
    wanted = group.column("wanted")[at].as_py() or []
    levels, a_levels = summaries(vectors), summaries(a_vectors)
    places = {label: np.flatnonzero(labels != label) for label in np.unique(a_labels)}
    asked: dict[int, list] = {}
    for w in wanted:
        asked.setdefault(w["k"], []).append(w)
    for k, positives in asked.items():
        alive = places[a_labels[k]]
        alive = alive[ids[alive] != a_ids[k]]
        own = [tuple(x[k] for x in level) for level in a_levels]
        ranges = [(LEAST_SHARE * w["score"], 100 * w["score"]) for w in positives]
        for w, (found, scores) in zip(positives, best(own, a_vectors[k], levels, vectors, ids, alive, NEGATIVES, ranges)):
            for place, score in zip(found.tolist(), scores.tolist()):
                yield k, int(a_ids[k]), int(a_labels[k]), int(ids[place]), int(labels[place]), score, w["rank"]


_FOUND = "part int, dim int, k int, anchor_id bigint, anchor_label bigint, other_id bigint, other_label bigint, score bigint, positive int"
_FOUND_TYPES = [pa.int32()] * 3 + [pa.int64()] * 5 + [pa.int32()]


def _search(meetings: DataFrame, search) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        part, _, dim = (k.as_py() for k in key)
        # Of one length there may be rows without anchors, or anchors without rows, here.
        found = [(part, dim, *row) for row in search(group)] if group.num_rows == 2 else []
        columns = zip(*found) if found else [[]] * len(_FOUND_TYPES)
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, _FOUND_TYPES)})

    return staged(meetings.applyInArrow(run, _FOUND), "vector-hits")


def mine(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors (ids that ``every`` divides)."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = staged(_takes_part(vectors), "vectors")
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    most = min(MOST_BLOCK, max(LEAST_BLOCK, n // 48))
    n_blocks, n_groups = max(1, -(-n // most)), max(1, -(-n_anchors // GROUP))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "label"), F.lit(count))

    blocks = _packed(rows, dealt(n_blocks), "block")
    anchors = _packed(rows.where(is_anchor), dealt(n_groups), "part")
    key = ["part", "dim", "k"]
    positives = _search(_meetings(anchors, blocks, n_groups, n_blocks), _positives)
    positives = staged(_best_first(positives, key, POSITIVES, "rank"), "positives").drop("positive")
    wanted = positives.groupBy("part", "dim").agg(F.collect_list(F.struct("k", "rank", "score")).alias("wanted"))
    asking = anchors.join(wanted, ["part", "dim"])
    negatives = _search(_meetings(asking, blocks, n_groups, n_blocks), _negatives)
    negatives = _best_first(negatives, [*key, "positive"], NEGATIVES, "n")
    positives = positives.select(*key, F.col("rank").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(positives, [*key, "positive"]).select(
        "anchor_id",
        "positive_id",
        F.col("n").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


ORACLE = f"""
WITH v AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
           CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
    WHERE a.vec_id % {EVERY} = 0),
p AS (
    SELECT * FROM s WHERE other_label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
n AS (
    SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.other_label <> p.anchor_label
     AND 100 * s.score BETWEEN {LEAST_SHARE} * p.score AND 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
