"""Similarity join on word shingles: Bayesian pruning of MinHash candidates, exact check of the rest.

1. Every text becomes its set of 5-word shingles (64-bit hashes) and a MinHash signature. Texts with the same
   set are one *class*; from here on a class counts once, whatever its number of copies.
2. Bands of the signature put classes into buckets. Buckets of at most ``SMALL`` classes are
   joined with themselves. A larger bucket is dealt by hash into tiles, and each pair of tiles is a task's
   work, so no task gets the bucket and no pair of it becomes a row.
3. A pair is judged where its signatures first share a band. Its MinHash values are
   compared ``STEP`` at a time; when the posterior probability that the similarity
   reaches the threshold falls below ``TOLERANCE``, given the agreements so far and a flat
   prior, the pair is dropped.
4. What is left is verified on the whole sets. Links are counted; for groups, each place keeps
   only a spanning forest of the links it found.
5. Groups are the connected components of the links, by alternating star contraction.

What can be missed: a pair that shares no band (3e-5 at similarity 0.8, less above) or is pruned (7e-5 at similarity 0.8 over all
steps together, 2e-5 at 0.82). No bucket, group or partner is capped.

Rows: words are ``[^\\x20\\x09-\\x0D]+`` as they are written. A text of one to four words has one shingle,
all its words. Null texts and texts without words are similar to nothing: each is
a class of its own row, so they are never copies of each other. Repeated rows are copies. Only ``doc_id`` and
``text`` are read. Ties (which row of a group stays) go to the smallest id, null ids last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from almoner.llm.common import map_batches, slices, staged, text_key, unused, word_hashes
from almoner.operators.lookup import fits_broadcast

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-5
SMALL = 64
TILE = 512

_draw = np.random.default_rng(5)
_MULTIPLY = _draw.integers(1, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words, _ = word_hashes([text])
    width = min(SHINGLE, len(words))
    if not width:
        return words
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX + words[k : len(words) - width + 1 + k]
    return np.unique(rolled ^ (rolled >> np.uint64(32)))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the shingles."""
    smallest = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 256):
        values = (found[at : at + 256, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        np.minimum(smallest, values.min(0).astype(np.uint32), out=smallest)
    return smallest


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, agreements needed): with fewer the posterior of reaching the threshold is too small.

    With a flat prior the posterior after m of n agreements is Beta(m + 1, n - m + 1), whose
    tail above t is the chance of at most m successes in n + 1 tries of t."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        chance = [math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)]
        out.append((n, next(m for m in range(n + 1) if sum(chance[: m + 1]) >= tolerance)))
    return out


NEEDED = least_agreements()


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs (rows of two signature tables) that pass every step."""
    alive = np.arange(len(left))
    agreed = np.zeros(len(left), np.int64)
    for n, needed in NEEDED:
        part = slice(n - STEP, n)
        agreed = agreed + (left[alive, part] == right[alive, part]).sum(1)
        good = agreed >= needed
        alive, agreed = alive[good], agreed[good]
    return alive


def first_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which the signatures of each pair agree; BANDS if there is none."""
    same = (left == right).reshape(len(left), BANDS, ROWS).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


# -- classes ------------------------------------------------------------------


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))


def _signed(documents: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, text_key, class, signature``; class is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                classes, signatures = [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text)
                    classes.append(int(xxhash.xxh3_64_intdigest(found.tobytes())) - (1 << 63) if len(found) else None)
                    signatures.append(signature(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(classes, pa.int64()), pa.array(signatures, pa.binary())],
                    ["doc_id", "text_key", "class", "signature"],
                )

    schema = "doc_id bigint, text_key bigint, class bigint, signature binary"
    return staged(map_batches(_texts(documents), run, schema), "signatures")


def _shingle_sets(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``class, shingles`` of the classes of ``rows`` (class, doc_id, text_key: one text of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(text) for text in part.column(0).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                values = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(ends, values)], ["class", "shingles"])

    rows = rows.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    if fits_broadcast(rows):
        rows = F.broadcast(rows)
    texts = _texts(documents)
    chosen = texts.join(rows, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("text", "class")
    return staged(map_batches(chosen, run, "class bigint, shingles array<bigint>").dropDuplicates(["class"]), "shingles")


# -- links --------------------------------------------------------------------


def _buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (``class, copies, doc_id, text_key, signature``) and their places in buckets that
    hold more than one (``bucket, band, class, size``)."""
    classes = staged(
        signed.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.count("*").alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("first"),
            F.first("signature").alias("signature"),
        )
        .select("class", "copies", "first.doc_id", "first.text_key", "signature"),
        "classes",
    )
    width = 4 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    key = F.xxhash64("band", F.substring("signature", F.col("band") * width + 1, F.lit(width)))
    places = classes.select("class", "signature", band).select("class", "band", key.alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return classes, staged(places.join(shared, "bucket"), "buckets")


def _small_links(places: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` of the small buckets that survive the pruning."""
    small = places.where(F.col("size") <= SMALL)
    pairs = (
        small.select("bucket", "band", F.col("class").alias("a"))
        .join(small.select("bucket", F.col("class").alias("b")), "bucket")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.min("band").alias("band"))
    )
    signed = classes.select("class", "signature")
    pairs = pairs.join(signed.toDF("a", "left"), "a").join(signed.toDF("b", "right"), "b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            left, right = (_table(batch.column(names.index(x))) for x in ("left", "right"))
            band = batch.column(names.index("band")).to_numpy()
            # An earlier band shared in a large bucket has the pair already.
            alive = survivors(left, right)
            alive = alive[first_band(left[alive], right[alive]) == band[alive]]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return staged(map_batches(pairs, prune, "a bigint, b bigint"), "candidates")


def _table(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, VALUES)


def _small_verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold; the counts are whole numbers."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    return both.where(shared * 10 >= union * round(THRESHOLD * 10)).select("a", "b")


def _jaccard_reached(left: np.ndarray, right: np.ndarray) -> bool:
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared * 10 >= (len(left) + len(right) - shared) * round(THRESHOLD * 10)


def _tile_links(places: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the large buckets as ``class, other, links``: per tile pair the number of documents
    that a class is linked to, and edges of a spanning forest (``other``, else null)."""
    n_tiles = F.ceil(F.col("size") / TILE).cast("int")
    large = places.where(F.col("size") > SMALL).select("bucket", "band", "class", n_tiles.alias("n"))
    large = large.withColumn("tile", F.pmod(F.xxhash64("class", F.lit(3)), "n").cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("bucket", "band", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "class")
    dealt = dealt.join(classes.select("class", "copies", "signature"), "class").join(sets, "class")
    schema = "class bigint, other bigint, links bigint"
    return dealt.groupBy("bucket", "band", "x", "y").applyInArrow(_tile, schema)


def _tile(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    band, x, y = (k.as_py() for k in key[1:])
    ids = group.column("class").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    copies, tile = group.column("copies").to_numpy()[order], group.column("tile").to_numpy()[order]
    table = _table(group.column("signature").combine_chunks())[order]
    column = group.column("shingles").combine_chunks()
    sets = [column[int(i)].values.to_numpy() for i in order]
    sizes = np.array([len(s) for s in sets])
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges: list[tuple[int, int]] = []
    for i in range(len(ids) - 1):
        later = np.arange(i + 1, len(ids))
        if x != y:  # pairs within a tile belong to the tile's own task
            later = later[tile[later] != tile[i]]
        # The sizes alone bound the similarity.
        small, big = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
        later = later[small * 10 >= big * round(THRESHOLD * 10)]
        mine = np.broadcast_to(table[i], (len(later), VALUES))
        alive = survivors(mine, table[later])
        later = later[alive]
        later = later[first_band(mine[alive], table[later]) == band]
        for j in later:
            if _jaccard_reached(sets[i], sets[j]):
                links[i] += copies[j]
                links[j] += copies[i]
                if (a := top(i)) != (b := top(j)):
                    root[max(a, b)] = min(a, b)
                    edges.append((int(ids[i]), int(ids[j])))
    linked = np.flatnonzero(links)
    return pa.table(
        {
            "class": pa.array([*ids[linked].tolist(), *(a for a, _ in edges)], pa.int64()),
            "other": pa.array([None] * len(linked) + [b for _, b in edges], pa.int64()),
            "links": pa.array([*links[linked].tolist(), *([0] * len(edges))], pa.int64()),
        }
    )


# -- groups -------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for the nodes of ``edges``: the smallest node of each connected component.

    Large and small stars in turn, until every edge leads to the smallest node. Each
    round is staged, so lineage stays short and a lost executor costs one round."""
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while True:
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger_only=True)
        small = staged(_star(large, larger_only=False), "edges")
        # The stars are done when no smaller end is itself the larger end of an edge.
        done = small.select(F.col("v").alias("u")).join(small.select("u").distinct(), "u", "left_semi").limit(1).count() == 0
        now = small
        if done:
            break
    hubs = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        hubs.select("node", F.col("node").alias("component"))
    )


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Joins each node's neighbours to its smallest one: the larger neighbours, or (when the
    pairs lead from larger to smaller nodes) all of them and the node itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if larger_only:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def join_similar(documents: DataFrame) -> DataFrame:
    """``doc_id, text_key, class_id, n_links, group_size`` of every row.

    ``class_id`` is the smallest id of the row's group of linked texts, ``n_links`` the number of
    other rows whose similarity is at least the threshold, copies included."""
    signed = _signed(documents)
    classes, places = _buckets(signed)
    pairs = _small_links(places, classes)
    wanted = (
        pairs.select(F.col("a").alias("class"))
        .unionByName(pairs.select(F.col("b").alias("class")))
        .unionByName(places.where(F.col("size") > SMALL).select("class"))
        .distinct()
    )
    sets = _shingle_sets(documents, staged(classes.select("class", "doc_id", "text_key").join(wanted, "class", "left_semi"), "wanted"))
    small = staged(_small_verified(pairs, sets), "links")
    large = staged(_tile_links(places, classes, sets), "links")
    copies = classes.select("class", "copies")
    both = small.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(
        small.select(F.col("b").alias("class"), F.col("a").alias("other"))
    )
    counted = (
        both.join(copies.toDF("other", "links"), "other")
        .select("class", "links")
        .unionByName(large.where("other IS NULL").select("class", "links"))
        .groupBy("class")
        .agg(F.sum("links").alias("links"))
    )
    edges = small.unionByName(large.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    joined = components(edges, "a", "b")
    of = staged(
        classes.join(counted, "class", "left")
        .join(joined.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")),
        "groups",
    )
    groups = of.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("group_size"))
    labelled = of.join(groups, "component").select("class", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "group_size")
    rows = signed.select("doc_id", "text_key", "class").join(labelled, "class", "left")
    alone = F.col("class").isNull()
    return rows.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("bigint").alias("group_size"),
        alone.alias("wordless"),
    )


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest id. Rows without words stay.

    The rows that go are found by id and text and taken out by an anti join, so the texts that
    stay are not shuffled when the list is small. Of rows equal in id and text one stays."""
    found = staged(join_similar(documents).where("group_size > 1 AND NOT wordless"), "near-copies")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    kept = found.groupBy("class_id").agg(F.min(order).alias("kept"))
    rows = found.join(kept, found["class_id"].eqNullSafe(kept["class_id"])).select(
        "doc_id", "text_key", (F.col("kept") == order).alias("stays")
    )
    listed = rows.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    listed = staged(listed, "near-copies")
    gone, repeated = listed.where("NOT stays"), listed.where("stays AND n > 1")
    rest = _without(documents, gone.select("doc_id", "text_key").unionByName(repeated.select("doc_id", "text_key")))
    again = _matching(documents, repeated.select("doc_id", "text_key"))
    key = unused(documents, "key")
    once = again.withColumn(key, F.struct("doc_id", text_key(F.col("text")))).dropDuplicates([key]).drop(key)
    return rest.unionByName(once)


def _condition(documents: DataFrame, listed: DataFrame) -> tuple[DataFrame, Column]:
    listed = listed.toDF("listed_id", "listed_key")
    same = documents["doc_id"].cast("bigint").eqNullSafe(listed["listed_id"]) & (text_key(documents["text"]) == listed["listed_key"])
    return F.broadcast(listed) if fits_broadcast(listed) else listed, same


def _without(documents: DataFrame, listed: DataFrame) -> DataFrame:
    listed, same = _condition(documents, listed)
    return documents.join(listed, same, "left_anti")


def _matching(documents: DataFrame, listed: DataFrame) -> DataFrame:
    listed, same = _condition(documents, listed)
    return documents.join(listed, same, "left_semi")
