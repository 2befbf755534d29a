"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Unit vectors are at Euclidean distance d where their cosine is 1 - d*d/2, so the cosine threshold is a distance ``REACH``.

1. Equal vectors are one *class* with its number of copies.
2. The top of the tree is built from a bounded sample (``SEEDS`` vectors, the first by hash). Every vector goes to the
   nearest seed, its *cell*; the cell's covering radius is measured over all its vectors.
3. Neighbouring cells are packed into blocks, a large cell is dealt into several. A task for each block
   builds its cover tree: each node's points lie within its measured radius of its centre, levels halve that radius, and a
   parent's centre is a centre again below.
4. Pairs of blocks whose cells are out of reach of each other (centre distance less both radii above ``REACH``) never
   meet. For each other pair a task descends both trees at once: a pair of nodes is dropped when
   it is out of reach as a whole, counted as a whole when all its points are within reach, else the pairs of its children
   are looked at. Pairs of points near the threshold are decided in double precision on the vectors as they came.
5. Links are summed; from each task comes a spanning forest only, and groups are the connected components of it.

All pairs at or above the threshold are found and none below it. Vectors without any structure (all far from each other)
let the bounds prune nothing above the points, so the work is then that of comparing all pairs in blocks.

Rows: null, empty and zero vectors and those with a null or non-finite component link with nothing, nor do vectors of
different lengths. Every row gives a row, repeated ones too; they are links of each other. A null ``vec_id`` counts as a row;
a group's id is its smallest non-null one. Only ``vec_id`` and ``embedding`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almoner.llm.common import map_batches, ship_package, staged
from almoner.llm.jaccard_join import components
from almoner.operators.lookup import fits_broadcast

THRESHOLD = 0.95
REACH = math.sqrt(2 - 2 * THRESHOLD)
SEEDS = 1024
SEED_BYTES = 8 << 20
# Rows of a block: about a 24th of all between these bounds.
LEAST_BLOCK, MOST_BLOCK = 2048, 16384
STRIP = 1 << 22
# Nodes of about this many points are taken apart at once, so many pairs of points at a time.
SMALL = 64
PAIRS = 1 << 18


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, as 32-bit floats."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True, initial=1e-300)
    return (raw / np.sqrt((raw * raw).sum(1, keepdims=True))).astype(np.float32)


def _slack(dim: int) -> float:
    """What the cosine of two 32-bit unit vectors may be off."""
    return (dim + 8) * 2.0**-23


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


# -- one tree -----------------------------------------------------------------


class Tree:
    """A cover tree in flat arrays. Points are in tree order, so node k holds ``start[k]:end[k]``; its children are the
    nodes ``first[k]:last[k]``, none for a single point."""

    def __init__(self, points: np.ndarray, start, end, centre, radius, first, last):
        self.points = points
        self.start, self.end, self.centre = (np.asarray(x, np.int64) for x in (start, end, centre))
        self.radius = np.asarray(radius, np.float64)
        self.first, self.last = np.asarray(first, np.int64), np.asarray(last, np.int64)

    def children(self, k: int) -> np.ndarray:
        return np.arange(self.first[k], self.last[k]) if self.last[k] > self.first[k] else np.array([k])


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of unit vectors (at least one) and the order its points are in."""
    slack = _slack(points.shape[1])
    order = np.arange(len(points))
    start, end, centre, radius, first, last = [0], [len(points)], [0], [], [], []
    at = 0
    while at < len(start):
        s, e, c = start[at], end[at], centre[at]
        if e - s == 1:
            radius.append(0.0)
            first.append(0)
            last.append(0)
            at += 1
            continue
        members = order[s:e]
        cosines = points[members] @ points[c]
        far = float(_distance(cosines.min() - slack))
        radius.append(far)
        first.append(len(start))
        below = 2.0 ** math.floor(math.log2(far) - 1e-9) if far > 0 else 0.0
        parts = _cover(points, members, c, below, slack)
        while len(parts) == 1:
            below /= 2
            parts = _cover(points, members, c, below, slack)
        for part in parts:
            order[s : s + len(part)] = part
            start.append(s)
            s += len(part)
            end.append(s)
            centre.append(int(part[0]))
        last.append(len(start))
        at += 1
    placed = np.empty(len(order), np.int64)
    placed[order] = np.arange(len(order))
    return Tree(points[order], start, end, placed[centre], radius, first, last), order


def _cover(points: np.ndarray, members: np.ndarray, centre: int, reach: float, slack: float) -> list[np.ndarray]:
    """Parts of ``members``, each within ``reach`` of its first point; the first part begins with ``centre``. Points that
    are too near to be told apart are parts of their own."""
    least = 1 - reach * reach / 2
    if 1 - least <= 4 * slack:
        return [members[i : i + 1] for i in np.argsort(members != centre, kind="stable")]
    left = np.concatenate([[centre], members[members != centre]])
    parts = []
    while len(left):
        some = points[left[: max(1, min(256, STRIP // len(left)))]]
        near = some @ points[left].T >= least
        owner = np.full(len(left), -1)
        for i in range(len(some)):
            if owner[i] < 0:
                owner[(owner < 0) & near[i]] = i
                owner[i] = i
        chosen = np.flatnonzero(owner[: len(some)] == np.arange(len(some)))
        got = np.argsort(owner, kind="stable")
        got = got[np.searchsorted(owner[got], 0) :]
        cuts = np.searchsorted(owner[got], chosen)
        for i, part in zip(chosen, np.split(got, cuts[1:])):
            own = np.concatenate([[i], part[part != i]])
            parts.append(left[own])
        left = left[owner < 0]
    return parts


# -- two trees ----------------------------------------------------------------


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of the points ``i`` and ``j``, pair by pair; a label names the group's first point."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Block:
    """The points of a block with their ids and copies, and its tree."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, tree: Tree):
        self.ids, self.copies, self.raw, self.tree = ids, copies, raw, tree
        total = np.concatenate([[0], np.cumsum(copies)])
        self.weight = total[tree.end] - total[tree.start]
        self.size = tree.end - tree.start
        # Links that whole nodes and single points have gained, and nodes whose points are all joined.
        self.gained = np.zeros(len(tree.start), np.int64)
        self.own = np.zeros(len(ids), np.int64)
        self.joined = np.zeros(len(tree.start), bool)

    def links(self) -> np.ndarray:
        """What each point gained, with all nodes that it is in."""
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, self.tree.start, self.gained)
        np.add.at(step, self.tree.end, -self.gained)
        return np.cumsum(step[:-1]) + self.own


def _sums(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(places, values, n).astype(np.int64)


class Traversal:
    """The links between two blocks, or within one if both are the same."""

    def __init__(self, a: Block, b: Block):
        self.a, self.b, self.same = a, b, a is b
        self.slack = _slack(a.tree.points.shape[1])
        self.shift = 0 if self.same else len(a.ids)
        # Points of b come after those of a.
        self.label = np.arange(len(a.ids) + (0 if self.same else len(b.ids)))
        self.stack = [(0, 0)]
        # Pairs of small nodes, to be taken apart many at a time.
        self.small: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self) -> np.ndarray:
        """Counts all links into the blocks; returns the label of every point's group."""
        while self.stack:
            self._open(*self.stack.pop())
        for u, v in self.small:
            self._points_of(u, v)
        for block, offset in ((self.a, 0),) if self.same else ((self.a, 0), (self.b, self.shift)):
            for k in np.flatnonzero(block.joined & (block.size > 1)):
                inside = np.arange(block.tree.start[k] + 1, block.tree.end[k])
                unite(self.label, inside + offset, np.full(len(inside), block.tree.start[k] + offset))
        return self.label

    def _open(self, u: int, v: int) -> None:
        """Judges the pairs of children of two nodes."""
        a, b, ta, tb = self.a, self.b, self.a.tree, self.b.tree
        cu, cv = ta.children(u), tb.children(v)
        twin = self.same and u == v
        if twin:
            for k in cu[a.size[cu] > 1]:
                if 2 * ta.radius[k] <= REACH - 4 * math.sqrt(self.slack):
                    # Every point of the node is linked to every other one.
                    a.gained[k] += a.weight[k]
                    a.own[ta.start[k] : ta.end[k]] -= a.copies[ta.start[k] : ta.end[k]]
                    a.joined[k] = True
                elif a.size[k] <= SMALL:
                    self.small.append((np.array([k]), np.array([k])))
                else:
                    self.stack.append((int(k), int(k)))
        # Points and larger nodes apart: the largest radius of a part settles most of its pairs at one comparison.
        for pu in _by_radius(ta, cu):
            for pv in _by_radius(tb, cv):
                least = 1 - (REACH + ta.radius[pu].max() + tb.radius[pv].max()) ** 2 / 2 - self.slack
                right = tb.points[tb.centre[pv]]
                step = max(1, STRIP // len(pv))
                for at in range(0, len(pu), step):
                    cosine = ta.points[ta.centre[pu[at : at + step]]] @ right.T
                    i, j = np.nonzero(cosine >= least)
                    if twin:
                        half = pu[at + i] < pv[j]
                        i, j = i[half], j[half]
                    if len(i):
                        self._judge(pu[at + i], pv[j], cosine[i, j].astype(np.float64))

    def _judge(self, u: np.ndarray, v: np.ndarray, cosine: np.ndarray) -> None:
        """Drops, links or opens pairs of nodes by the cosines of their centres."""
        a, b, ta, tb = self.a, self.b, self.a.tree, self.b.tree
        both = ta.radius[u] + tb.radius[v]
        alive = cosine >= 1 - (REACH + both) ** 2 / 2 - self.slack
        u, v, cosine, both = u[alive], v[alive], cosine[alive], both[alive]
        points = (a.size[u] == 1) & (b.size[v] == 1)
        if points.any():
            self._decide(ta.start[u[points]], tb.start[v[points]], cosine[points])
        whole = ~points & (both <= REACH) & (cosine >= 1 - np.maximum(REACH - both, 0) ** 2 / 2 + self.slack)
        x, y = u[whole], v[whole]
        a.gained += _sums(x, b.weight[y], len(a.gained))
        b.gained += _sums(y, a.weight[x], len(b.gained))
        unite(self.label, ta.start[x], tb.start[y] + self.shift)
        a.joined[x] = True
        b.joined[y] = True
        few = ~points & ~whole & (a.size[u] * b.size[v] <= SMALL * SMALL)
        if few.any():
            self.small.append((u[few], v[few]))
        rest = ~points & ~whole & ~few
        self.stack.extend(zip(u[rest].tolist(), v[rest].tolist()))

    def _points_of(self, u: np.ndarray, v: np.ndarray) -> None:
        """Compares all points of pairs of small nodes."""
        a, b, ta, tb = self.a, self.b, self.a.tree, self.b.tree
        work = np.cumsum(a.size[u] * b.size[v])
        cuts = np.searchsorted(work, np.arange(PAIRS, work[-1] + PAIRS, PAIRS), side="right")
        for x, y in zip(np.split(u, cuts), np.split(v, cuts)):
            n = a.size[x] * b.size[y]
            k = np.repeat(np.arange(len(x)), n)
            at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            i, j = ta.start[x][k] + at // b.size[y][k], tb.start[y][k] + at % b.size[y][k]
            if self.same:
                half = (x[k] != y[k]) | (i < j)
                i, j = i[half], j[half]
            if len(i):
                self._decide(i, j, np.einsum("ij,ij->i", ta.points[i], tb.points[j]).astype(np.float64))

    def _decide(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        """Links pairs of points; close calls are made in double precision."""
        a, b = self.a, self.b
        linked = cosine >= THRESHOLD + self.slack
        close = np.flatnonzero(~linked & (cosine >= THRESHOLD - self.slack))
        if len(close):
            x, y = a.raw[i[close]].astype(np.float64), b.raw[j[close]].astype(np.float64)
            exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            linked[close] = exact >= THRESHOLD
        i, j = i[linked], j[linked]
        a.own += _sums(i, b.copies[j], len(a.own))
        b.own += _sums(j, a.copies[i], len(b.own))
        unite(self.label, i, j + self.shift)


def _by_radius(tree: Tree, nodes: np.ndarray) -> list[np.ndarray]:
    single = tree.radius[nodes] == 0
    return [part for part in (nodes[single], nodes[~single]) if len(part)]


# -- Spark --------------------------------------------------------------------


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (``vec_id, k1, k2``: what stands for the vector, null if it is of no use) and the classes."""
    usable = F.expr(
        "size(embedding) > 0 AND exists(embedding, x -> coalesce(x <> 0, false))"
        " AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.select(
        "vec_id",
        F.when(F.col("usable"), F.xxhash64("embedding")).alias("k1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding")).alias("k2"),
        "embedding",
    )
    classes = (
        rows.where("k1 IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return rows.drop("embedding"), staged(classes, "vectors")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _in_cells(classes: DataFrame, seeds: np.ndarray, element: str) -> DataFrame:
    """``node, copies, embedding, cell, away``: each vector's nearest seed and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = _slack(seeds.shape[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cosine = unit(_matrix(part.column(2))) @ seeds.T
                cell = cosine.argmax(1)
                away = _distance(cosine.max(1).astype(np.float64) - slack)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["node", "copies", "embedding", "cell", "away"]
                )

    schema = f"node bigint, copies bigint, embedding array<{element}>, cell int, away double"
    return staged(map_batches(classes.select("node", "copies", "embedding"), run, schema), "cells")


def _packed(seeds: np.ndarray, sizes: np.ndarray, radii: np.ndarray, most: int) -> tuple[list[tuple], list[tuple]]:
    """(cell, group, first block, blocks) for each cell, and (group, [(first, last block in reach)]) for each group.

    Cells come in tree order, so a group of small ones is one block of neighbours; a large cell is a group of several."""
    cells, groups, block, size = [], [], 0, 0
    for cell, n in enumerate(sizes):
        blocks = -(-int(n) // most)
        if blocks > 1 or not groups or groups[-1][1] > 1 or size + n > most:
            groups.append((block, max(blocks, 1), cell))
            block += max(blocks, 1)
            size = 0
        size += n
        cells.append((cell, len(groups) - 1, groups[-1][0], groups[-1][1]))
    away = _distance(seeds.astype(np.float64) @ seeds.T.astype(np.float64) + _slack(seeds.shape[1]))
    near = (away - radii[:, None] - radii[None, :] <= REACH) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    cuts = [g[2] for g in groups]
    near = np.logical_or.reduceat(np.logical_or.reduceat(near, cuts, 0), cuts, 1)
    reach = []
    for g, row in enumerate(near):
        ranges: list[list[int]] = []
        for other in np.flatnonzero(row):
            first, n, _ = groups[other]
            if ranges and ranges[-1][1] == first - 1:
                ranges[-1][1] = first + n - 1
            else:
                ranges.append([first, first + n - 1])
        reach.append((g, ranges))
    return cells, reach


_BLOCK = (
    "block int, group int, ids array<bigint>, copies array<bigint>, vectors array<{element}>, start array<int>,"
    " end array<int>, centre array<int>, radius array<double>, first array<int>, last array<int>"
)


def _trees(cells: DataFrame, element: str) -> DataFrame:
    """A row for each block: its points in tree order, and the tree."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        raw = _matrix(group.column("embedding"))
        tree, order = build(unit(raw))
        ids, copies = (group.column(c).to_numpy()[order] for c in ("node", "copies"))
        ints = (tree.start, tree.end, tree.centre)
        lists = [ids, copies, raw[order].ravel(), *(x.astype(np.int32) for x in ints), tree.radius]
        lists += [x.astype(np.int32) for x in (tree.first, tree.last)]
        names = "block group ids copies vectors start end centre radius first last".split()
        arrays = [pa.array([k.as_py()], pa.int32()) for k in key]
        for values in lists:
            flat = pa.array(values)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.Table.from_arrays(arrays, names)

    return staged(cells.groupBy("block", "group").applyInArrow(run, _BLOCK.format(element=element)), "trees")


def _opened(row: pa.Table, k: int) -> Block:
    get = lambda name: row.column(name)[k].values.to_numpy()
    ids = get("ids")
    raw = get("vectors").reshape(len(ids), -1)
    tree = Tree(unit(raw), *(get(n) for n in ("start", "end", "centre", "radius", "first", "last")))
    return Block(ids, get("copies"), raw, tree)


def _meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    blocks = [_opened(group, k) for k in range(group.num_rows)]
    a, b = blocks[0], blocks[-1]
    label = Traversal(a, b).run()
    ids, links = a.ids, a.links()
    if b is not a:
        ids, links = np.concatenate([a.ids, b.ids]), np.concatenate([links, b.links()])
    linked, led = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
    return pa.table(
        {
            "node": pa.array(np.concatenate([ids[linked], ids[led]])),
            "other": pa.array([None] * len(linked) + ids[label[led]].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[linked], np.zeros(len(led), np.int64)])),
        }
    )


def _links(classes: DataFrame, dim: int) -> DataFrame:
    """``node, other, links`` of the vectors of one length: links that a node gained somewhere (``other`` is null), and
    edges of spanning forests."""
    spark = classes.sparkSession
    ship_package(spark)
    classes = classes.where(F.size("embedding") == dim)
    element = dict(classes.dtypes)["embedding"][len("array<") : -1]
    taken = classes.orderBy("k1", "k2").select("embedding").limit(max(1, min(SEEDS, SEED_BYTES // (8 * dim)))).collect()
    seeds = unit(np.array([r["embedding"] for r in taken], np.float64))
    seeds = build(seeds)[0].points
    cells = _in_cells(classes, seeds, element)
    sizes, radii = np.zeros(len(seeds), np.int64), np.zeros(len(seeds))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["away"]
    most = min(MOST_BLOCK, max(LEAST_BLOCK, int(sizes.sum()) // 24))
    packed, reach = _packed(seeds, sizes, radii, most)
    places = spark.createDataFrame(packed, "cell int, group int, block int, n int")
    dealt = cells.join(F.broadcast(places), "cell").withColumn("block", F.expr("CAST(block + pmod(xxhash64(node), n) AS INT)"))
    blocks = _trees(dealt.select("block", "group", "node", "copies", "embedding"), element)
    partners = spark.createDataFrame(reach, "group int, ranges array<array<int>>")
    pairs = (
        blocks.join(F.broadcast(partners), "group")
        .withColumn("range", F.explode("ranges"))
        .withColumn("other", F.explode(F.expr("sequence(range[0], range[1])")))
        .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
        .drop("ranges", "range", "other", "block", "group")
    )
    n = packed[-1][2] + packed[-1][3]
    # A pair is much work and few bytes, so it must not be put with others by its size.
    tasks = max(1, min(n * (n + 1) // 2, 8 * spark.sparkContext.defaultParallelism))
    met = pairs.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(_meet, "node bigint, other bigint, links bigint")
    return staged(met, "vector-links")


def link_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: the other rows linked directly, and the smallest id in reach by links."""
    rows, classes = _classes(vectors)
    lengths = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    n_links, component = F.lit(0).cast("bigint"), F.col("vec_id")
    found = classes.select("node", "k1", "k2", "vec_id", "copies")
    if lengths:
        links = [_links(classes, dim) for dim in sorted(lengths)]
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        counted = every.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
        joined = components(every.where("other IS NOT NULL"), "node", "other")
        of = staged(
            found.join(counted, "node", "left")
            .join(joined, "node", "left")
            .withColumn("component", F.coalesce("component", "node")),
            "vector-groups",
        )
        least = of.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        found = of.join(least, "component").select("k1", "k2", "component_id", F.expr("coalesce(links, 0) + copies - 1 AS n_links"))
        found = F.broadcast(found) if fits_broadcast(found) else found
        rows = rows.join(found, ["k1", "k2"], "left")
        n_links = F.coalesce("n_links", n_links)
        component = F.when(F.col("k1").isNull(), component).otherwise(F.col("component_id"))
    return rows.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


ORACLE = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
near AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
    WHERE list_cosine_similarity(a.w, b.w) >= {THRESHOLD}),
reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT r.vec_id, n.b FROM reached AS r JOIN near AS n ON n.a = r.other),
grouped AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM near WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM grouped
"""
