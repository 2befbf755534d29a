"""Spelling variants: words one edit apart, found by K-d trees over letter counts.

Exchanging a letter changes a word's letter counts by an L1 distance of 2 at most, putting one in by 1. So near words of
a length are looked for within 2 among those of the same length, and within 1 among those one longer.

1. Words are counted by Spark; each task counts its own first, so a very frequent word is one row per task.
2. For each length the top of a K-d tree is cut on a bounded sample (``SAMPLE`` words), into *cells* of about ``CELL`` words
   each. Cells are boxes of letter counts that cover everything, so each word has one home cell; as a query it goes to
   every cell whose box is within its distance.
3. A task for each cell builds the K-d tree of its home words' letter counts, sends all queries down at once, leaves out
   boxes that are too far, and verifies the order of letters of what is left. A cell with more words than expected (words with
   the same letters cannot be cut apart) is dealt by hash into parts that all its queries visit; very many queries are dealt too.
4. A task returns for each word how many near words it met and the best of them, never the pairs. Their sums give the form;
   roots come from following forms by doubling steps, as each step's count is ten times the last.

Letters beyond a-z share ``OTHERS`` further counts, which can only make words look nearer before the letters are verified.

Rows: null texts have no words; a null id counts as an empty text in ``<doc_id>:<run>``. Every row counts, repeated ones too.
Ties of the largest count go to the word that is first by code points. Only ``doc_id`` and ``text`` are read. An empty table,
or one without words, gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almoner.llm.common import map_batches, ship_package, staged
from almoner.operators.lookup import fits_broadcast

LEAST_LETTERS = 7
LEAST_COUNT = 2
FACTOR = 10
FOLDS = 31
SAMPLE = 50_000
# Words beyond this length are not sampled (they may be very long); their lengths are not cut.
SAMPLED_LETTERS = 64
CELL = 32_768
QUERIES = 16 * CELL
OTHERS = 6
DIMS = 26 + OTHERS
LEAF = 16
CHUNK = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# -- words --------------------------------------------------------------------


def count_words(documents: DataFrame) -> DataFrame:
    """``word, n`` of the words that count."""
    run = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}', 0)"
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.expr(run)).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = "CAST(h % length(run) AS INT)"
    word = f"IF(h % {FOLDS} = 0, concat(left(run, {place}), substring(run, {place} + 2)), run)"
    words = hashed.select(F.expr(word).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts of a to z and of the folded other letters, for words in Latin-1."""
    data = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    dim = np.where((data >= 97) & (data <= 122), data.astype(np.int64) - 97, 26 + data % OTHERS)
    return np.bincount(row * DIMS + dim, minlength=len(words) * DIMS).reshape(len(words), DIMS).astype(np.int32)


# -- cells --------------------------------------------------------------------


class Cells:
    """Boxes of letter counts that cover everything, for each length."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        self.n = 0

    def cut(self, length: int, sample: np.ndarray, held: int) -> None:
        """Adds the cells of a length with ``held`` words, ``sample`` of which are known."""
        whole = np.zeros(DIMS, np.int32), np.full(DIMS, length, np.int32)
        boxes, todo = [], [(sample, *whole)]
        per_word = held / max(len(sample), 1)
        while todo:
            rows, low, high = todo.pop()
            dim = int(rows.var(0).argmax()) if len(rows) else 0
            if len(rows) * per_word <= CELL or rows[:, dim].min() == rows[:, dim].max():
                boxes.append((low, high))
                continue
            # The cut nearest to the middle that leaves words on both sides.
            values, n = np.unique(rows[:, dim], return_counts=True)
            at = values[:-1][np.abs(np.cumsum(n)[:-1] * 2 - len(rows)).argmin()]
            left, right = high.copy(), low.copy()
            left[dim], right[dim] = at, at + 1
            below = rows[:, dim] <= at
            todo += [(rows[below], low, left), (rows[~below], right, high)]
        self.of[length] = self.n, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        self.n += len(boxes)

    def near(self, counts: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, distance) of the rows of ``counts`` and the cells of ``length`` within ``reach``."""
        if length not in self.of:
            return tuple(np.zeros((3, 0), np.int64))
        first, low, high = self.of[length]
        rows, cells, away = [], [], []
        for k in range(len(low)):
            d = _to_box(counts, low[k], high[k])
            hit = np.flatnonzero(d <= reach)
            rows.append(hit)
            cells.append(np.full(len(hit), first + k))
            away.append(d[hit])
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(away)


def _to_box(counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The L1 distance of each row to a box."""
    return (np.maximum(low - counts, 0) + np.maximum(counts - high, 0)).sum(1)


def _sent(words: DataFrame, cells: Cells) -> DataFrame:
    """``cell, home, word, n``: every word in its home cell and, as a query, in each cell in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            lengths = np.array([len(w) for w in given])
            out = [], [], []
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                counts = letter_counts([given[i] for i in rows])
                for other, reach in ((length, 2), (length + 1, 1)):
                    row, cell, away = cells.near(counts, other, reach)
                    home = (away == 0) & (other == length)
                    for hit, is_home in ((home, True), (np.ones(len(row), bool), False)):
                        out[0].append(rows[row[hit]])
                        out[1].append(cell[hit])
                        out[2].append(np.full(hit.sum(), is_home))
            row, cell, home = (np.concatenate(x) for x in out)
            for at in range(0, len(row), 100_000):
                part = slice(at, at + 100_000)
                taken = batch.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[part], pa.int32()), pa.array(home[part]), taken.column(0), taken.column(1)], ["cell", "home", "word", "n"]
                )

    return staged(map_batches(words.select("word", "n"), run, "cell int, home boolean, word string, n bigint"), "words-in-cells")


# -- one cell -----------------------------------------------------------------


def range_search(points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, point) within an L1 distance: all queries go down the points' K-d tree together, and at each
    node those that are too far from its box stay behind."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        held, asking = todo.pop()
        rows = points[held]
        low, high = rows.min(0), rows.max(0)
        some = [asking[at : at + 65_536] for at in range(0, len(asking), 65_536)]
        asking = np.concatenate([q[_to_box(queries[q], low, high) <= reach] for q in some]) if some else asking
        if not len(asking):
            continue
        dim = int((high - low).argmax())
        if len(held) > LEAF and high[dim] > low[dim]:
            at = min(int(np.median(rows[:, dim])), high[dim] - 1)
            below = rows[:, dim] <= at
            todo += [(held[below], asking), (held[~below], asking)]
            continue
        step = max(1, CHUNK // (len(held) * DIMS) * 4)
        for start in range(0, len(asking), step):
            part = asking[start : start + step]
            away = np.abs(queries[part][:, None, :] - rows[None, :, :]).sum(2)
            q, p = np.nonzero(away <= reach)
            yield part[q], held[p]


class Words:
    """Words of one length, as bytes and by classes of equal letter counts."""

    def __init__(self, words: list[bytes], places: np.ndarray):
        self.places = places
        self.length = len(words[0])
        counts, of = np.unique(letter_counts(words).astype(np.int16), axis=0, return_inverse=True)
        self.counts = counts
        order = np.argsort(of.ravel(), kind="stable")
        self.size = np.bincount(of.ravel(), minlength=len(counts))
        self.first = np.cumsum(self.size) - self.size
        self.places = places[order]
        wide = -(-self.length // 8) * 8
        self.letters = np.zeros((len(words), wide), np.uint8)
        data = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), self.length)
        self.letters[:, : self.length] = data[order]

    @property
    def blocks(self) -> np.ndarray:
        """The letters, eight to a number."""
        return self.letters.view(np.uint64)


_LOW, _TOP = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _one_replaced(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words of the same length differ in exactly one place."""
    alive, wrong = np.arange(len(i)), np.zeros(len(i), np.uint8)
    for k in range(a.blocks.shape[1]):
        x = a.blocks[i[alive], k] ^ b.blocks[j[alive], k]
        wrong = wrong + np.bitwise_count((((x & _LOW) + _LOW) | x) & _TOP)
        good = wrong <= 1
        alive, wrong = alive[good], wrong[good]
    return alive[wrong == 1]


def _one_inserted(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are equal but for one more letter in the second."""
    n = a.length
    left, right = a.letters[i, :n], b.letters[j, : n + 1]
    fore, aft = left != right[:, :n], (left != right[:, 1:])[:, ::-1]
    equal_fore = np.where(fore.any(1), fore.argmax(1), n)
    equal_aft = np.where(aft.any(1), aft.argmax(1), n)
    return np.flatnonzero(equal_fore + equal_aft >= n)


def near_pairs(queries: Words, homes: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the queries and homes that are one edit apart; queries have the same length or one letter less."""
    same = queries.length == homes.length
    verify = _one_replaced if same else _one_inserted
    step = CHUNK if same else max(1, 8 * CHUNK // homes.length)
    for q, h in range_search(homes.counts, queries.counts, 2 if same else 1):
        # All words of the one class with all of the other.
        n = queries.size[q] * homes.size[h]
        if same:  # words with the same letters cannot differ in one
            apart = (queries.counts[q] != homes.counts[h]).any(1) | _folded(homes.counts[h])
            q, h, n = q[apart], h[apart], n[apart]
        if not len(q):
            continue
        total = np.cumsum(n)
        for at in range(0, int(total[-1]), step):
            flat = np.arange(at, min(at + step, int(total[-1])))
            k = np.searchsorted(total, flat, side="right")
            flat = flat - (total[k] - n[k])
            i = queries.first[q[k]] + flat // homes.size[h[k]]
            j = homes.first[h[k]] + flat % homes.size[h[k]]
            good = verify(queries, homes, i, j)
            if len(good):
                yield queries.places[i[good]], homes.places[j[good]]


def _folded(counts: np.ndarray) -> np.ndarray:
    return counts[:, 26:].any(1)


_FOUND = "word string, n_near bigint, best struct<minus: bigint, word: string>"


def _in_cell(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    words = [w.encode("latin-1") for w in group.column("word").to_pylist()]
    n, home = group.column("n").to_numpy(), group.column("home").to_numpy(zero_copy_only=False)
    lengths = np.array([len(w) for w in words])
    reporting, met = [], []
    if home.any():
        places = np.flatnonzero(home)
        homes = Words([words[i] for i in places], places)
        for length in (homes.length, homes.length - 1):
            places = np.flatnonzero(~home & (lengths == length))
            if not len(places):
                continue
            for i, j in near_pairs(Words([words[k] for k in places], places), homes):
                reporting.append(i)
                met.append(j)
                if length != homes.length:  # words one shorter ask here, those one longer do not ask there
                    reporting.append(j)
                    met.append(i)
    out = defaultdict(list)
    if reporting:
        who, whom = np.concatenate(reporting), np.concatenate(met)
        known, at = np.unique(whom, return_inverse=True)
        rank = np.empty(len(known), np.int64)
        rank[sorted(range(len(known)), key=lambda k: words[known[k]])] = np.arange(len(known))
        order = np.lexsort((rank[at], -n[whom], who))
        who, whom = who[order], whom[order]
        start = np.flatnonzero(np.diff(who, prepend=-1))
        count = np.diff(np.append(start, len(who)))
        column = group.column("word").combine_chunks()
        out["word"] = column.take(pa.array(who[start]))
        out["best"] = column.take(pa.array(whom[start]))
        out["minus"], out["n_near"] = -n[whom[start]], count
    best = pa.StructArray.from_arrays([pa.array(out["minus"], pa.int64()), pa.array(out["best"], pa.string())], ["minus", "word"])
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()), "best": best})


# -- Spark --------------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_word, near_n`` of the words (``word, n``, unique) that have near words; the one named is that of
    the largest count."""
    spark = words.sparkSession
    ship_package(spark)
    held = {r[0]: r[1] for r in words.groupBy(F.length("word")).agg(F.count("*")).collect()}
    sample = words.where(F.length("word") <= SAMPLED_LETTERS).orderBy(F.xxhash64("word")).select("word").limit(SAMPLE)
    by_length = defaultdict(list)
    for row in sample.collect():
        by_length[len(row["word"])].append(row["word"].encode("latin-1"))
    cells = Cells()
    for length in sorted(held):
        cells.cut(length, letter_counts(by_length[length]), held[length])
    sent = _sent(words, cells)
    sizes = sent.groupBy("cell").agg(
        F.expr(f"greatest(1, ceil(count_if(home) / {CELL * 2}))").cast("int").alias("parts"),
        F.expr(f"greatest(1, ceil(count_if(NOT home) / {QUERIES}))").cast("int").alias("turns"),
    )
    sizes = staged(sizes, "cells")
    sizes = F.broadcast(sizes) if fits_broadcast(sizes) else sizes
    dealt = sent.join(sizes, "cell")
    own = "array(CAST(pmod(xxhash64(word), {0}) AS INT))"
    dealt = dealt.withColumn("part", F.explode(F.expr(f"IF(home, {own.format('parts')}, sequence(0, parts - 1))")))
    dealt = dealt.withColumn("turn", F.explode(F.expr(f"IF(home, sequence(0, turns - 1), {own.format('turns')})")))
    # A cell is much work and few bytes, so it must not be put with others by its size.
    tasks = max(1, min(cells.n, 16 * spark.sparkContext.defaultParallelism))
    dealt = dealt.select("cell", "part", "turn", "home", "word", "n").repartition(tasks, "cell", "part", "turn")
    found = dealt.groupBy("cell", "part", "turn").applyInArrow(_in_cell, _FOUND)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("near_word"), (-F.col("best.minus")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms are followed until there is none. Each round doubles the steps."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.join(now.toDF("root", "next"), "root", "left")
        after = staged(onward.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").limit(1).count() == 0:
            return after.select("word", "root")
        now = after.select("word", "root")


def group_variants(documents: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = staged(count_words(documents), "words")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= FACTOR * F.col("n")
    near = staged(
        near.select(
            "word",
            F.when(formed, F.col("near_word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(formed, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
