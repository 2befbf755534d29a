"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The bracket gives all pairwise interactions through low-rank vectors in time linear in the
number of features. Features of a text: its hashed words (weights of unit length),
structure statistics in bins (symbols, capitals, repeated lines, words and word runs, ...),
and the recorded number of characters, a metadata column, in bins.
Labels, language, source and id are never features.

Fit: a bounded sample of the labelled rows (``SAMPLE_PER_LABEL`` of each label, chosen by the hash
of the id) is collected and fitted on the driver; the intercept is then moved to the label
ratio of all labelled rows. Scoring reads every row whole.

Rows: null text counts as empty; empty texts are scored by their structure features.
Several labels of one id count as their majority, a tie as 1; null labels do not count.
With no labelled rows, or with one label only, the score is the share of label 1 (0.5 if there
are none). Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from almoner.llm.common import held_out, learnt, map_batches, slices, staged, word_hashes

WORD_BUCKETS = 1 << 15
RANK = 8
SAMPLE_PER_LABEL = 2000
SAMPLE_CHARS = 1 << 25  # characters of all sampled texts that the fit takes at most
EPOCHS = 6
RATE = 0.1
DECAY = 1e-5
KEEP_SCORE = 0.3

SYMBOLS = "#*$%&|<>{}[]~^_=+@\\"
SHARES = np.array([1e-9, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.8])
LENGTHS = np.array([1, 5, 10, 20, 50, 100, 300, 1000, 5000])
WORD_LENGTHS = np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14])
CHARS = np.array([1, 30, 100, 300, 1000, 3000, 10000, 50000, 200000])
BINS = 11  # nine edges make ten bins; the last one is for a value that is missing
STATISTICS = 10
SIZE = WORD_BUCKETS + STATISTICS * BINS


def _repeated(codes: np.ndarray, n: int) -> float:
    """Share of runs of ``n`` words that were there before."""
    if len(codes) < n + 1:
        return 0.0
    runs = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
    return 1.0 - len(np.unique(runs)) / len(runs)


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (each once) and values of the features of a text."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    codes = (word_hashes([text])[0] % np.uint64(WORD_BUCKETS)).astype(np.int64)
    used, counts = np.unique(codes, return_counts=True)
    weights = np.sqrt(counts)
    if len(codes):
        weights /= math.sqrt(counts.sum())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    shares = (
        sum(map(text.count, SYMBOLS)) / size,
        sum(map(str.isupper, words)) / max(1, n),
        1.0 - len(set(lines)) / max(1, len(lines)),
        sum(map(operator.eq, words, words[1:])) / max(1, n),
        _repeated(codes.astype(np.uint64), 5),
        len(set(words)) / max(1, n),
        sum(not w[-1].isalnum() for w in words) / max(1, n),
    )
    bins = [int(b) for b in np.searchsorted(SHARES, shares, "right")]
    bins.append(int(np.searchsorted(LENGTHS, n, "right")))
    bins.append(int(np.searchsorted(WORD_LENGTHS, size / max(1, n) - 1, "right")))
    bins.append(BINS - 1 if n_chars is None else int(np.searchsorted(CHARS, n_chars, "right")))
    index = np.concatenate([used, WORD_BUCKETS + np.arange(STATISTICS) * BINS + np.array(bins)])
    return index, np.concatenate([weights, np.ones(STATISTICS)])


@dataclass(frozen=True)
class Model:
    """Intercept, linear weights and vectors; ``None`` weights mean a constant score."""

    bias: float
    linear: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def score(self, text: str | None, n_chars: int | None) -> float:
        return _sigmoid(self.margin(*features(text or "", n_chars)) if self.linear is not None else self.bias)

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vectors = self.vectors[index] * value[:, None]
        total = vectors.sum(0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (vectors * vectors).sum()))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _fit(rows: list[tuple[str, int | None, int]], share: float) -> Model:
    """AdaGrad over the sample in a fixed order; ``share`` of label 1 among all labelled rows."""
    draw = np.random.default_rng(7)
    data = [(*features(text, n_chars), label) for text, n_chars, label in rows]
    linear, vectors = np.zeros(SIZE), draw.normal(0, 0.05, (SIZE, RANK))
    seen_linear, seen_vectors = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3)
    bias, seen_bias = 0.0, 1e-3
    for _ in range(EPOCHS):
        for i in draw.permutation(len(data)):
            index, value, label = data[i]
            own = vectors[index]
            scaled = own * value[:, None]
            total = scaled.sum(0)
            margin = bias + linear[index] @ value + 0.5 * (total @ total - (scaled * scaled).sum())
            slope = _sigmoid(float(margin)) - label
            seen_bias += slope * slope
            bias -= RATE * slope / math.sqrt(seen_bias)
            step = slope * value + DECAY * linear[index]
            seen_linear[index] += step * step
            linear[index] -= RATE * step / np.sqrt(seen_linear[index])
            step = slope * value[:, None] * (total - scaled) + DECAY * own
            seen_vectors[index] += step * step
            vectors[index] = own - RATE * step / np.sqrt(seen_vectors[index])
    ones = sum(label for *_, label in rows)
    drawn = ones / len(rows)
    bias += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    return Model(bias, linear.astype(np.float32), vectors.astype(np.float32))


def _recorded(documents: DataFrame) -> Column:
    """The metadata column, if the table has it."""
    return F.col("n_chars").cast("bigint") if "n_chars" in documents.columns else F.lit(None).cast("bigint")


def train(documents: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Learns from labelled rows outside the held-out fold."""
    majority = (
        labels.where(F.col("quality").isNotNull() & learnt(F.col("doc_id"), folds))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    majority = staged(majority, "quality-labels")
    counts = {r["label"]: r["n"] for r in majority.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({0: -20.0, 1: 20.0}.get(next(iter(counts), -1), 0.0))
    sample = None
    for label in (0, 1):
        part = majority.where(F.col("label") == label)
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL)
        sample = part if sample is None else sample.unionByName(part)
    # At most 2 * SAMPLE_PER_LABEL ids of 12 bytes.
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _recorded(documents).alias("n_chars"))
    rows = texts.join(F.broadcast(sample), "doc_id")
    taken = _bounded(rows)
    if len({label for *_, label in taken}) < 2:
        return Model(math.log(counts[1] / counts[0]))
    return _fit(taken, counts[1] / (counts[0] + counts[1]))


def _bounded(rows: DataFrame) -> list[tuple[str, int | None, int]]:
    """The sampled texts in the order of a hash, at most SAMPLE_PER_LABEL of each label (an id may have several
    rows) and half of SAMPLE_CHARS characters; sizes are measured first. A text that does not fit is left out, and
    those after it still come in."""
    rows = staged(rows.withColumns({"h": F.xxhash64("doc_id", "text"), "size": F.char_length("text")}), "quality-sample")
    wanted: list[int] = []
    for label in (0, 1):
        sizes = rows.where(F.col("label") == label).groupBy("h").agg(F.max("size").alias("size"))
        left = SAMPLE_CHARS // 2
        for h, size in sizes.where(F.col("size") <= left).orderBy("h").limit(SAMPLE_PER_LABEL).collect():
            if size <= left:
                left -= size
                wanted.append(h)
    if not wanted:
        return []
    # At most 2 * SAMPLE_PER_LABEL numbers. As an Arrow table they need no Python worker; a list of rows would leave a second set of them.
    chosen = rows.sparkSession.createDataFrame(pa.table({"h": pa.array(wanted, pa.int64())}))
    found = rows.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).orderBy("h").collect()
    return [(r["text"], r["n_chars"], r["label"]) for r in found]


def _scores(batch: pa.RecordBatch, text: int, n_chars: int | None, model: Model) -> pa.Array:
    out = []
    for part in slices(batch.select([text] if n_chars is None else [text, n_chars])):
        recorded = part.column(1).to_pylist() if n_chars is not None else [None] * part.num_rows
        out += map(model.score, part.column(0).to_pylist(), recorded)
    return pa.array(out, pa.float64())


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), _recorded(documents).alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(batch, 1, 2, model)], ["doc_id", "score"])

    return map_batches(rows, run, "doc_id bigint, score double")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score_documents(documents, train(documents, labels, folds))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` with a score of at least ``KEEP_SCORE``, all columns as they are."""
    text = documents.columns.index("text")
    n_chars = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.compute.greater_equal(_scores(batch, text, n_chars, model), KEEP_SCORE)
            yield batch.filter(good)

    return map_batches(documents, run, documents.schema)


def label_counts(scored: DataFrame, labels: DataFrame) -> Counter:
    """Held-out rows by (label, predicted); a few counts."""
    rows = scored.where("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    return Counter({(r[0], r[1]): r[2] for r in rows.groupBy("quality", "predicted").count().collect()})
