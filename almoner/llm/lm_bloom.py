"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Unigram and bigram counts of all training texts are quantised to levels 1 + floor(log2 c); an
n-gram of level q is put into the filter as (n-gram, 1) ... (n-gram, q). To read a count back
the filter is probed with (n-gram, 1), (n-gram, 2), ... until a probe misses. The filter is
cut into segments by the hash of the n-gram. Each segment is made from one group of rows, has ``BITS_PER_ENTRY`` bits or more for
each of its entries, and answers the probes that are sent to it there. So every counted n-gram is in the filter, it
grows with the input, and it is never in one place.

    p(w | v) = L * min(1, c(v w) / c(v)) + (1 - L) * p(w),  p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

with quantised counts (the geometric middle of the level) and L = 0 where the filter has no c(v w).
The first token's v is the start of the text.

Beside it stands the exact unigram base of the contract. The exact counts come back with the answers.

1. Texts are turned into chunks of about ``TOKENS_AT_ONCE`` tokens, which are staged in pieces of about ``PIECE_TOKENS``: no row or batch is as large as a chunk.
2. Each chunk sends its distinct n-grams, with their counts in its training texts, to their segments.
3. Each segment adds the counts up, builds its part of the filter and answers every chunk with the levels (and counts) in the order they came.
4. Each chunk puts the answers together and scores its texts.

Where a chunk's pieces are read by more than one task, what a task has of it is a run, named by its first piece, and asks for itself.

Tokens are the words of a text with A-Z lower-cased, and one end token. Tokens and n-grams are
counted by 64-bit hashes. Rows: null texts count as empty, so they have one token, the end. Rows
without an id are scored, not learnt from. Repeated rows count, and are scored, each time. With
nothing to learn from, N = V = 0 and each token has the probability 1. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from almoner.llm.common import held_out, learnt, map_batches, mixed, slices, staged, word_hashes

SMOOTHING = 0.1
MIX = 0.7
PROBES = 3
BITS_PER_ENTRY = 9
LEAST_BYTES = 1 << 12
LEVELS = 48
TOKENS_PER_SEGMENT = 1 << 21
MOST_SEGMENTS = 1 << 20
TOKENS_AT_ONCE = 2_000_000
PIECE_TOKENS = 1 << 17
NGRAMS_AT_ONCE = 1 << 16
# Spark reads a row group at once, and Parquet looks at a group's size after 100 rows if not told otherwise.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4}
BLOCK = 1 << 15
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_UP, _MIX1 = np.uint64(32), np.uint64(0x9E3779B97F4A7C15)

def bigram_hashes(tokens: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The hash of each token with the one before it; ``starts`` are the places where texts begin."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0 if starts is None else starts] = START
    return mixed(before * _MIX1 + tokens)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64))


_SALTS = [np.uint64(int(_MIX1) * q % (1 << 64)) for q in range(LEVELS + 1)]

_BITS = np.left_shift(1, np.arange(8)).astype(np.uint8)

# The geometric middle of the counts of a level; 0 for none.
LEVEL_COUNT = np.concatenate([[0.0, 1.0], 2.0 ** (np.arange(2, LEVELS + 1) - 0.5)])


class Filter:
    """Segments of bits; the segment of an n-gram is named by the top bits of its hash."""

    def __init__(self, segments: int, segment_bytes: int, data: np.ndarray):
        self.shift = np.uint64(64 - (segments.bit_length() - 1))
        self.segments, self.data = segments, data
        # Both are powers of two.
        self.bits, self.within = np.uint64(segment_bytes * 8), np.uint64(segment_bytes * 8 - 1)

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> self.shift if self.segments > 1 else np.zeros(len(hashes), np.uint64)

    def salted(self, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of (n-gram, level) begin, and how far they are apart."""
        mix = mixed(hashes + _SALTS[level])
        return mix, (mix >> _UP) | np.uint64(1)

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes go on until one misses. A block is read at a time."""
        level = np.zeros(len(hashes), np.uint8)
        for at in range(0, len(hashes), BLOCK):
            level[at : at + BLOCK] = self._read_block(hashes[at : at + BLOCK])
        return level

    def _read_block(self, hashes: np.ndarray) -> np.ndarray:
        level = np.zeros(len(hashes), np.uint8)
        left, first = np.arange(len(hashes)), self.segment(hashes) * self.bits
        for q in range(1, LEVELS + 1):
            start, step = self.salted(hashes, q)
            hit = np.ones(len(hashes), bool)
            for _ in range(PROBES):
                bit = first + (start & self.within)
                hit &= (self.data[bit >> np.uint64(3)] & _BITS[bit & np.uint64(7)]) != 0
                start += step
            left, hashes, first = left[hit], hashes[hit], first[hit]
            if not len(left):
                break
            level[left] = q
        return level


def filter_segment(hashes: np.ndarray, level: np.ndarray, segments: int, segment_bytes: int) -> bytes:
    """The bytes of the one segment that all these n-grams belong to."""
    own = Filter(segments, segment_bytes, np.zeros(0, np.uint8))
    data = np.zeros(segment_bytes, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        start, step = own.salted(hashes[level >= q], q)
        for probe in range(PROBES):
            bit = (start + step * np.uint64(probe)) & own.within
            np.bitwise_or.at(data, bit >> np.uint64(3), np.left_shift(1, bit & np.uint64(7)).astype(np.uint8))
    return data.tobytes()


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens and the place where each text begins; a text has one token at least, its end."""
    hashes, counts = word_hashes(texts, lower=True)
    tokens = np.full(len(hashes) + len(texts), END, np.uint64)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts)] = hashes
    return tokens, np.concatenate([[0], np.cumsum(counts + 1)[:-1]])


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same hashes added up."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(fresh)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _one(values: pa.Array | np.ndarray) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _numpy(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy() if isinstance(values, pa.ChunkedArray) else values.to_numpy(zero_copy_only=False)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """A row of bytes for the values from each place in ``ends`` to the next one."""
    values = np.ascontiguousarray(values[ends[0] : ends[-1]])
    offsets = ((ends - ends[0]) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows in turn, and how many each row has."""
    lengths = _numpy(pa.compute.binary_length(column)).astype(np.int64) // np.dtype(dtype).itemsize
    rows = [np.frombuffer(value.as_buffer(), dtype) for value in column]
    return np.concatenate([np.zeros(0, dtype), *rows]), lengths


_PIECE = ("doc_id", "held_out", "learnt", "size", "words", "token")
_PIECES = "chunk bigint, piece int, doc_id array<bigint>, held_out array<boolean>, learnt array<boolean>, size array<bigint>, words binary, token binary"


def _chunks(documents: DataFrame, folds: int) -> DataFrame:
    """A few rows for each chunk, its pieces: a piece has its rows in turn, its distinct tokens in the order of their hashes, and the place among them of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, piece, pending, own_tokens = TaskContext.get().partitionId() << 32, 0, 0, 0
        rows: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            words, token = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            token = token.astype(np.uint16 if len(words) <= 1 << 16 else np.int32)
            lists = [_one(pa.concat_arrays([r.column(i) for r in rows])) for i in range(3)]
            lists.append(_one(np.concatenate([n for _, n in found])))
            packed = [_packed(values, np.array([0, len(values)])) for values in (words, token)]
            columns = [pa.array([chunk]), pa.array([piece], pa.int32()), *lists, *packed]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "piece", *_PIECE])

        for batch in batches:
            for part in slices(batch, chars=3 * PIECE_TOKENS):
                tokens, starts = token_hashes(part.column(0).to_pylist())
                rows.append(part.select([1, 2, 3]))
                found.append((tokens, np.diff([*starts, len(tokens)])))
                pending += len(tokens)
                if pending >= min(PIECE_TOKENS, TOKENS_AT_ONCE - own_tokens):
                    yield made()
                    piece, pending, own_tokens = piece + 1, 0, own_tokens + pending
                    if own_tokens >= TOKENS_AT_ONCE:
                        chunk, piece, own_tokens = chunk + 1, 0, 0
                    rows.clear()
                    found.clear()
        if rows:
            yield made()

    doc_id = F.col("doc_id")
    given = documents.select(
        "text", doc_id.cast("bigint").alias("doc_id"), held_out(doc_id, folds).alias("held_out"), learnt(doc_id, folds).alias("learnt")
    )
    return staged(map_batches(given, run, _PIECES), "lm-chunks", SMALL_GROUPS)


def _piece(table: pa.RecordBatch | pa.Table, i: int) -> dict[str, pa.Array | pa.Buffer]:
    row = {name: table.column(name)[i] for name in _PIECE}
    return {name: value.as_buffer() if name in ("words", "token") else value.values for name, value in row.items()}


def _joined(pieces: list[dict[str, pa.Array | pa.Buffer]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of pieces that follow each other, the place among them of every token, and the size of every text."""
    own = [np.frombuffer(p["words"], np.uint64) for p in pieces]
    sizes = [_numpy(p["size"]) for p in pieces]
    words = np.unique(np.concatenate(own))
    places = []
    for piece, known, size in zip(pieces, own, sizes):
        token = np.frombuffer(piece["token"], np.uint16 if len(piece["token"]) == 2 * size.sum() else np.int32)
        places.append(np.searchsorted(words, known)[token])
    return words, np.concatenate(places), np.concatenate(sizes)


def _starts(size: np.ndarray) -> np.ndarray:
    """The places where texts begin."""
    return np.concatenate([[0], np.cumsum(size)[:-1]])


_NGRAMS = "chunk bigint, run int, segment int, bigram boolean, h binary, n binary"


def _ngrams(chunks: DataFrame, segments: int) -> DataFrame:
    """The distinct n-grams of each run with their counts in its training texts: a row for each segment and order.

    There are so many segments that one holds about ``TOKENS_PER_SEGMENT`` tokens. Frequent n-grams leave a chunk once."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def sent(chunk: int, first: int, pieces: list[dict[str, pa.Array | pa.Buffer]]) -> Iterator[pa.RecordBatch]:
        words, place, size = _joined(pieces)
        counted = np.repeat(np.concatenate([_numpy(p["learnt"]) for p in pieces]).astype(bool), size)
        pairs = bigram_hashes(words[place], _starts(size))
        for bigram in (False, True):
            if bigram:
                hashes, counts = _summed(pairs, counted.astype(np.int64))
            else:
                hashes, counts = words, np.bincount(place[counted], minlength=len(words))
            used, begin = np.unique(hashes >> shift, return_index=True)  # hashes are sorted, so segments are too
            ends, at = np.append(begin, len(hashes)), 0
            while at < len(used):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + NGRAMS_AT_ONCE, "right")) - 1)
                columns = [
                    pa.array(np.full(to - at, chunk)),
                    pa.array(np.full(to - at, first, np.int32)),
                    pa.array(used[at:to].astype(np.int32)),
                    pa.array(np.full(to - at, bigram)),
                    _packed(hashes, ends[at : to + 1]),
                    _packed(counts.astype(np.int32, copy=False), ends[at : to + 1]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "run", "segment", "bigram", "h", "n"])
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = first = None
        pieces: list[dict[str, pa.Array | pa.Buffer]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                own, piece = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if pieces and (own, piece) != (chunk, first + len(pieces)):
                    yield from sent(chunk, first, pieces)
                    pieces.clear()
                if not pieces:
                    chunk, first = own, piece
                pieces.append(_piece(batch, i))
        if pieces:
            yield from sent(chunk, first, pieces)

    return map_batches(chunks, run, _NGRAMS)


def answers(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Level by the filter and exact count of each n-gram of a segment, and how many were counted.

    An n-gram comes once for each chunk; its counts are added up, and it is put into the filter however rare it is."""
    stored, total = _summed(hashes, counts)
    stored, total = stored[total > 0], total[total > 0]
    level = levels(total)
    size = LEAST_BYTES
    while size * 8 < int(level.sum()) * BITS_PER_ENTRY:
        size *= 2
    data = np.frombuffer(filter_segment(stored, level, 1, size), np.uint8)
    at = np.minimum(np.searchsorted(stored, hashes), max(0, len(stored) - 1))
    exact = np.where(stored[at] == hashes, total[at], 0) if len(stored) else np.zeros(len(hashes), np.int64)
    return Filter(1, size, data).read(hashes), exact, len(stored)


_ANSWERS = "chunk bigint, run int, segment int, bigram boolean, level binary, n binary, tokens bigint, distinct bigint"


def _answers(ngrams: DataFrame) -> DataFrame:
    """For each row of ``ngrams`` the levels, and for tokens the exact counts. The segment's sums stand in one of its rows."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        hashes, lengths = _unpacked(group.column("h"), np.uint64)
        counts = _unpacked(group.column("n"), np.int32)[0].astype(np.int64)
        level, exact, distinct = answers(hashes, counts)
        bigram, sums = key[1].as_py(), np.zeros((2, len(lengths)), np.int64)
        if not bigram:
            sums[:, 0] = counts.sum(), distinct
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.table(
            {
                "chunk": group.column("chunk"),
                "run": group.column("run"),
                "segment": group.column("segment"),
                "bigram": group.column("bigram"),
                "level": _packed(level.astype(np.uint8, copy=False), ends),
                "n": _packed(exact.astype(np.int64, copy=False), np.zeros_like(ends) if bigram else ends),
                "tokens": pa.array(sums[0]),
                "distinct": pa.array(sums[1]),
            }
        )

    return staged(ngrams.groupBy("segment", "bigram").applyInArrow(run, _ANSWERS), "lm-answers", SMALL_GROUPS)


def _log_probability(count: np.ndarray, pair: np.ndarray, starts: np.ndarray, total: float) -> np.ndarray:
    """log10 of the model's probability of each token, from the filter's counts of tokens and bigrams."""
    unigram = np.minimum(1.0, (count + SMOOTHING) / total)
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[starts] = 0  # what follows the start of a text is not conditioned on a count
    known = (pair > 0) & (before > 0)
    bigram = np.minimum(1.0, pair / np.maximum(before, 1.0))
    return np.log10(np.where(known, MIX * bigram + (1 - MIX) * unigram, unigram))


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_corpus(documents: DataFrame, folds: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    # Words are at least one character and a blank apart; texts hold about six characters for each.
    chars = documents.agg(F.sum(F.char_length("text"))).first()[0] or 0
    segments = 16
    while segments < MOST_SEGMENTS and segments * TOKENS_PER_SEGMENT < chars // 6:
        segments *= 2
    chunks = _chunks(documents, folds)
    found = _answers(_ngrams(chunks, segments))
    learnt_tokens, distinct = (x or 0 for x in found.agg(F.sum("tokens"), F.sum("distinct")).first())
    # The denominator of a unigram probability.
    total = learnt_tokens + SMOOTHING * (distinct + 1) if learnt_tokens else SMOOTHING

    def scored(pieces: list[dict[str, pa.Array | pa.Buffer]], parts: pa.Table) -> pa.Table:
        words, place, size = _joined(pieces)
        starts = _starts(size)
        level, exact = _unpacked(parts.column("level"), np.uint8)[0], _unpacked(parts.column("n"), np.int64)[0]
        of_token, of_pair = level[: len(exact)], level[len(exact) :]
        count = exact[place]
        pair = LEVEL_COUNT[of_pair[np.unique(bigram_hashes(words[place], starts), return_inverse=True)[1]]]
        base = np.log10((count + SMOOTHING) / total)
        score = _log_probability(LEVEL_COUNT[of_token][place], pair, starts, total)
        return pa.table(
            {
                "doc_id": pa.concat_arrays([p["doc_id"] for p in pieces]),
                "held_out": pa.concat_arrays([p["held_out"] for p in pieces]),
                "n_tokens": pa.array(size),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(starts), learnt_tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(score, starts)),
            }
        )

    def run(own: pa.Table, parts: pa.Table) -> pa.Table:
        order = np.argsort(_numpy(own.column("piece")))
        pieces = [_piece(own, int(i)) for i in order]
        # Segments in turn hold the n-grams of a run in the order of their hashes.
        runs = _numpy(parts.column("run"))
        order = np.lexsort((_numpy(parts.column("segment")), _numpy(parts.column("bigram")), runs))
        first, begin = np.unique(runs[order], return_index=True)
        found = []
        for piece, after, at, to in zip(first, [*first[1:], len(pieces)], begin, [*begin[1:], len(runs)]):
            found.append(scored(pieces[piece:after], parts.take(pa.array(order[at:to]))))
        return pa.concat_tables(found)

    asked = found.select("chunk", "run", "segment", "bigram", "level", "n")
    return chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, _SCORES)
