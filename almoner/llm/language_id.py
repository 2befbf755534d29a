"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters is bound into one vector:
the first letter's vector rotated twice times the second's rotated once times the third's.
A text is the bundle (sum) of its trigram vectors, brought to length 1; a language is the bundle
of its texts. The language of a text is the prototype with the largest cosine.

Letters are lower-cased; a to z have a class each, the other letters share classes by their
code point, and everything else is one space class, so trigrams also hold word edges.
Counting trigrams comes first, so a text costs its distinct trigrams times the dimension.

Rows: null texts and texts without a letter give ``und`` with score 0, as does any text when
nothing could be learnt. Equal cosines give the first language by name. Long texts are counted
in pieces, with the same result. Repeated rows count, and are answered, each time.
The number of languages must be at most ``MOST_LANGUAGES``, else it is an error: prototypes
are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almoner.llm.common import held_out, learnt, map_batches, slices, staged

DIMENSION = 512
CLASSES = 64
OTHER_LETTERS = 37  # classes 27 to 63
PIECE = 1_000_000  # letters counted at a time
COLUMNS = 4096  # trigrams multiplied at a time
MOST_LANGUAGES = 10_000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letter_vectors() -> np.ndarray:
    draw = np.random.default_rng(11)
    return draw.choice(np.array([-1, 1], np.float32), (CLASSES, DIMENSION))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            small = ord(letter.lower()[0])
            table[point] = small - 96 if 97 <= small <= 122 else 27 + small * 40503 % 65521 % OTHER_LETTERS
    return table


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    letters = _letter_vectors()
    first, second, third = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
    return np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]


def trigram_codes(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text with a space before and after it, piece by piece; runs of
    spaces count as one. A letter takes one byte until its trigram is made."""
    table = _classes()
    pieces = [text[at : at + PIECE].encode("utf-32-le", "surrogatepass") for at in range(0, len(text), PIECE)]
    space = np.zeros(1, np.uint8)
    letters = np.concatenate([space, *(table[np.frombuffer(p, np.uint32)] for p in pieces), space])
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    letters = letters[keep]
    for at in range(0, len(letters) - 2, PIECE):
        part = letters[at : at + PIECE + 2].astype(np.int32)
        yield part[:-2] * CLASSES**2 + part[1:-1] * CLASSES + part[2:]


def text_vectors(texts: list[str]) -> np.ndarray:
    """A vector of length 1 for each text; zeros where it has no letter."""
    out = np.zeros((len(texts), DIMENSION), np.float32)
    rows, codes = [], []
    pending = 0

    def flush() -> None:
        nonlocal pending
        if pending:
            _bundle(out, np.concatenate(rows), np.concatenate(codes))
        rows.clear()
        codes.clear()
        pending = 0

    for i, text in enumerate(texts):
        for found in trigram_codes(text):
            rows.append(np.full(len(found), i, np.int64))
            codes.append(found)
            pending += len(found)
            if pending >= PIECE:
                flush()
    flush()
    lengths = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, lengths, out=out, where=lengths > 0)


def _bundle(out: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
    """Adds the trigram vectors of each row: a table of counts times the vectors, a block of
    trigrams at a time."""
    low, high = int(rows[0]), int(rows[-1]) + 1
    used, place = np.unique(codes, return_inverse=True)
    for at in range(0, len(used), COLUMNS):
        block = used[at : at + COLUMNS]
        here = (place >= at) & (place < at + len(block)) if len(used) > COLUMNS else slice(None)
        cells = (rows[here] - low) * len(block) + (place[here] - at)
        counts = np.bincount(cells, minlength=(high - low) * len(block)).reshape(high - low, len(block))
        out[low:high] += counts.astype(np.float32) @ trigram_vectors(block)


def train(documents: DataFrame, folds: int = 5) -> tuple[list[str], np.ndarray]:
    """Names and prototypes of the languages of the rows outside the held-out fold."""
    rows = documents.where(
        learnt(F.col("doc_id"), folds) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select(F.col("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, rows=256):
                vectors = text_vectors(part.column(0).to_pylist())
                names = np.array(part.column(1).to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + vectors[names == name].sum(0, dtype=np.float64)
            if len(sums) > 64:
                yield _rows(sums)
                sums = {}
        if sums:
            yield _rows(sums)

    partial = map_batches(rows, run, "lang string, i int, v double")
    bundles = staged(partial.groupBy("lang", "i").agg(F.sum("v").alias("v")), "language-profiles")
    n = bundles.where("i = 0").count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages, at most {MOST_LANGUAGES} are supported")
    found: dict[str, np.ndarray] = {}
    for lang, i, v in bundles.collect():
        found.setdefault(lang, np.zeros(DIMENSION))[i] = v
    names = sorted(found)
    prototypes = np.array([found[name] for name in names]).reshape(len(names), DIMENSION)
    lengths = np.sqrt((prototypes**2).sum(1, keepdims=True))
    return names, np.divide(prototypes, lengths, out=np.zeros_like(prototypes), where=lengths > 0).astype(np.float32)


def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = [name for name in sums for _ in range(DIMENSION)]
    places = np.tile(np.arange(DIMENSION, dtype=np.int32), len(sums))
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(places), pa.array(np.concatenate(list(sums.values())))], ["lang", "i", "v"]
    )


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; score is (1 + cosine) / 2."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text"),
        held_out(F.col("doc_id"), folds).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    names, prototypes = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=256):
                lettered = np.array(part.column(3).to_pylist(), bool)
                best, score = np.full(part.num_rows, UNDETERMINED, object), np.zeros(part.num_rows)
                if names and lettered.any():
                    texts = part.column(1).filter(part.column(3)).to_pylist()
                    cosines = text_vectors(texts) @ prototypes.T
                    best[lettered] = np.array(names, object)[cosines.argmax(1)]
                    score[lettered] = np.clip((1 + cosines.max(1)) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(best.tolist(), pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return map_batches(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, folds: int = 5) -> DataFrame:
    return predict(documents, train(documents, folds), folds)
