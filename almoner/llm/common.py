"""What the operators of this subpackage share: folds, words, staging, keys of rows."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almoner.session import fresh_dir

# White space of a text: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
BATCH_BYTES = 1 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def held_out(doc_id: Column, folds: int) -> Column:
    """True for rows whose crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learnt(doc_id: Column, folds: int) -> Column:
    """True for the rows a model may learn from. A row without an id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def staged(df: DataFrame, purpose: str, options: dict[str, object] | None = None) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: the rows are
    fixed, later plans start there, and a lost executor loses nothing. ``options`` are the writer's."""
    folder = fresh_dir(df.sparkSession, purpose)
    df.write.options(**(options or {})).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors, once for each application."""
    context = spark.sparkContext
    if any(Path(p).name == "almoner.zip" for p in context._python_includes):
        return
    root = Path(__file__).resolve().parents[1]
    place = os.path.join(tempfile.mkdtemp(prefix="almoner-"), "almoner.zip")
    with zipfile.ZipFile(place, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(place)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors.

    A session without a bound of its own for the bytes of an Arrow batch gets ``BATCH_BYTES``, so that what a task
    holds beside its heap does not hang on how long texts are. A worker lives on after its task and serves other
    operators, so it gives Arrow's free memory back."""
    spark = df.sparkSession
    ship_package(spark)
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose first string column stays near ``chars`` bytes, so that
    memory does not hang on how long the texts are. A single row is never split."""
    column = next((c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), None)
    start = size = 0
    lengths = pa.compute.binary_length(column).fill_null(0).to_pylist() if column is not None else [0] * batch.num_rows
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or size + n > chars):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_key(text: Column) -> Column:
    """64 bits that stand for a text; null has its own value."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


class Remembered(dict):
    """A dict that works out missing values. When it is half full the values in use lately
    are kept and the others forgotten, so a worker's memory is bounded whatever the vocabulary."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.turn()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Forgets the older values; the others become the older ones."""
        self.older = dict(self)
        self.clear()


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_VALUES = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE_BYTES = 1 << 17


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    for _ in range(2):
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of the texts in turn, and how many words each text has.

    A hash is a polynomial over random values of the word's bytes, so all words of a piece come from one running
    sum. ``lower`` makes A-Z equal to a-z."""
    encoded = [(text or "").encode() for text in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    values = _LOWER_VALUES if lower else _VALUES
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        space = _SPACE[data[at:end]]
        while not space[-1]:  # cut behind a space; a longer word is taken whole
            last = np.flatnonzero(space)
            if len(last):
                space = space[: last[-1] + 1]
            else:
                end = min(end + PIECE_BYTES, len(data))
                space = _SPACE[data[at:end]]
        n = len(space)
        power, inverse = _power_tables(max(n, PIECE_BYTES))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[at : at + n]] * power[:n], out=total[1:])
        change = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = change[::2], change[1::2]
        hashes.append(mixed((total[ends] - total[starts]) * inverse[starts]))
        places.append(starts + at)
        at += n
    ends = np.cumsum([len(e) + 1 for e in encoded])
    counts = np.diff(np.searchsorted(np.concatenate(places), ends), prepend=0) if texts else np.zeros(0, np.int64)
    return np.concatenate(hashes), counts
