"""Joins that stay fast when one side is tiny and whole when one key is hot.

A side is broadcast only after its size was measured. Beyond the bound the
join is a shuffle whose hot keys adaptive execution splits, however many they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
PROBE_ROWS = 1000
# Words of the filter over a batch's keys: at most so many rows of two longs, whatever the batch.
FILTER_WORDS = 1 << 20


def _width(value: str, kind: DataType) -> str:
    """SQL for the bytes of a value; longer kinds are measured with all that is in them."""
    if isinstance(kind, (StringType, BinaryType)):
        return f"16 + coalesce(octet_length({value}), 0)"
    if isinstance(kind, VariantType):
        return f"16 + coalesce(octet_length(to_json({value})), 0)"
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if not isinstance(inner, (StringType, BinaryType, VariantType, ArrayType, MapType, StructType)):
            return f"16 + 8 * greatest(coalesce(size({value}), 0), 0)"
        return f"16 + coalesce(aggregate({value}, 0L, (total, x) -> total + {_width('x', inner)}), 0L)"
    if isinstance(kind, MapType):
        parts = ((f"map_keys({value})", kind.keyType), (f"map_values({value})", kind.valueType))
        return " + ".join(_width(part, ArrayType(inner)) for part, inner in parts)
    if isinstance(kind, StructType):
        return " + ".join(["16", *(_width(f"{value}.`{f.name}`", f.dataType) for f in kind.fields)])
    return "16"


def fits_broadcast(
    df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None
) -> bool:
    """Measures ``df`` to see if it is small.

    The widths of a few rows settle it for the usual lookup table. A larger one is
    counted whole, which moves one row per task; a limit would not be cheaper, as each
    task would ship up to ``max_rows`` rows to a single one.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    width = " + ".join(["0L", *(_width(f"`{f.name}`", f.dataType) for f in df.schema.fields)])
    widths = df.selectExpr(f"{width} AS width")
    few = [row.width for row in widths.head(PROBE_ROWS + 1)]
    if len(few) <= PROBE_ROWS:
        n, n_bytes = len(few), sum(few)
    else:
        n, n_bytes = widths.agg(F.expr("count(1)"), F.expr("sum(width)")).first()
    return n <= max_rows and n_bytes <= max_bytes


def lookup(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``fact`` joined to a table that is unique on ``key`` (same name on both sides).

    ``how``: inner, left, left_semi or left_anti. Runs jobs to measure sizes. Beyond the bound it is one
    shuffle join; adaptive execution splits the partition of a hot key and repeats the one row
    of the table that it needs.
    """
    return fact.join(F.broadcast(dim) if fits_broadcast(dim) else dim, key, how)


def may_match(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of ``wanted``, and few others, without a shuffle of ``rows``.

    A Bloom filter with one bit for each key's hash is built in Spark, in ``FILTER_WORDS`` words of 64 bits, and broadcast.
    It never has more words than that, so its size is bounded; very many keys only let more other rows through."""
    word, bit = "pmod(xxhash64({0}), {1})", "shiftleft(1L, CAST(pmod(shiftright(xxhash64({0}), 40), 64) AS INT))"
    given = ", ".join(f"`{k}`" for k in keys)
    word, bit = word.format(given, FILTER_WORDS), bit.format(given)
    words = wanted.selectExpr(f"{word} AS _word", f"{bit} AS _bit").groupBy("_word").agg(F.expr("bit_or(_bit) AS _bits"))
    hashed = rows.withColumns({"_at": F.expr(word), "_mask": F.expr(bit)})
    found = (F.col("_at") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_mask")) != 0)
    return hashed.join(F.broadcast(words), found, "left_semi").drop("_at", "_mask")


def without(
    rows: DataFrame, existing: DataFrame, keys: list[str], wanted: DataFrame | None = None
) -> DataFrame:
    """The rows whose keys are not in ``existing``. Runs a job to measure the keys.

    When the keys are few they are broadcast to ``existing``, which is then scanned but
    not shuffled. Otherwise a Bloom filter over them is, so that the shuffle carries little but matches.
    Either way each key of ``existing`` leaves a task at most once.
    ``wanted`` may give rows that hold all keys of ``rows`` and cost less to read.
    """
    known = existing.select(*keys)
    wanted = (rows if wanted is None else wanted).select(*keys)
    if fits_broadcast(wanted):
        known = known.join(F.broadcast(wanted), keys, "left_semi")
    else:
        known = may_match(known, wanted, keys)
    return rows.join(known.distinct(), keys, "left_anti")
