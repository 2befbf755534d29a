"""Sharding by weighted rendezvous hashing of record keys.

Every (key, shard) pair has a pseudo-random number u in (0, 1), from md5; a row goes to the shard with
the largest -weight / ln(u). So a row's shard hangs on its key and the set of shards only: a shard that is added takes
rows into itself and moves no other, a shard that goes gives up its own rows, and shards hold
rows in proportion to their weights. The law is ``key``: neither sizes nor row counts are forced to be
equal, and equal texts with different ids may part.

Slots number the rows of a shard from 0 without gaps. Rows are put into 4096 buckets by a hash, counted by
(shard, bucket), and numbered within a bucket behind the rows of the buckets before; so no task
gets a shard. Rows equal in all that is returned are counted first and numbered as one.

Rows: a null text has no bytes and the checksum of an empty text; a null id is a key of its own,
so rows without an id share a shard. Repeated rows get a slot each. Ties in a shard's order go by id (null first), size
and checksum. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from almoner.llm.common import staged

SHARDS = 40
OVERHEAD = 16
LAW = "key"
BUCKET_DIGITS = 3
_UNIT = 2.0**52


def _pull(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(_UNIT)
    return -weight / F.ln(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """``pull, shard`` of the shard that a key (text) goes to, the first of equals."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    given = F.array(*(F.lit(float(w)) for w in weights))
    numbers = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    pulls = F.transform(numbers, lambda i: F.struct(_pull(key, i, F.get(given, i)).alias("pull"), (-i).alias("minus")))
    return F.array_max(pulls)


def shard_documents(documents: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the last is the shard with
    one more shard of ``new_weight``."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    mark = F.md5(F.concat(key, F.lit(":"), F.col("text_crc32").cast("string")))
    kinds = kinds.withColumn("best", shard_of(key, weights)).select(
        "*",
        (-F.col("best.minus")).alias("shard"),
        F.when(_pull(key, F.lit(len(weights)), F.lit(float(new_weight))) > F.col("best.pull"), F.lit(len(weights)))
        .otherwise(-F.col("best.minus"))
        .alias("grown_shard"),
        mark.alias("mark"),
        F.substring(mark, 1, BUCKET_DIGITS).alias("bucket"),
    )
    kinds = staged(kinds.drop("best"), "shards")
    # At most len(weights) * 16 ** BUCKET_DIGITS rows of a few bytes.
    counts = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = (
        Window.partitionBy("shard", "bucket")
        .orderBy("mark", "doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    placed = kinds.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("first", first)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"),
        "grown_shard",
    )


# Checksums byte by byte, with the table of the reflected polynomial 0xEDB88320.
ORACLE = f"""
WITH constants AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), rows AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {OVERHEAD} AS size, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
            lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))) AS text_crc32
    FROM documents, constants
), pulls AS (
    SELECT doc_id, list_transform(range({SHARDS + 1}), lambda i: -1.0 /
        ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT + 0.5) / {_UNIT!r})) AS pull
    FROM (SELECT DISTINCT doc_id FROM documents)
), placed AS (
    SELECT r.*, list_position(pull[1:{SHARDS}], list_max(pull[1:{SHARDS}])) - 1 AS shard,
        list_position(pull, list_max(pull)) - 1 AS grown_shard
    FROM rows r JOIN pulls p ON r.doc_id IS NOT DISTINCT FROM p.doc_id
)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard
        ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
    grown_shard::INTEGER AS grown_shard
FROM placed
"""
