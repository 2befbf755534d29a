"""Benchmark decontamination by spaced-seed hashing.

A mask is laid over every run of ``SPAN`` tokens; the tokens at its 1s are hashed, those at its 0s may be anything. The
first mask leaves out every third place, the second three places in a row, so a phrase may be exchanged. Both are laid at each place:
in ``OVERLAP`` tokens no single changed one hides a run, and of the 78 pairs of changed ones 2 do.
Items shorter than that have masks of their own length, over the whole item: for every choice of tokens that may
be changed there is one that leaves them out, so all copies that are near enough are found, at any length.
Hashes of documents are joined to those of the benchmark's items; every hit names an item and a shift.
Along each shift document and item are laid over each other, and the hit counts when some
``OVERLAP`` neighbouring tokens (the whole item, if it is shorter) agree but for the share ``SUBSTITUTED``.

Tokens are runs of letters and digits of the lower-cased text, so case and punctuation do not matter. The seeds of the benchmark are
broadcast when they are measured to be small; otherwise the join is a shuffle. Documents have seeds only for such lengths as the
benchmark has. An item of one to four tokens is found wherever it stands as it is.

Rows: null and empty texts match nothing, on either side; an empty benchmark finds nothing. Repeated items count once, repeated documents give a row
each. One row is returned for each document and item found, with the best shift: most equal tokens, then the smallest
shift. Only ``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from almoner.llm.common import staged, text_key
from almoner.operators.lookup import fits_broadcast

SPAN = 9
MASKS = ("110110110", "111000111")
OVERLAP = 13
SUBSTITUTED = 0.2


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(text: Column) -> Column:
    """The hash of each token."""
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(hashed: str) -> Column:
    """The seeds of a column of token hashes, mask after mask for each place. The column is named often, so
    the optimiser keeps it out of the lambda."""
    masked = (
        "xxhash64(" + ", ".join([str(m), *(f"get({hashed}, i + {k})" for k, c in enumerate(mask) if c == "1")]) + ")"
        for m, mask in enumerate(MASKS)
    )
    return F.expr(
        f"IF(size({hashed}) < {SPAN}, CAST(array() AS array<bigint>),"
        f" flatten(transform(sequence(0, size({hashed}) - {SPAN}), i -> array({', '.join(masked)}))))"
    )


def short_masks(n: int) -> list[tuple[int, ...]]:
    """The places that count in an item of ``n`` tokens, for each of its masks.

    Places are dealt to groups in turn, and each mask leaves out as many groups as tokens may be changed."""
    changed = n - -(-n * round(100 * (1 - SUBSTITUTED)) // 100)
    groups = n if n < SPAN else changed + 2
    return [tuple(p for p in range(n) if p % groups not in out) for out in combinations(range(groups), changed)]


def _short_seeds(hashed: str, lengths: list[int]) -> Column:
    """Places and seeds of a column of token hashes for short items of these lengths."""
    every = []
    for n in lengths:
        seeds = (
            f"struct(i AS place, xxhash64({n}, {m}, " + ", ".join(f"get({hashed}, i + {k})" for k in kept) + ") AS seed)"
            for m, kept in enumerate(short_masks(n))
        )
        every.append(
            f"IF(size({hashed}) < {n}, CAST(array() AS array<struct<place: int, seed: bigint>>),"
            f" flatten(transform(sequence(0, size({hashed}) - {n}), i -> array({', '.join(seeds)}))))"
        )
    return F.expr(f"concat({', '.join(every)})")


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", _hashed(F.col("text")).alias("item")).where(F.size("item") > 0)
    return staged(items.distinct().withColumn("item_key", F.xxhash64("item")), "benchmark")


def _placed(rows: DataFrame, hashed: str, others: list[str], place: str) -> DataFrame:
    """A row for each seed with the ``others``; ``place`` is where in the text it begins."""
    every = rows.select(*others, F.posexplode(_seeds(hashed)).alias("at", "seed"))
    return every.select(*others, F.expr(f"at div {len(MASKS)}").cast("int").alias(place), "seed")


def _placed_short(rows: DataFrame, hashed: str, others: list[str], place: str, lengths: list[int]) -> DataFrame:
    every = rows.select(*others, F.explode(_short_seeds(hashed, lengths)).alias("s"))
    return every.select(*others, F.col("s.place").alias(place), "s.seed")


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_key, item_id, shift, equal_tokens, overlap_tokens`` for each document and item that overlap."""
    items = _items(benchmark)
    known = ["item_id", "item_key"]
    seeds = _placed(items.where(F.size("item") >= OVERLAP), "item", known, "item_at")
    if fits_broadcast(seeds):
        seeds = F.broadcast(seeds)
    sizes = items.where(F.size("item") < OVERLAP).select(F.size("item").alias("n")).distinct().collect()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    hashed = texts.select("doc_id", "text_key", F.struct(_hashed(F.col("text")).alias("w")).alias("t"))
    hits = _placed(hashed, "t.w", ["doc_id", "text_key"], "doc_at").join(seeds, "seed")
    lengths = sorted(r["n"] for r in sizes)
    if lengths:
        # An item has masks of its own length only.
        own = (_placed_short(items.where(F.size("item") == n), "item", known, "item_at", [n]) for n in lengths)
        short = reduce(DataFrame.unionByName, own)
        short = F.broadcast(short) if fits_broadcast(short) else short
        hits = hits.unionByName(_placed_short(hashed, "t.w", ["doc_id", "text_key"], "doc_at", lengths).join(short, "seed"))
    hits = hits.select("doc_id", "text_key", "item_id", "item_key", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    # Of an item of one token only the first place is laid over.
    single = items.where(F.size("item") == 1).select("item_key").distinct()
    single = F.broadcast(single) if fits_broadcast(single) else single
    hits = hits.join(single.withColumn("alone", F.lit(True)), "item_key", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    hits = staged(hits, "seed-hits")
    return _verified(texts, hits, items)


# For each shift of an item on a document: what is equal where they lie over each other, in all and in the best window. The
# document is read only at the item's places, and nothing of its size is made for a shift.
_LAID = """transform(shifts, s -> transform(
    array(transform(sequence(greatest(0, s), least(size(doc), s + size(item)) - 1), p -> IF(get(doc, p) = get(item, p - s), 1, 0))),
    e -> struct(aggregate(e, 0, (t, x) -> t + x) AS equal_tokens, -s AS minus, size(e) AS overlap_tokens,
        IF(size(e) < {width}, 0, array_max(transform(sequence(1, size(e) - {width} + 1),
            i -> aggregate(slice(e, i, {width}), 0, (t, x) -> t + x)))) AS most))[0])"""
COPIES = 4096


def _verified(texts: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """Lays the texts with hits over the items, once for each document and item, at all their shifts."""
    listed = hits.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    chosen = texts.join(F.broadcast(listed) if fits_broadcast(listed) else listed, same, "left_semi")
    # One copy of each text to lay over, however many rows it has.
    kept = chosen.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    doc = F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))
    kept = kept.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "copies", doc.alias("doc"))
    small = items.select(F.col("item_id").alias("known_id"), F.col("item_key").alias("known_key"), "item")
    small = F.broadcast(small) if fits_broadcast(small) else small
    # A text has at most as many shifts as tokens for an item; of an item of one token the first is the answer.
    pairs = hits.groupBy("doc_id", "text_key", "item_id", "item_key").agg(
        F.collect_list(F.when(~F.col("alone"), F.col("shift"))).alias("several"), F.min("shift").alias("least"), F.first("alone").alias("alone")
    )
    pairs = pairs.select(
        "doc_id", "text_key", "item_id", "item_key", F.when(F.col("alone"), F.array("least")).otherwise(F.col("several")).alias("shifts")
    )
    laid = pairs.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).join(
        small, (F.col("known_key") == F.col("item_key")) & F.col("known_id").eqNullSafe(F.col("item_id"))
    )
    width = f"least({OVERLAP}, size(item))"
    good = f"filter({_LAID.format(width=width)}, x -> x.most * 100 >= {width} * {round(100 * (1 - SUBSTITUTED))})"
    found = laid.select("doc_id", "text_key", "item_id", "copies", F.array_max(F.expr(good)).alias("best")).where("best IS NOT NULL")
    # Repeated rows are dealt out in blocks.
    found = found.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    found = found.withColumn("copy", F.explode(F.expr(f"sequence(1L, least({COPIES}, copies - block * {COPIES}))")))
    return found.select(
        "doc_id",
        "text_key",
        "item_id",
        (-F.col("best.minus")).alias("shift"),
        "best.equal_tokens",
        "best.overlap_tokens",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that overlap with no item, all columns as they are."""
    found = staged(find_overlaps(documents, benchmark).select("doc_id", "text_key").distinct(), "contaminated")
    listed = found.toDF("listed_id", "listed_key")
    same = documents["doc_id"].cast("bigint").eqNullSafe(listed["listed_id"]) & (text_key(documents["text"]) == listed["listed_key"])
    return documents.join(F.broadcast(listed) if fits_broadcast(listed) else listed, same, "left_anti")
