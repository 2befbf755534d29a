"""CRM sync: landed pages into the stored donors and donations.

``sync`` runs on a schedule kept elsewhere, ``sync_stream`` is one run of a stream; both read each landed file once.
Beside the seven tables the store then has, by source: ``pages_read`` (the ledger of ``sync``), ``waiting_donors`` and
``waiting_donations`` (rows whose parent may still come), ``refused_donors`` and ``refused_donations`` (rows that can never
pass), ``bad_pages`` (what is not JSON) and ``stream_results``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StreamingQuery

from almoner.operators.merge import (
    NATURAL_KEY,
    Merge,
    curable,
    first_per_key,
    insert_new_donations,
    upsert_donors,
)
from almoner.session import checkpointed
from almoner.sinks.store import Store
from almoner.sources.crm import (
    PAGE_COLUMNS,
    bad_pages,
    normalise_donations,
    normalise_donors,
    number_lines,
    read_pages,
)

# Folders of a landing place.
DONOR_PAGES = "constituents"
GIFT_PAGES = "transactions"

KINDS = {"donors": DONOR_PAGES, "donations": GIFT_PAGES}

RESULT = "source string, donors bigint, donations bigint, rejected bigint, error string"


@dataclass(frozen=True)
class Source:
    """A landing place: <landing>/constituents and <landing>/transactions, with files of
    one page or, with ``lines``, of a page on each line. ``key``: what makes a gift a known one."""

    name: str
    landing: str
    enabled: bool = True
    lines: bool = False
    donor_values: dict = field(default_factory=dict)
    gift_values: dict = field(default_factory=dict)
    # ("source_ref",) tells real repeated gifts apart; gifts without a date then come in once.
    key: tuple[str, ...] = NATURAL_KEY


def apply_donors(store: Store, donors: DataFrame) -> Merge:
    """Only buckets in which a donor changes are written."""
    merge = upsert_donors(store.tables(), donors, store.bucket)
    store.put_donors(merge.rows, merge.changed)
    return merge


def apply_gifts(
    store: Store, gifts: DataFrame, key: tuple[str, ...] = NATURAL_KEY
) -> tuple[Merge, int]:
    """Only rows really added count. Appending is safe to repeat: gifts written by
    an attempt that died are known to the next one."""
    merge = insert_new_donations(store.tables(), gifts, key, last_id=store.last_id("donations"))
    return merge, store.append("donations", merge.rows)


def _apply(
    store: Store, source: Source, kind: str, pages: DataFrame | None, batch: str, as_of: date | None
) -> tuple[int, int]:
    """Brings pages of one kind (none, if there are no new ones) and what waited of it into the store: rows that
    counted, rows (and pages) that did not. Every accepted donor counts as one upsert, a gift when it is new.

    Rows whose parent may still come wait and join the next batch; the others, and pages that are not JSON, are put aside
    by the batch they came with, so that a repeated batch puts them there once.
    """
    part = {"source": source.name, "batch": batch}
    waiting, waited, rejected, rows = f"waiting_{kind}", None, 0, None
    if store.there(waiting):
        waited = store.read(waiting).where(F.col("source") == source.name).drop("source", "reason")
        waited = waited if waited.head(1) else None
    if pages is None and waited is None:
        return 0, 0
    if pages is not None:
        rejected += store.put_part("bad_pages", part | {"kind": kind}, bad_pages(pages).select("path", "page"))
        if kind == "donors":
            rows = normalise_donors(pages, **source.donor_values)
        else:
            rows = normalise_donations(pages, source.name, as_of, **source.gift_values)
    if waited is not None:
        rows = waited if rows is None else rows.unionByName(waited)
    if kind == "donors":
        merge, added = apply_donors(store, rows), None
    else:
        merge, added = apply_gifts(store, rows, source.key)
    accepted, curables, others = merge.checked.agg(
        F.count_if(F.col("reason").isNull()),
        F.count_if(F.coalesce(curable(), F.lit(False))),
        F.count_if(F.col("reason").isNotNull() & ~curable()),
    ).first()
    # Of rows that wait and come again one stays.
    once = first_per_key(merge.rejected, [c for c in merge.checked.columns if c != "seq"])
    if curables or waited is not None:
        rejected += store.put_part(waiting, {"source": source.name}, once.where(curable()))
    if others:
        rejected += store.put_part(f"refused_{kind}", part, once.where(~curable()))
    return accepted if added is None else added, rejected


def _fresh(store: Store, source: Source, kind: str) -> DataFrame | None:
    """Path and time of the landed files that the ledger does not have; None if there are none. Lists files
    without reading them."""
    files = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    landed = files.load(f"{source.landing}/{KINDS[kind]}").selectExpr(*_FILE)
    if store.there("pages_read"):
        ledger = store.read("pages_read").where((F.col("source") == source.name) & (F.col("kind") == kind))
        landed = landed.join(ledger.select("path", "modified"), ["path", "modified"], "left_anti")
    fresh = checkpointed(landed)
    return fresh if fresh.head(1) else None


_FILE = ("_metadata.file_path AS path", "_metadata.file_modification_time AS modified")


def _fresh_pages(store: Store, source: Source, kind: str, fresh: DataFrame) -> DataFrame:
    """The pages of these files only. Files that are older than all of them are not opened."""
    pages = read_pages(store.spark, f"{source.landing}/{KINDS[kind]}", source.lines, fresh.agg(F.min("modified")).first()[0])
    return pages.join(fresh.select("path"), "path", "left_semi")


def sync(store: Store, sources: Iterable[Source], as_of: date | None = None) -> DataFrame:
    """One run over all enabled sources, donors before gifts, over the files that landed since the last run: source,
    donors, donations, rejected, error. A source that fails shows its error and does not stop the
    others. Files are noted as read after their rows are in; a run that dies before that reads them again, which changes nothing."""
    spark = store.spark
    results = []
    for source in sources:
        if not source.enabled:
            continue
        counts, rejected, error = dict.fromkeys(KINDS, 0), 0, None
        run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
        try:
            for kind in KINDS:
                fresh = _fresh(store, source, kind)
                pages = None if fresh is None else _fresh_pages(store, source, kind, fresh)
                counts[kind], not_in = _apply(store, source, kind, pages, run, as_of)
                rejected += not_in
                if fresh is not None:
                    store.put_part("pages_read", {"source": source.name, "kind": kind, "run": run}, fresh)
        except Exception as failure:  # noqa: BLE001 - one source must not stop the rest
            error = f"{type(failure).__name__}: {failure}"
        results.append((source.name, *counts.values(), rejected, error))
    return spark.createDataFrame(results, RESULT)


def sync_stream(
    store: Store,
    source: Source,
    checkpoint: str,
    as_of: date | None = None,
    max_files: int | None = None,
) -> StreamingQuery | None:
    """Starts a run over the files that landed since the last one, then stops; nothing is
    started for a source that is not enabled.

    A batch may hold rows whose segment, donor, campaign or channel comes later, and a file is not
    read twice. Such donors and gifts wait in the store and join the next batch, also
    when no new page of their kind landed. A repeated batch changes nothing. Each batch leaves its counts
    in ``stream_results``; of a batch that is repeated the last counts stay.
    """
    if not source.enabled:
        return None
    options = {"wholetext": str(not source.lines).lower(), "recursiveFileLookup": "true"}
    if max_files:
        options["maxFilesPerTrigger"] = str(max_files)
    landed = (
        store.spark.readStream.format("text")
        .options(**options)
        .load(source.landing)
        .selectExpr(*PAGE_COLUMNS)
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = number_lines(batch).persist()
        try:
            counts, rejected = {}, 0
            for kind, folder in KINDS.items():
                pages = batch.where(F.col("path").contains(f"/{folder}/"))
                counts[kind], not_in = _apply(store, source, kind, pages, str(batch_id), as_of)
                rejected += not_in
            row = store.spark.createDataFrame([(*counts.values(), rejected)], "donors bigint, donations bigint, rejected bigint")
            store.put_part("stream_results", {"source": source.name, "batch": str(batch_id)}, row)
        finally:
            batch.unpersist()

    return (
        landed.writeStream.queryName(f"sync {source.name}")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sync_streams(
    store: Store, sources: Iterable[Source], checkpoints: str, as_of: date | None = None, max_files: int | None = None
) -> DataFrame:
    """One stream for each enabled source, one after the other (a store has one writer): source, donors,
    donations, rejected, error. Counts are sums over this run's batches, so a row that waits through
    several of them is rejected in each. A stream that fails shows its error, with what its batches had done, and the next one runs."""
    results = []
    for source in sources:
        before = _batches(store, source)
        error = None
        try:
            query = sync_stream(store, source, f"{checkpoints}/{source.name}", as_of, max_files)
            if query is None:
                continue
            query.awaitTermination()
        except Exception as failure:  # noqa: BLE001 - one source must not stop the rest
            error = f"{type(failure).__name__}: {failure}"
        new = [r for b, r in sorted(_batches(store, source).items()) if b not in before]
        sums = (sum(r[c] for r in new) for c in ("donors", "donations"))
        results.append((source.name, *sums, sum(r["rejected"] for r in new), error))
    return store.spark.createDataFrame(results, RESULT)


def _batches(store: Store, source: Source) -> dict[int, Row]:
    """The counts of a source's batches: a row for each run of the schedule or less, so they are few."""
    if not store.there("stream_results"):
        return {}
    rows = store.read("stream_results").where(F.col("source") == source.name).collect()
    return {int(r["batch"]): r for r in rows}
