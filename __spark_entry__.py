"""
must give the same rows."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import partial
from importlib import import_module
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles  # noqa: E402
from almoner.model import TABLES, Tables, conform  # noqa: E402
from almoner.operators.ids import assign_ids as _assign_ids, largest_id  # noqa: E402
from almoner.operators.layers import replace_live_layer as _replace_live_layer  # noqa: E402
from almoner.operators.merge import (  # noqa: E402
    insert_ignore as _insert_ignore,
    insert_new_donations as _insert_new_donations,
    upsert_donors as _upsert_donors,
)
from almoner.operators.scope import scoped  # noqa: E402
from almoner.operators.validate import validate_tables as _validate_tables  # noqa: E402
from almoner.plans import AD_HOC, REPORTS, donations, donors  # noqa: E402
from almoner.session import fresh_dir  # noqa: E402
from almoner.sinks import files  # noqa: E402
from almoner.sinks.store import Store, copy_tables as _copy_tables  # noqa: E402
from almoner.sources import crm  # noqa: E402
from almoner.sources.sample import (  # noqa: E402
    LAST_DAY,
    RECURRING_SEGMENT,
    donor_pages,
    gift_pages,
    sample_tables,
)
from almoner.sources.tables import load_tables  # noqa: E402
from almoner.streaming.sync import DONOR_PAGES, GIFT_PAGES, Source  # noqa: E402
from almoner.streaming.sync import sync as _sync, sync_stream as _sync_stream, sync_streams as _sync_streams  # noqa: E402

AS_OF = date.fromisoformat(LAST_DAY)
DONOR_VALUES = {"segment_id": "BUILDING"}
GIFT_VALUES = {"campaign_id": "2-HIGH"}
SCOPE = {"segment": "BUILDING", "campaign": "1-URGENT", "channel": "online"}

Query = Callable[[SparkSession, str], DataFrame]

# Reports whose parameters differ from the defaults on the test tables.
_PARAMS = {
    "daily_trend": {"as_of": AS_OF},
    "monthly_trend": {"recurring": RECURRING_SEGMENT},
}


def _report(report: Callable[..., DataFrame], params: dict, spark: SparkSession, sf: str) -> DataFrame:
    return report(sample_tables(spark, sf), **params)


def _scoped_report(
    report: Callable[..., DataFrame], scope: dict, spark: SparkSession, sf: str
) -> DataFrame:
    return report(scoped(sample_tables(spark, sf), **scope))


# -- inputs of the jobs -------------------------------------------------------


def _with_position(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("seq.number").alias("page"), F.col("seq.pos").alias("position"), "*"
    ).drop("seq")


def _gifts(spark: SparkSession, sf: str) -> DataFrame:
    return crm.normalise_donations(gift_pages(spark, sf), "crm", AS_OF, **GIFT_VALUES)


def _donor_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Donors whose values differ from page to page."""
    rows = crm.normalise_donors(donor_pages(spark, sf), **DONOR_VALUES)
    later = F.col("seq.number") >= 1_000_000_000
    return rows.select(
        "name",
        F.when(later, "MACHINERY").otherwise("BUILDING").alias("segment_id"),
        (F.col("seq.pos") * 100).alias("max_gift"),
        F.when(later, "Feb 2024").otherwise("Jan 2024").alias("first_gift"),
        F.when(F.col("seq.pos") % 2 == 0, "new").otherwise("active").alias("lifecycle"),
        "seq",
    )


def _known(spark: SparkSession, sf: str) -> Tables:
    """Tables before the sync: new donors and failed gifts are not in them yet."""
    tables = sample_tables(spark, sf)
    return tables.with_(
        donors=tables.donors.where(F.col("lifecycle") != "new"),
        donations=tables.donations.where(F.col("status") != "failed"),
    )


def _with_all_donors(spark: SparkSession, sf: str) -> Tables:
    return _known(spark, sf).with_(donors=sample_tables(spark, sf).donors)


def _land(pages: DataFrame, folder: str) -> None:
    """Writes the pages as lines, so that their number does not become one of files."""
    pages.select("page").write.text(folder)


def _store(spark: SparkSession) -> Store:
    """An empty database of its own below the shared folder."""
    return Store(spark, f"almoner_{uuid.uuid4().hex}", fresh_dir(spark, "store"))


def _landed_store(spark: SparkSession, sf: str) -> tuple[Store, Source]:
    """A store with the known tables and a landing place with all pages."""
    store = _store(spark)
    tables = _with_all_donors(spark, sf)
    for table in TABLES:
        store.replace(table, tables[table])
    landing = fresh_dir(spark, "landing")
    _land(donor_pages(spark, sf), f"{landing}/{DONOR_PAGES}/first")
    _land(gift_pages(spark, sf), f"{landing}/{GIFT_PAGES}/first")
    source = Source("crm", landing, lines=True, donor_values=DONOR_VALUES, gift_values=GIFT_VALUES)
    return store, source


# -- one query per job, source and sink ---------------------------------------


def normalise_donors(spark: SparkSession, sf: str) -> DataFrame:
    return _with_position(crm.normalise_donors(donor_pages(spark, sf), **DONOR_VALUES))


def normalise_donations(spark: SparkSession, sf: str) -> DataFrame:
    gifts = _with_position(_gifts(spark, sf))
    return gifts.withColumn("amount", F.col("amount").cast("double"))


def crm_items(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of the fields of landed items, read back from files."""
    landing = fresh_dir(spark, "landing")
    _land(gift_pages(spark, sf), landing)
    items = crm.page_items(crm.read_pages(spark, landing, lines=True))

    def kind(name: str):
        value = F.try_variant_get("item", f"$.{name}", "variant")
        found = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
        return F.coalesce(found, F.lit("ABSENT"))

    return items.groupBy(kind("Id").alias("id_kind"), kind("Amount").alias("amount_kind")).agg(
        F.count(F.lit(1)).alias("items")
    )


def upsert_donors(spark: SparkSession, sf: str) -> DataFrame:
    return _upsert_donors(_known(spark, sf), _donor_batch(spark, sf)).rows


def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return _insert_ignore(_known(spark, sf).donors, _donor_batch(spark, sf), ["name"])


def insert_new_donations(spark: SparkSession, sf: str) -> DataFrame:
    return _insert_new_donations(_with_all_donors(spark, sf), _gifts(spark, sf)).rows.drop("id")


def insert_new_donations_rejected(spark: SparkSession, sf: str) -> DataFrame:
    merge = _insert_new_donations(_with_all_donors(spark, sf), _gifts(spark, sf))
    return merge.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def insert_new_donations_by_source_ref(spark: SparkSession, sf: str) -> DataFrame:
    tables = _with_all_donors(spark, sf)
    stored = tables.donations.withColumn("source_ref", F.concat(F.lit("crm:"), "id"))
    merge = _insert_new_donations(
        tables.with_(donations=stored), _gifts(spark, sf), key=("source_ref",)
    )
    return merge.rows.select("source_ref", "gift_date", "donor_name", "amount")


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    gifts = sample_tables(spark, sf).donations
    done = F.col("status") == "completed"
    last_id = largest_id(gifts.where(done))
    return _assign_ids(gifts.where(~done), last_id).select("id")


def replace_live_layer(spark: SparkSession, sf: str) -> DataFrame:
    gifts = sample_tables(spark, sf).donations
    layer = gifts.withColumn("amount", F.col("amount") * 2)
    return _replace_live_layer(gifts, layer, "gift_date", date(2001, 1, 15))


def replace_live_layer_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Gifts and calls from a day on in one run; every column of both tables."""
    store = _store(spark)
    tables = sample_tables(spark, sf)
    for table in ("donations", "calls"):
        store.replace(table, tables[table])
    gifts = store.read("donations").withColumn("amount", F.col("amount") * 2)
    calls = store.read("calls").withColumns({"outcome": F.lit("missed"), "pledge": F.lit(0)})
    store.replace_since({"donations": gifts, "calls": calls}, date(2001, 1, 15))
    # The calls are all later than that; a second cut-off falls among them.
    later = store.read("calls").withColumn("duration_sec", F.col("duration_sec") + 1)
    store.replace_since({"calls": later}, date(2024, 1, 15))
    return _all_rows(store.tables(), ("donations", "calls"))


def copy_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _copy_tables(sample_tables(spark, sf), _store(spark))


def validate_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The rules broken by tables that were damaged on purpose."""
    tables = sample_tables(spark, sf)
    repeated = tables.donors.where(F.col("lifecycle") == "lapsed")
    tenth = F.col("id") % 10 == 0
    odd_status = F.when(F.col("id") % 20 == 1, "not a status").otherwise(F.col("status"))
    damaged = tables.with_(
        segments=tables.segments.where(F.col("id") != "MACHINERY"),
        donors=tables.donors.unionByName(repeated),
        donations=tables.donations.withColumns(
            {
                "donor_name": F.when(tenth, "Nobody").otherwise(F.col("donor_name")),
                "status": odd_status,
            }
        ),
        calls=tables.calls.withColumn(
            "outcome", F.when(F.col("id") % 7 != 0, F.col("outcome"))
        ),
    )
    return _validate_tables(damaged)


def sync(spark: SparkSession, sf: str) -> DataFrame:
    store, source = _landed_store(spark, sf)
    off = Source("off", "/nowhere", enabled=False)
    result = _sync(store, [Source("broken", "/nowhere"), off, source], AS_OF)
    return result.withColumn("failed", F.col("error").isNotNull()).drop("error")


def sync_stream(spark: SparkSession, sf: str) -> DataFrame:
    store, source = _landed_store(spark, sf)
    query = _sync_stream(store, source, fresh_dir(spark, "stream"), AS_OF)
    query.awaitTermination()
    return conform(store.read("donations"), "donations").drop("id")


def sync_stream_donors(spark: SparkSession, sf: str) -> DataFrame:
    """Donors after a stream in which their segment came after their pages."""
    store, source = _landed_store(spark, sf)
    segments, checkpoint = sample_tables(spark, sf).segments, fresh_dir(spark, "stream")
    store.replace("segments", segments.where(F.col("id") != DONOR_VALUES["segment_id"]))
    _sync_stream(store, source, checkpoint, AS_OF).awaitTermination()
    store.replace("segments", segments)
    _land(spark.sql("""SELECT '{"Results":[]}' AS page"""), f"{source.landing}/{DONOR_PAGES}/more")
    _sync_stream(store, source, checkpoint, AS_OF).awaitTermination()
    return conform(store.read("donors"), "donors")


def sync_by_source_ref(spark: SparkSession, sf: str) -> DataFrame:
    """Gifts after two pulls of all pages on two days, by the reference; undated gifts come in once."""
    store, source = _landed_store(spark, sf)
    source = replace(source, key=("source_ref",))
    _sync(store, [source], AS_OF)
    _land(gift_pages(spark, sf), f"{source.landing}/{GIFT_PAGES}/second")
    _sync(store, [source], date(2031, 1, 1))
    return store.read("donations").drop("id", "period_month")


def sync_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of three runs: all pages, nothing new, and the pages of some more donors and gifts."""
    store, source = _landed_store(spark, sf)
    runs = [_sync(store, [source], AS_OF), _sync(store, [source], AS_OF)]
    page = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    _land(donor_pages(spark, sf).where(page % 3 == 0), f"{source.landing}/{DONOR_PAGES}/second")
    _land(gift_pages(spark, sf).where(page % 3 == 0), f"{source.landing}/{GIFT_PAGES}/second")
    runs.append(_sync(store, [source], AS_OF))
    numbered = [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs, 1)]
    return numbered[0].unionByName(numbered[1]).unionByName(numbered[2]).drop("error")


def sync_stream_result(spark: SparkSession, sf: str) -> DataFrame:
    """What streams over several sources report, one of which fails."""
    store, source = _landed_store(spark, sf)
    off = Source("off", "/nowhere", enabled=False)
    found = _sync_streams(store, [Source("broken", "/nowhere"), off, source], fresh_dir(spark, "stream"), AS_OF)
    return found.withColumn("failed", F.col("error").isNotNull()).drop("error")


def crm_bad_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Gifts of the pages that are JSON; every fifth page was cut short."""
    cut = F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 5 == 0
    pages = gift_pages(spark, sf).withColumn("page", F.when(cut, F.left("page", F.lit(20))).otherwise(F.col("page")))
    gifts = crm.normalise_donations(pages, "crm", AS_OF, **GIFT_VALUES)
    bad = crm.bad_pages(pages).select(F.concat(F.lit("bad "), F.regexp_extract("path", r"(\d+)", 1)).alias("found"))
    return gifts.select(F.col("source_ref").alias("found")).unionByName(bad)


def replace_live_layer_undated(spark: SparkSession, sf: str) -> DataFrame:
    """A stored cut-off on gifts of which some have no date."""
    gifts = sample_tables(spark, sf).donations
    store = _store(spark)
    undated = F.when(F.col("id") % 9 != 0, F.col("gift_date"))
    store.replace("donations", gifts.withColumn("gift_date", undated))
    store.replace_since({"donations": gifts.withColumn("amount", F.col("amount") * 2)}, date(2001, 1, 15))
    return conform(store.read("donations"), "donations")


def normalise_numeric_ids(spark: SparkSession, sf: str) -> DataFrame:
    """References of gifts when whole-number ids are taken too."""
    pages = gift_pages(spark, sf)
    return crm.normalise_donations(pages, "crm", AS_OF, accept_numeric_ids=True, **GIFT_VALUES).select("source_ref")


def _reloaded(fmt: str, spark: SparkSession, sf: str) -> Tables:
    folder = fresh_dir(spark, "tables")
    tables = sample_tables(spark, sf)
    # As text, Spark writes times to the millisecond unless told otherwise.
    options = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    for table in TABLES:
        tables[table].write.format(fmt).options(**options).save(f"{folder}/{table}")
    return load_tables(spark, folder, fmt)


def load_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _reloaded("parquet", spark, sf).donations


def load_csv(spark: SparkSession, sf: str) -> DataFrame:
    return REPORTS["calls_export"](_reloaded("csv", spark, sf))


def load_json(spark: SparkSession, sf: str) -> DataFrame:
    return _reloaded("json", spark, sf).donors


def _all_rows(tables: Tables, names: tuple[str, ...] = tuple(oracles.CONTENT)) -> DataFrame:
    """Every row of the tables, with all columns, as text."""
    found = None
    for table in names:
        times = {"call_time": "date_format(call_time, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"}
        texts = (f"coalesce(CAST({times.get(c, c)} AS string), '-')" for c in oracles.CONTENT[table])
        rows = tables[table].selectExpr(f"'{table}' AS `table`", f"concat_ws('|', {', '.join(texts)}) AS content")
        found = rows if found is None else found.unionByName(rows)
    return found


def _load_all(fmt: str, spark: SparkSession, sf: str) -> DataFrame:
    return _all_rows(_reloaded(fmt, spark, sf))


def copy_tables_content(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    _copy_tables(sample_tables(spark, sf), store)
    return _all_rows(store.tables())


def copy_to_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The seven tables copied into a database and read from the catalog by name."""
    store = _store(spark)
    _copy_tables(sample_tables(spark, sf), store)
    return _all_rows(load_tables(spark, store.database, "table"))


def load_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog tables that others wrote, with their columns in another order."""
    store, tables = _store(spark), sample_tables(spark, sf)
    for table in TABLES:
        tables[table].select(*reversed(tables[table].columns)).write.format("orc").saveAsTable(store.name(table))
    return _all_rows(load_tables(spark, store.database, "table"))


def _csv(report: str, header: dict[str, str], spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_dir(spark, "csv")
    files.write_csv(REPORTS[report](sample_tables(spark, sf)), header, folder)
    return spark.read.csv(folder, header=True, escape='"')


def publish(spark: SparkSession, sf: str) -> DataFrame:
    """Four published reports, read back whole."""
    folder = fresh_dir(spark, "published")
    tables = sample_tables(spark, sf)
    with donors.shared(tables) as kept:
        reports = {name: REPORTS[name](kept) for name in oracles.PUBLISHED}
        files.publish(reports, folder, "json")
    found = None
    for name, columns in oracles.PUBLISHED.items():
        texts = ", ".join(f"coalesce(CAST({c} AS string), '-')" for c in columns)
        back = spark.read.schema(reports[name].schema).json(f"{folder}/{name}")
        rows = back.selectExpr(f"'{name}' AS report", f"concat_ws('|', {texts}) AS content")
        found = rows if found is None else found.unionByName(rows)
    return found


# -- the contract -------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Revenue, gifts and share of each channel."""
    return donations.channel_breakdown(sample_tables(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Query]:
    reports: dict[str, Query] = {
        name: partial(_report, report, _PARAMS.get(name, {}))
        for name, report in (REPORTS | AD_HOC).items()
    }
    segment = {"segment": SCOPE["segment"]}
    scoped_reports: dict[str, Query] = {
        "scoped_overview": partial(_scoped_report, REPORTS["overview"], SCOPE),
        "scoped_channel_breakdown": partial(_scoped_report, REPORTS["channel_breakdown"], segment),
        "scoped_donor_segments": partial(_scoped_report, REPORTS["donor_segments"], SCOPE),
    }
    for name, report in REPORTS.items():
        given = partial(report, **_PARAMS.get(name, {}))
        scoped_reports.setdefault(f"scoped_{name}", partial(_scoped_report, given, SCOPE))
    jobs: tuple[Query, ...] = (
        crm_items,
        normalise_donors,
        normalise_donations,
        upsert_donors,
        insert_ignore,
        insert_new_donations,
        insert_new_donations_rejected,
        insert_new_donations_by_source_ref,
        assign_ids,
        replace_live_layer,
        replace_live_layer_stored,
        replace_live_layer_undated,
        crm_bad_pages,
        copy_tables,
        copy_tables_content,
        copy_to_catalog,
        load_catalog,
        normalise_numeric_ids,
        validate_tables,
        sync,
        sync_stream,
        sync_stream_donors,
        sync_by_source_ref,
        sync_incremental,
        sync_stream_result,
        load_parquet,
        load_csv,
        load_json,
        publish,
    )
    loads: dict[str, Query] = {
        f"load_all_{fmt}": partial(_load_all, fmt) for fmt in ("parquet", "csv", "json", "orc")
    }
    exports: dict[str, Query] = {
        "donations_csv": partial(_csv, "donations_export", files.DONATION_HEADER),
        "calls_csv": partial(_csv, "calls_export", files.CALL_HEADER),
    }
    return reports | scoped_reports | {job.__name__: job for job in jobs} | loads | exports | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql() | _corpus()[1]


def _there(module: str) -> bool:
    try:
        return find_spec(module) is not None
    except ModuleNotFoundError:  # the folder itself is gone
        return False


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL on text corpora, as far as that optional part is installed."""
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    if _there("almoner.llm.queries"):
        part = import_module("almoner.llm.queries")
        found, sql = found | part.queries(), sql | part.oracle_sql()
    if _there("almoner.llm.queries") and _there("corpus_pipeline"):
        pipeline = import_module("corpus_pipeline")
        found["pipeline"] = pipeline.run
        if pipeline.ORACLE_SQL:
            sql["pipeline"] = pipeline.ORACLE_SQL
    return found, sql
