"""Landed CRM pages: reading them and normalising donors and gifts.

A page is one JSON file ``{"Results": [...]}``. Items keep their JSON kinds as
VARIANT, because absent, null, number and string mean different things here.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values given to every record until a field mapping exists.
SEGMENT = "grass"
LIFECYCLE = "active"
FIRST_GIFT = "Jan 2024"
MAX_GIFT = 0
CAMPAIGN = "spring"
CHANNEL = "online"
STATUS = "completed"
UNKNOWN_DONOR = "Unknown"

# Date texts accepted next to ISO 8601, as ``_plain`` leaves them: with or without a time of day.
_TIME = "[ h:mm:ss a][ h:mm a][ H:mm:ss][ H:mm]"
DATE_FORMATS = tuple(
    day + _TIME for day in ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "d MMM yyyy", "d-MMM-yyyy", "MMM d yyyy")
)

_BLANKS = r"\p{IsWhite_Space}"


def read_pages(
    spark: SparkSession, location: str, lines: bool = False, since: datetime | None = None
) -> DataFrame:
    """path, page and the place in the file: block, line.

    A file is one page or, with ``lines``, holds a page on each line, which suits
    very many pages. Files written before ``since`` are not opened.
    """
    files = spark.read.text(location, wholetext=not lines, recursiveFileLookup=True)
    if since is not None:
        files = files.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return number_lines(files.selectExpr(*PAGE_COLUMNS))


# What a page needs of a text source, batch or stream.
PAGE_COLUMNS = (
    "_metadata.file_path AS path", "_metadata.file_block_start AS block", "value AS page"
)


def number_lines(pages: DataFrame) -> DataFrame:
    """Adds ``line``, which rises within a block: a block is read by one task in file
    order. Only for rows as they come from the scan."""
    return pages.withColumn("line", F.monotonically_increasing_id())


def _parsed(pages: DataFrame) -> Column:
    """The page as a variant; null if it is not JSON. Of a key given twice the last value counts,
    which Spark allows by a setting that is read while the plan is made."""
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json("page")


def bad_pages(pages: DataFrame) -> DataFrame:
    """The pages that are not JSON, as they came."""
    return pages.where(_parsed(pages).isNull())


def page_items(pages: DataFrame) -> DataFrame:
    """seq, item: the elements of every page's Results; none without such an array.

    ``seq`` sorts items as they were pulled: by folder, then by the last number in the
    file name, then by place in the file and in the page; numbers in folder names count as
    numbers. A page that is not JSON has no items (see ``bad_pages``).
    """
    place = ["block", "line"] if "line" in pages.columns else ["0L AS block", "0L AS line"]
    number = r"coalesce(try_cast(regexp_extract(path, '(\\d+)[^/\\d]*$', 1) AS BIGINT), 0) AS number"
    # Numbers are brought to twenty digits, so that 9 comes before 10.
    folder = (
        r"regexp_replace(regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1),"
        r" '(\\d+)', '00000000000000000000$1'), '\\d*(\\d{20})', '$1') AS folder"
    )
    # What all items of a page share is worked out before they are listed: once a page.
    placed = pages.selectExpr(folder, number, "path", *place, "page")
    results = F.try_variant_get(_parsed(pages), "$.Results", "array<variant>")
    items = placed.select("folder", "number", "path", "block", "line", F.posexplode(results).alias("pos", "item"))
    return items.selectExpr("struct(folder, number, path, block, line, pos) AS seq", "item")


def _field(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "variant")


def _is_kind(value: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(value)
    found = kind.isin(*kinds)
    if "DECIMAL" in kinds:  # it carries its precision: DECIMAL(3,1)
        found = found | kind.startswith("DECIMAL(")
    return F.coalesce(found, F.lit(False))


def _text(name: str) -> Column:
    """The field when it is a JSON string, else NULL."""
    value = _field(name)
    return F.when(_is_kind(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANKS}+|{_BLANKS}+$", "")


def normalise_donors(
    pages: DataFrame,
    segment_id: str = SEGMENT,
    lifecycle: str = LIFECYCLE,
    first_gift: str = FIRST_GIFT,
    max_gift: int = MAX_GIFT,
) -> DataFrame:
    """Donor rows plus ``seq``; people without any name are left out.

    A full name that is a string counts even when empty; otherwise first and last
    name are joined.
    """
    empty = F.lit("")
    parts = F.concat_ws(
        " ", F.coalesce(_text("FirstName"), empty), F.coalesce(_text("LastName"), empty)
    )
    name = F.coalesce(_text("FullName"), _strip(parts))
    return (
        page_items(pages)
        .select(
            name.alias("name"),
            F.lit(segment_id).alias("segment_id"),
            F.lit(max_gift).alias("max_gift"),
            F.lit(first_gift).alias("first_gift"),
            F.lit(lifecycle).alias("lifecycle"),
            "seq",
        )
        .where(_strip(F.col("name")) != "")
    )


def _plain(text: Column) -> Column:
    """A date text without the day of the week, commas and GMT, its month in three letters."""
    text = F.regexp_replace(text, r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b[,.]?", "")
    text = F.regexp_replace(text, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)(?<=\d)\s*(?:GMT|UTC|Z)\s*$|,", " "), r"\s+", " "))


def _parsed_date(text: Column, formats: Sequence[str]) -> Column:
    plain = _plain(text)
    # Most texts that are no dates have no year, which is seen before all formats are tried.
    tried = [F.when(plain.rlike(r"\d{4}"), F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in formats)))] if formats else []
    return F.coalesce(F.try_to_timestamp(text), *tried).cast("date")


def normalise_donations(
    pages: DataFrame,
    source: str,
    as_of: date | None = None,
    accept_numeric_ids: bool = False,
    campaign_id: str = CAMPAIGN,
    channel_id: str = CHANNEL,
    status: str = STATUS,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Gift rows with ``source_ref`` ('<source>:<id>') plus ``seq``.

    A row needs an id that is a string and an amount of any kind. An amount that
    is not a number counts as 0; one too large for the type becomes NULL, which
    the insert rejects. A missing or unreadable date becomes ``as_of``.
    """
    ident = _text("Id")
    if accept_numeric_ids:
        raw_id = _field("Id")
        whole_id = F.when(_is_kind(raw_id, "BIGINT"), F.try_variant_get(raw_id, "$", "string"))
        ident = F.coalesce(ident, whole_id)
    amount = _field("Amount")
    number = F.try_variant_get(amount, "$", "decimal(28,10)")
    is_number = _is_kind(amount, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    today = F.current_date() if as_of is None else F.lit(as_of)
    return (
        page_items(pages)
        .where(ident.isNotNull() & amount.isNotNull())
        .select(
            F.concat(F.lit(f"{source}:"), ident).alias("source_ref"),
            F.coalesce(_parsed_date(_text("Date"), date_formats), today).alias("gift_date"),
            F.coalesce(_text("ConstituentName"), F.lit(UNKNOWN_DONOR)).alias("donor_name"),
            F.lit(campaign_id).alias("campaign_id"),
            F.lit(channel_id).alias("channel_id"),
            F.when(is_number, number).otherwise(F.lit(0)).cast("decimal(28,10)").alias("amount"),
            F.lit(status).alias("status"),
            "seq",
        )
    )
