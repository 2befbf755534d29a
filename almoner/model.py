"""The seven tables: columns, keys, lengths, references and value domains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Month partition column of stored donations and calls; reports never need it,
# period filters use it to prune folders.
PERIOD_COLUMN = "period_month"
# Hash bucket of a stored donor's name: a change rewrites the buckets it touches.
BUCKET_COLUMN = "name_bucket"


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    key: str
    lengths: dict[str, int]
    references: dict[str, str] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    nullable: frozenset[str] = frozenset()
    time_column: str | None = None
    # Columns a store keeps when rows have them; reports never need them.
    optional: str = ""

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def stored(self) -> StructType:
        """What a store keeps."""
        return StructType.fromDDL(", ".join(x for x in (self.ddl, self.optional) if x))

    @property
    def required(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.nullable]


_SPECS = (
    TableSpec(
        "segments",
        "id string, label string, avg_gift int, donor_count int, color string, icon string",
        key="id",
        lengths={"id": 20, "label": 60, "color": 10, "icon": 40},
    ),
    TableSpec(
        "campaigns",
        "id string, label string, color string, goal int",
        key="id",
        lengths={"id": 20, "label": 60, "color": 10},
    ),
    TableSpec(
        "channels",
        "id string, label string, color string, base_pct int",
        key="id",
        lengths={"id": 20, "label": 40, "color": 10},
    ),
    TableSpec(
        "callers",
        "name string, role string, tenure string, conv_boost decimal(4,2)",
        key="name",
        lengths={"name": 80, "role": 30, "tenure": 10},
    ),
    TableSpec(
        "donors",
        "name string, segment_id string, max_gift int, first_gift string, lifecycle string",
        key="name",
        lengths={"name": 80, "segment_id": 20, "first_gift": 10, "lifecycle": 20},
        references={"segment_id": "segments"},
        domains={"lifecycle": ("active", "new", "lapsed", "reactivated")},
    ),
    TableSpec(
        "donations",
        "id bigint, gift_date date, donor_name string, campaign_id string,"
        " channel_id string, amount int, status string",
        key="id",
        lengths={"donor_name": 80, "campaign_id": 20, "channel_id": 20, "status": 10},
        references={"donor_name": "donors", "campaign_id": "campaigns", "channel_id": "channels"},
        domains={"status": ("completed", "pending", "failed")},
        time_column="gift_date",
        optional="source_ref string",
    ),
    TableSpec(
        "calls",
        "id bigint, call_time timestamp_ntz, caller_name string, contact string,"
        " duration_sec int, outcome string, pledge int, note_text string, note_context string",
        key="id",
        lengths={"caller_name": 80, "contact": 80, "outcome": 12, "note_context": 80},
        references={"caller_name": "callers", "contact": "donors"},
        domains={"outcome": ("answered", "voicemail", "missed")},
        nullable=frozenset({"note_text", "note_context"}),
        time_column="call_time",
    ),
)

# Parents come before the tables that refer to them.
TABLES: dict[str, TableSpec] = {spec.name: spec for spec in _SPECS}


class Tables:
    """The input of every report. A table is opened when first asked for, so a report
    does not list the files of tables it never reads."""

    segments: DataFrame
    campaigns: DataFrame
    channels: DataFrame
    callers: DataFrame
    donors: DataFrame
    donations: DataFrame
    calls: DataFrame

    def __init__(self, load: Callable[[str], DataFrame], by_donor: DataFrame | None = None):
        self._load = load
        # Completed gifts per donor, when shared between reports (plans.donors.shared).
        self.by_donor = by_donor

    def __getattr__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise AttributeError(table)
        df = self._load(table)
        setattr(self, table, df)
        return df

    def __getitem__(self, table: str) -> DataFrame:
        return getattr(self, table)

    def with_(self, **changed: DataFrame) -> Tables:
        """A copy with some tables changed; a shared aggregate no longer fits then."""
        return Tables(lambda table: changed[table] if table in changed else self[table])

    def sharing(self, by_donor: DataFrame) -> Tables:
        return Tables(self.__getitem__, by_donor)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's own columns in their own order and types."""
    fields = TABLES[table].schema
    return df.selectExpr(*(f"CAST({f.name} AS {f.dataType.simpleString()})" for f in fields))


def conform_stored(df: DataFrame, table: str) -> DataFrame:
    """As ``conform``, with the optional columns; NULL where ``df`` lacks them."""
    fields = TABLES[table].stored
    return df.selectExpr(
        *(
            f"CAST({f.name if f.name in df.columns else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in fields
        )
    )
