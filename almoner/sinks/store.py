"""The seven tables as tables of Spark's catalog.

Gifts and calls are partitioned by month and donors by a hash of their name, so that a cut-off or an upsert
rewrites the partitions it touches and no others (dynamic partition overwrite). Spark puts a
job's files in place when all its tasks are done: a job that dies before that leaves the table as it was, and every write here
may be repeated. Counts of rows come from the write itself. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from almoner.model import BUCKET_COLUMN, PERIOD_COLUMN, TABLES, Tables, conform_stored
from almoner.operators.ids import largest_id
from almoner.operators.layers import replace_live_layer

BUCKETS = 64

_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
# Table properties: the number of buckets, and the largest id that was ever given.
_BUCKETS = "almoner.buckets"
_LAST_ID = "almoner.last_id"


@contextmanager
def _dynamic(spark: SparkSession, on: bool) -> Iterator[None]:
    """Whether an overwrite replaces the partitions it writes, or the whole table."""
    before = spark.conf.get(_OVERWRITE_MODE)
    spark.conf.set(_OVERWRITE_MODE, "dynamic" if on else "static")
    try:
        yield
    finally:
        spark.conf.set(_OVERWRITE_MODE, before)


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` and what will know their number once they are written. To be the last step before a write: a
    result task counts once, however often an executor is lost."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def rows_of(seen: Observation) -> int:
    return seen.get.get("rows", 0)


class Store:
    """Tables in a database of the catalog, made in ``location`` or, if that is None, in the warehouse."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.database = database
        self.buckets = buckets
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def there(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def create(self, *tables: str) -> None:
        """Empty tables (all seven, if none are named) where there are none yet."""
        for table in tables or TABLES:
            spec = TABLES[table]
            columns = ", ".join(x for x in (spec.ddl, spec.optional) if x)
            layout = properties = ""
            if spec.time_column:
                columns, layout = f"{columns}, {PERIOD_COLUMN} date", f"PARTITIONED BY ({PERIOD_COLUMN})"
            elif table == "donors":
                columns, layout = f"{columns}, {BUCKET_COLUMN} int", f"PARTITIONED BY ({BUCKET_COLUMN})"
                properties = f"TBLPROPERTIES ('{_BUCKETS}' = '{self.buckets}')"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet {layout} {properties}")

    def read(self, table: str) -> DataFrame:
        """The table as it is; gifts and calls also carry their month, donors their bucket."""
        # Another session (that of a stream's batch) may have written it.
        self.spark.catalog.refreshTable(self.name(table))
        return self.spark.table(self.name(table))

    def tables(self) -> Tables:
        return Tables(self.read)

    def property(self, table: str, key: str) -> str | None:
        found = self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").where(F.col("key") == key).first()
        return found["value"] if found else None

    # -- writes ---------------------------------------------------------------

    def _layout(self, table: str, df: DataFrame) -> DataFrame:
        """The rows with the partition column last. Rebalancing gathers a partition's rows into few
        files and splits one that is too large for one task."""
        rows = conform_stored(df, table)
        time_column = TABLES[table].time_column
        if time_column:
            rows = rows.withColumn(PERIOD_COLUMN, F.trunc(F.col(time_column).cast("date"), "month"))
            return rows.hint("rebalance", F.col(PERIOD_COLUMN))
        if table == "donors":
            rows = rows.withColumn(BUCKET_COLUMN, self.bucket(F.col("name")))
            return rows.hint("rebalance", F.col(BUCKET_COLUMN))
        return rows

    def bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(int(self.property("donors", _BUCKETS)))).cast("int")

    def _write(self, table: str, rows: DataFrame, overwrite: bool, dynamic: bool = False) -> int:
        rows, seen = counted(rows)
        with _dynamic(rows.sparkSession, dynamic):
            rows.write.insertInto(self.name(table), overwrite=overwrite)
        return rows_of(seen)

    def replace(self, table: str, df: DataFrame) -> int:
        """Exactly these rows; returns their number. ``df`` must not read the table (Spark refuses that)."""
        self.create(table)
        n = self._write(table, self._layout(table, df), overwrite=True)
        if table in ("donations", "calls"):
            self.spark.sql(f"ALTER TABLE {self.name(table)} UNSET TBLPROPERTIES IF EXISTS ('{_LAST_ID}')")
        return n

    def append(self, table: str, df: DataFrame) -> int:
        """Adds gifts or calls in new files of their months; returns their number."""
        self.create(table)
        # First, so that an append that dies leaves a gap and never a reused id.
        self._note_last_id(table, max(self.last_id(table), largest_id(df)))
        return self._write(table, self._layout(table, df), overwrite=False)

    def last_id(self, table: str) -> int:
        """The largest id given so far. Noted with the table, so that an append does not read all
        ids again; the first call after a replacement does."""
        noted = self.property(table, _LAST_ID)
        if noted is None:
            noted = largest_id(self.read(table))
            self._note_last_id(table, noted)
        return int(noted)

    def _note_last_id(self, table: str, last: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.name(table)} SET TBLPROPERTIES ('{_LAST_ID}' = '{last}')")

    def put_donors(self, rows: DataFrame, changed: DataFrame) -> int:
        """Writes the buckets that hold a ``changed`` donor anew from ``rows``, which has all donors of these
        buckets and may read the table. Other buckets keep their files. Returns how many buckets were written."""
        touched = changed.select(self.bucket(F.col("name")).alias("b")).distinct()
        # At most as many as there are buckets.
        numbers = [r["b"] for r in touched.collect()]
        if numbers:
            laid = self._layout("donors", rows).where(F.col(BUCKET_COLUMN).isin(numbers))
            self._write("donors", laid, overwrite=True, dynamic=True)
        return len(numbers)

    def put_part(self, table: str, part: Mapping[str, object], rows: DataFrame) -> int:
        """Replaces one partition of a side table, which is made when first written; ``rows`` must not read it."""
        given = ", ".join(f"{k} = '{v}'" for k, v in part.items())
        if not self.there(table):
            kinds = ", ".join(f"{k} string" for k in part)
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
            self.spark.sql(
                f"CREATE TABLE {self.name(table)} ({columns}, {kinds}) USING parquet PARTITIONED BY ({', '.join(part)})"
            )
        own = [c for c in self.spark.table(self.name(table)).columns if c not in part]
        laid, seen = counted(rows.select(*own))
        with _dynamic(rows.sparkSession, False):
            rows.sparkSession.sql(f"INSERT OVERWRITE {self.name(table)} PARTITION ({given}) SELECT * FROM {{laid}}", laid=laid)
        return rows_of(seen)

    def replace_since(self, layers: Mapping[str, DataFrame], since: date) -> dict[str, int]:
        """Replaces the rows from ``since`` on by those of the layers, for gifts and calls in one run; rows without a date
        stay. Returns how many rows each layer brought. The layers may read the tables.

        Only partitions from the cut-off month on are written. All new rows, and what the cut-off month held before
        that day, are staged as tables first; a staged table is in the catalog only when it is whole. What a run that died
        had staged is put in place before the next one begins.
        """
        for table in layers:
            self.create(table)
            for left in self._staged(table):
                self._put_staged(table, date.fromisoformat(left.rsplit("_", 1)[1]))
        for table, layer in layers.items():
            stored = self.read(table).where(F.col(PERIOD_COLUMN) >= F.lit(since.replace(day=1)))
            rows = replace_live_layer(
                conform_stored(stored, table), conform_stored(layer, table), TABLES[table].time_column, since
            )
            name = f"{table}_since_{since:%Y%m%d}"
            # Files of a run that died before its table was made.
            self._clear(name)
            rows.write.saveAsTable(self.name(name))
        return {table: self._put_staged(table, since) for table in layers}

    def _staged(self, table: str) -> list[str]:
        found = self.spark.sql(f"SHOW TABLES IN {self.database} LIKE '{table}_since_*'").collect()
        return sorted(row["tableName"] for row in found)

    def _put_staged(self, table: str, since: date) -> int:
        name = f"{table}_since_{since:%Y%m%d}"
        before, staged = self.last_id(table), self.read(name)
        self._drop_since(table, staged, since)
        late = F.col(TABLES[table].time_column) >= F.lit(since)
        seen = Observation()
        rows = self._layout(table, staged).observe(seen, F.count_if(late).alias("rows"), F.max("id").alias("last"))
        with _dynamic(rows.sparkSession, True):
            rows.write.insertInto(self.name(table), overwrite=True)
        self._note_last_id(table, max(before, seen.get.get("last") or 0))
        self.spark.sql(f"DROP TABLE {self.name(name)}")
        return rows_of(seen)

    def _drop_since(self, table: str, staged: DataFrame, since: date) -> None:
        """Drops the months from the cut-off on that get no new rows."""
        month = F.trunc(F.col(TABLES[table].time_column).cast("date"), "month")
        kept = {str(r[0]) for r in staged.select(month).distinct().collect()}
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect():
            found = row["partition"].split("=", 1)[1]
            if found[:1].isdigit() and found >= str(since.replace(day=1)) and found not in kept:
                self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({PERIOD_COLUMN} = DATE'{found}')")

    def _clear(self, table: str) -> None:
        place = self.spark.sql(f"DESCRIBE DATABASE {self.database}").where("info_name = 'Location'").first()["info_value"]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def copy_tables(source: Tables, store: Store) -> DataFrame:
    """Replaces every stored table by the source's, parents first: table, rows as counted by the
    writes. Surrogate ids are kept. Runs jobs."""
    written = [(table, store.replace(table, source[table])) for table in TABLES]
    return store.spark.createDataFrame(written, "table string, rows bigint")
