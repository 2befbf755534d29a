"""The seven tables as views over the order-and-events test tables.

Customers play donors, orders gifts, suppliers callers and events calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almoner.model import Tables

# The last order day of the test tables, "today" for the daily trend.
LAST_DAY = "2001-08-01"
# The segment that plays the recurring givers.
RECURRING_SEGMENT = "HOUSEHOLD"

# Fixed lookup rows: the segments, priorities and channels that occur, and one
# of each kind that never does.
_SEGMENTS = """
    ('AUTOMOBILE', 'Automobile', 500, 300, '#1B9E77', 'car'),
    ('BUILDING',   'Building',   400, 300, '#D95F02', 'house'),
    ('FURNITURE',  'Furniture',  300, 300, '#7570B3', 'chair'),
    ('HOUSEHOLD',  'Household',  200, 300, '#E7298A', 'home'),
    ('MACHINERY',  'Machinery',  100, 300, '#66A61E', 'gear'),
    ('EMPTY',      'Empty',        0,   0, '#666666', 'none')
"""
_CAMPAIGNS = """
    ('1-URGENT',        'Urgent',        '#1F77B4', 250000000),
    ('2-HIGH',          'High',          '#FF7F0E', 250000000),
    ('3-MEDIUM',        'Medium',        '#2CA02C', 250000000),
    ('4-NOT SPECIFIED', 'Not specified', '#D62728', 250000000),
    ('5-LOW',           'Low',           '#9467BD', 250000000),
    ('NONE',            'No gifts',      '#8C564B', 1000)
"""
_CHANNELS = """
    ('online', 'Online', '#4E79A7', 25),
    ('phone',  'Phone',  '#F28E2B', 25),
    ('mail',   'Mail',   '#E15759', 25),
    ('event',  'Event',  '#76B7B2', 25),
    ('text',   'Text',   '#59A14F', 0)
"""


# Columns read of the test tables; naming them spares a look into the files.
_CUSTOMER = (
    "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
)
_ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string"
)
_SUPPLIER = "s_suppkey bigint, s_name string"
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _numbered(prefix: str, key: str) -> str:
    """The name of a customer or supplier key, so that facts need no join for it."""
    return f"concat('{prefix}#', lpad({key}, greatest(9, length({key})), '0'))"


def _pick(number: str, *values: str) -> str:
    """The value at ``number`` modulo their count."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"elt(CAST({number} % {len(values)} AS INT) + 1, {listed})"


def sample_tables(spark: SparkSession, folder: str) -> Tables:
    def read(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")

    def lookup_rows(rows: str, columns: str) -> DataFrame:
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")

    def donors() -> DataFrame:
        first_order = (
            read("orders", _ORDERS)
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.expr("min(o_orderdate) AS first_order"))
        )
        return (
            read("customer", _CUSTOMER)
            .join(first_order, "c_custkey", "left")
            .selectExpr(
                "c_name AS name",
                "c_mktsegment AS segment_id",
                "CAST(round(c_acctbal) AS INT) AS max_gift",
                "coalesce(date_format(first_order, 'MMM yyyy'), 'Jan 1995') AS first_gift",
                f"{_pick('c_nationkey', 'active', 'new', 'lapsed', 'reactivated')} AS lifecycle",
            )
        )

    def donations() -> DataFrame:
        return read("orders", _ORDERS).selectExpr(
            "o_orderkey AS id",
            "CAST(o_orderdate AS DATE) AS gift_date",
            f"{_numbered('Customer', 'o_custkey')} AS donor_name",
            "o_orderpriority AS campaign_id",
            f"{_pick('o_orderkey', 'online', 'phone', 'mail', 'event')} AS channel_id",
            "CAST(round(o_totalprice) AS INT) AS amount",
            # In this form a filter on the status reaches the Parquet scan.
            "if(o_orderstatus <=> 'F', 'completed',"
            " if(o_orderstatus <=> 'O', 'pending', 'failed')) AS status",
        )

    def callers() -> DataFrame:
        return read("supplier", _SUPPLIER).selectExpr(
            "s_name AS name",
            f"{_pick('s_suppkey', 'Senior caller', 'Caller II', 'Caller I', 'Trainee')} AS role",
            f"{_pick('s_suppkey', '4y', '10mo', '3mo')} AS tenure",
            "CAST(1 AS DECIMAL(4, 2)) AS conv_boost",
        )

    def calls() -> DataFrame:
        return read("events", _EVENTS).selectExpr(
            "event_id AS id",
            "ts AS call_time",
            f"{_numbered('Supplier', '(user_id % 9)')} AS caller_name",
            f"{_numbered('Customer', 'user_id')} AS contact",
            "CAST(floor(value) AS INT) AS duration_sec",
            "if(event_type <=> 'error', 'missed',"
            " if(event_type <=> 'signup', 'voicemail', 'answered')) AS outcome",
            "CASE event_type WHEN 'purchase' THEN CAST(round(value) AS INT) ELSE 0 END AS pledge",
            "CASE WHEN event_id % 5 = 0 THEN concat('note ', event_id) END AS note_text",
            "CAST(NULL AS STRING) AS note_context",
        )

    tables = {
        "segments": lambda: lookup_rows(
            _SEGMENTS, "id, label, avg_gift, donor_count, color, icon"
        ),
        "campaigns": lambda: lookup_rows(_CAMPAIGNS, "id, label, color, goal"),
        "channels": lambda: lookup_rows(_CHANNELS, "id, label, color, base_pct"),
        "callers": callers,
        "donors": donors,
        "donations": donations,
        "calls": calls,
    }
    return Tables(lambda table: tables[table]())


PAGE_SIZE = 50


def _pages(items: DataFrame, collection: str) -> DataFrame:
    """path, page out of number, pos, json: at most 50 items to a page."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "json")))
    page = F.concat(F.lit('{"Results":['), F.array_join(listed["json"], ","), F.lit("]}"))
    path = F.concat(F.lit(f"/{collection}/page-"), F.col("number"), F.lit(".json"))
    return items.groupBy("number").agg(page.alias("page")).select(path.alias("path"), "page")


def donor_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as CRM pages, with every way a name may be given or missing.

    All of them come again, named in full, on later pages.
    """
    customer = spark.read.schema(_CUSTOMER).parquet(f"{folder}/customer.parquet")
    item = """
        CASE c_custkey % 8
            WHEN 1 THEN to_json(struct('Cust' AS FirstName, c_name AS LastName))
            WHEN 2 THEN to_json(struct(c_name AS LastName))
            WHEN 3 THEN '{"FullName":""}'
            WHEN 4 THEN to_json(struct(c_custkey AS FullName, c_name AS FirstName))
            WHEN 5 THEN '{}'
            WHEN 6 THEN concat('{"FullName":null,"FirstName":"', c_name, '"}')
            WHEN 7 THEN to_json(struct(concat(' ', c_name, ' ') AS FullName))
            ELSE to_json(struct(c_name AS FullName))
        END AS json"""
    number, pos = f"c_custkey div {PAGE_SIZE}", f"c_custkey % {PAGE_SIZE} AS pos"
    once = customer.selectExpr(f"{number} AS number", pos, item)
    again = customer.selectExpr(
        f"{number} + 1000000000 AS number", pos, "to_json(struct(c_name AS FullName)) AS json"
    )
    return _pages(once.unionByName(again), "constituents")


def gift_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as CRM pages, with every kind of id, amount, date and donor."""
    orders = spark.read.schema(_ORDERS).parquet(f"{folder}/orders.parquet")
    ident = """CASE WHEN o_orderkey % 7 = 6 THEN CAST(o_orderkey AS STRING) ELSE concat('"', o_orderkey, '"') END"""
    whole = "CAST(round(o_totalprice) AS INT)"
    amount = f"""
        CASE o_orderkey % 11
            WHEN 0 THEN concat(',"Amount":', {whole}, '.5')
            WHEN 1 THEN ',"Amount":null'
            WHEN 2 THEN concat(',"Amount":"', {whole}, '"')
            WHEN 3 THEN ''
            ELSE concat(',"Amount":', {whole})
        END"""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    gift_date = f"""
        CASE o_orderkey % 13
            WHEN 0 THEN ',"Date":"soon"'
            WHEN 1 THEN ''
            WHEN 2 THEN concat(',"Date":"', {day}, 'T10:30:00Z"')
            ELSE concat(',"Date":"', {day}, '"')
        END"""
    name = _numbered("Customer", "o_custkey")
    donor = f"""
        CASE WHEN o_orderkey % 17 = 0 THEN ''
             ELSE concat(',"ConstituentName":"', {name}, '"') END"""
    fields = f"""'{{"Id":', {ident}, {amount}, {gift_date}, {donor}, '}}'"""
    items = orders.selectExpr(
        f"o_orderkey div {PAGE_SIZE} AS number",
        f"o_orderkey % {PAGE_SIZE} AS pos",
        f"concat({fields}) AS json",
    )
    return _pages(items, "transactions")
