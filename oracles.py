"""DuckDB SQL that gives what each query of ``__spark_entry__`` must give.

``BASE`` states the seven tables over the test tables. The report texts join first
and aggregate after, unlike the Spark code they check; ``bench.py --naive`` also
runs them on Spark as the plain form to compare with.
"""

from __future__ import annotations

BASE = """
WITH segments(id, label, avg_gift, donor_count, color, icon) AS (VALUES
    ('AUTOMOBILE', 'Automobile', 500, 300, '#1B9E77', 'car'), ('BUILDING', 'Building', 400, 300, '#D95F02', 'house'),
    ('FURNITURE', 'Furniture', 300, 300, '#7570B3', 'chair'), ('HOUSEHOLD', 'Household', 200, 300, '#E7298A', 'home'),
    ('MACHINERY', 'Machinery', 100, 300, '#66A61E', 'gear'), ('EMPTY', 'Empty', 0, 0, '#666666', 'none')),
campaigns(id, label, color, goal) AS (VALUES
    ('1-URGENT', 'Urgent', '#1F77B4', 250000000), ('2-HIGH', 'High', '#FF7F0E', 250000000),
    ('3-MEDIUM', 'Medium', '#2CA02C', 250000000),
    ('4-NOT SPECIFIED', 'Not specified', '#D62728', 250000000),
    ('5-LOW', 'Low', '#9467BD', 250000000), ('NONE', 'No gifts', '#8C564B', 1000)),
channels(id, label, color, base_pct) AS (VALUES
    ('online', 'Online', '#4E79A7', 25), ('phone', 'Phone', '#F28E2B', 25), ('mail', 'Mail', '#E15759', 25),
    ('event', 'Event', '#76B7B2', 25), ('text', 'Text', '#59A14F', 0)),
donors AS (
    SELECT c_name AS name, c_mktsegment AS segment_id,
           CAST(round(c_acctbal) AS INT) AS max_gift,
           coalesce(strftime(first_order, '%b %Y'), 'Jan 1995') AS first_gift,
           CASE c_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'new'
                                WHEN 2 THEN 'lapsed' ELSE 'reactivated' END AS lifecycle
    FROM customer
    LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey)
           ON o_custkey = c_custkey),
donations AS (
    SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS gift_date, c_name AS donor_name,
           o_orderpriority AS campaign_id,
           CASE o_orderkey % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'phone'
                               WHEN 2 THEN 'mail' ELSE 'event' END AS channel_id,
           CAST(round(o_totalprice) AS INT) AS amount,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                              ELSE 'failed' END AS status
    FROM orders JOIN customer ON c_custkey = o_custkey),
callers AS (
    SELECT s_name AS name,
           CASE s_suppkey % 4 WHEN 0 THEN 'Senior caller' WHEN 1 THEN 'Caller II'
                              WHEN 2 THEN 'Caller I' ELSE 'Trainee' END AS role,
           CASE s_suppkey % 3 WHEN 0 THEN '4y' WHEN 1 THEN '10mo' ELSE '3mo' END AS tenure,
           CAST(1 AS DECIMAL(4, 2)) AS conv_boost
    FROM supplier),
calls AS (
    SELECT event_id AS id, ts AS call_time, s_name AS caller_name, c_name AS contact,
           CAST(floor(value) AS INT) AS duration_sec,
           CASE event_type WHEN 'error' THEN 'missed' WHEN 'signup' THEN 'voicemail'
                           ELSE 'answered' END AS outcome,
           CASE WHEN event_type = 'purchase' THEN CAST(round(value) AS INT) ELSE 0 END AS pledge,
           CASE WHEN event_id % 5 = 0 THEN 'note ' || CAST(event_id AS VARCHAR) END AS note_text,
           CAST(NULL AS VARCHAR) AS note_context
    FROM events JOIN supplier ON s_suppkey = user_id % 9 JOIN customer ON c_custkey = user_id)
"""


def _pct(part: str, total: str) -> str:
    """100 * part / total to one digit, exactly; for values that are not negative."""
    return f"CAST((2000 * ({part}) + ({total})) // (2 * ({total})) AS DOUBLE) / 10"


def _mean(column: str) -> str:
    total, n = f"sum({column})", f"nullif(count({column}), 0)"
    return f"CAST((2 * {total} + {n}) // (2 * {n}) AS BIGINT)"


_SUM = "CAST(coalesce(sum({}), 0) AS BIGINT)"
_ANSWERED = "count(CASE WHEN outcome = 'answered' THEN 1 END)"
_PLEDGED = "count(CASE WHEN pledge > 0 THEN 1 END)"
_DURATION = "CAST(duration_sec // 60 AS VARCHAR) || ':' || lpad(CAST(duration_sec % 60 AS VARCHAR), 2, '0')"
_COMPLETED = "status = 'completed'"


def _overview(donations: str, calls: str) -> str:
    return f"""
    SELECT total_raised, donor_count, calls_placed,
           coalesce({_pct('pledged', 'nullif(answered, 0)')}, 0) AS pledge_conversion_pct
    FROM (SELECT {_SUM.format('amount')} AS total_raised, count(DISTINCT donor_name) AS donor_count
          FROM {donations} AS d WHERE {_COMPLETED}) AS g
    CROSS JOIN (SELECT count(*) AS calls_placed, {_PLEDGED} AS pledged, {_ANSWERED} AS answered
                FROM {calls} AS c) AS h"""


def _channel_breakdown(donations: str) -> str:
    return f"""
    SELECT channel_id, label, color, revenue, gifts,
           {_pct('revenue', 'nullif(sum(revenue) OVER (), 0)')} AS pct_of_total
    FROM (SELECT ch.id AS channel_id, ch.label, ch.color, {_SUM.format('d.amount')} AS revenue,
                 count(d.id) AS gifts
          FROM channels AS ch
          LEFT JOIN {donations} AS d ON d.channel_id = ch.id AND d.{_COMPLETED}
          GROUP BY ch.id, ch.label, ch.color) AS per_channel"""


def _donor_segments(donations: str, donors: str = "donors") -> str:
    return f"""
    SELECT s.id AS segment_id, s.label, s.color, count(DISTINCT d.donor_name) AS donors,
           {_SUM.format('d.amount')} AS total_raised, coalesce({_mean('d.amount')}, 0) AS avg_gift
    FROM segments AS s
    LEFT JOIN {donors} AS p ON p.segment_id = s.id
    LEFT JOIN {donations} AS d ON d.donor_name = p.name AND d.{_COMPLETED}
    GROUP BY s.id, s.label, s.color"""


_DONATIONS_EXPORT = """
    SELECT strftime(d.gift_date, '%Y-%m-%d') AS gift_date, d.donor_name, c.label AS campaign,
           ch.label AS channel, d.amount, d.status
    FROM donations AS d
    JOIN campaigns AS c ON c.id = d.campaign_id
    JOIN channels AS ch ON ch.id = d.channel_id"""

_CALLS_EXPORT = f"""
    SELECT strftime(call_time, '%Y-%m-%d %H:%M') AS call_time, caller_name, contact,
           {_DURATION} AS duration_label, outcome, pledge, note_text
    FROM calls"""

_CAMPAIGNS = f"""
    SELECT campaign_id, label, color, goal, raised, {_pct('raised', 'goal')} AS pct_of_goal
    FROM (SELECT c.id AS campaign_id, c.label, c.color, c.goal, {_SUM.format('d.amount')} AS raised,
                 count(d.id) AS gifts
          FROM campaigns AS c
          LEFT JOIN donations AS d ON d.campaign_id = c.id AND d.{_COMPLETED}
          GROUP BY c.id, c.label, c.color, c.goal) AS per_campaign"""

REPORTS: dict[str, str] = {
    "overview": _overview("donations", "calls"),
    "donation_summary": f"""
    SELECT {_SUM.format('amount')} AS total_raised, count(*) AS total_gifts,
           count(DISTINCT donor_name) AS unique_donors,
           coalesce({_mean('amount')}, 0) AS avg_gift_size
    FROM donations WHERE {_COMPLETED}""",
    "monthly_donations": f"""
    SELECT CAST(month(gift_date) AS INT) AS month, strftime(gift_date, '%b') AS month_name,
           {_SUM.format('amount')} AS revenue, count(*) AS gifts
    FROM donations WHERE {_COMPLETED}
    GROUP BY month(gift_date), strftime(gift_date, '%b')""",
    "monthly_trend": f"""
    SELECT CAST(month(gift_date) AS INT) AS month, strftime(gift_date, '%b') AS month_name,
           {_SUM.format("CASE WHEN segment_id <> 'HOUSEHOLD' THEN amount END")} AS one_time,
           {_SUM.format("CASE WHEN segment_id = 'HOUSEHOLD' THEN amount END")} AS recurring,
           CAST(sum(amount) * 22 AS DOUBLE) / 100 AS pledges
    FROM donations JOIN donors ON name = donor_name
    WHERE {_COMPLETED}
    GROUP BY month(gift_date), strftime(gift_date, '%b')""",
    "daily_trend": f"""
    SELECT gift_date AS date, {_SUM.format('amount')} AS revenue, count(*) AS gifts
    FROM donations
    WHERE {_COMPLETED} AND gift_date >= CAST(DATE '2001-08-01' - INTERVAL '30' DAY AS DATE)
    GROUP BY gift_date""",
    "campaign_breakdown": _CAMPAIGNS,
    "channel_breakdown": _channel_breakdown("donations"),
    "donation_rows": """
    SELECT strftime(d.gift_date, '%d %b') AS gift_date, d.donor_name, p.segment_id,
           c.label AS campaign, ch.label AS channel, d.amount, d.status
    FROM donations AS d
    JOIN donors AS p ON p.name = d.donor_name
    JOIN campaigns AS c ON c.id = d.campaign_id
    JOIN channels AS ch ON ch.id = d.channel_id
    ORDER BY d.gift_date DESC, d.id DESC LIMIT 100""",
    "donations_export": _DONATIONS_EXPORT + " ORDER BY d.gift_date DESC, d.id DESC",
    "call_summary": f"""
    SELECT count(*) AS calls_placed, {_ANSWERED} AS calls_connected,
           {_pct(_ANSWERED, 'nullif(count(*), 0)')} AS connect_rate_pct,
           {_PLEDGED} AS pledged_calls,
           {_pct(_PLEDGED, f'nullif({_ANSWERED}, 0)')} AS pledge_conv_pct,
           {_mean("CASE WHEN outcome = 'answered' THEN duration_sec END")} AS avg_duration_sec
    FROM calls""",
    "call_outcomes": f"""
    SELECT outcome, n AS count, {_pct('n', 'sum(n) OVER ()')} AS pct
    FROM (SELECT outcome, count(*) AS n FROM calls GROUP BY outcome) AS per_outcome""",
    "caller_leaderboard": f"""
    SELECT name, role, tenure, calls_placed, connected, pledges, total_pledged,
           {_pct('connected', 'nullif(calls_placed, 0)')} AS connect_rate_pct,
           {_pct('pledges', 'nullif(connected, 0)')} AS conv_rate_pct
    FROM (SELECT c.name, c.role, c.tenure, count(k.id) AS calls_placed, {_ANSWERED} AS connected,
                 {_PLEDGED} AS pledges, {_SUM.format('k.pledge')} AS total_pledged
          FROM callers AS c LEFT JOIN calls AS k ON k.caller_name = c.name
          GROUP BY c.name, c.role, c.tenure) AS per_caller""",
    "call_rows": f"""
    SELECT strftime(call_time, '%d %b %H:%M') AS call_time, caller_name, contact,
           {_DURATION} AS duration_label, outcome, pledge, note_text
    FROM (SELECT * FROM calls ORDER BY calls.call_time DESC, id DESC LIMIT 100) AS newest""",
    "monthly_calls": f"""
    SELECT CAST(month(call_time) AS INT) AS month, strftime(call_time, '%b') AS month_name,
           count(*) AS placed, {_ANSWERED} AS connected,
           {_pct(_ANSWERED, 'nullif(count(*), 0)')} AS connect_rate
    FROM calls GROUP BY month(call_time), strftime(call_time, '%b')""",
    "hour_heatmap": f"""
    SELECT CAST(hour(call_time) AS INT) AS hour, count(*) AS total, {_ANSWERED} AS connected,
           {_pct(_ANSWERED, 'nullif(count(*), 0)')} AS connect_rate
    FROM calls GROUP BY hour(call_time)""",
    "calls_export": _CALLS_EXPORT + " ORDER BY calls.call_time DESC, id DESC",
    "donor_segments": _donor_segments("donations"),
    "donor_lifecycle": "SELECT lifecycle, count(*) AS count FROM donors GROUP BY lifecycle",
    "donor_roster": f"""
    SELECT p.name, p.segment_id, s.label AS segment_label, p.first_gift, p.lifecycle,
           count(d.id) AS gifts, {_SUM.format('d.amount')} AS total, {_mean('d.amount')} AS avg_gift
    FROM donors AS p
    JOIN segments AS s ON s.id = p.segment_id
    LEFT JOIN donations AS d ON d.donor_name = p.name AND d.{_COMPLETED}
    GROUP BY p.name, p.segment_id, s.label, p.first_gift, p.lifecycle
    HAVING count(d.id) > 0""",
    "at_risk_donors": f"""
    SELECT p.name, s.label AS segment_label, p.first_gift,
           {_SUM.format('d.amount')} AS lifetime_value, count(d.id) AS gift_count
    FROM donors AS p
    JOIN segments AS s ON s.id = p.segment_id
    LEFT JOIN donations AS d ON d.donor_name = p.name AND d.{_COMPLETED}
    WHERE p.lifecycle = 'lapsed'
    GROUP BY p.name, s.label, p.first_gift""",
    "raised_totals": f"""
    SELECT CAST(sum(amount) AS BIGINT) AS total_raised, count(DISTINCT donor_name) AS active_donors,
           {_mean('amount')} AS avg_gift
    FROM donations WHERE {_COMPLETED}""",
    "channel_totals": f"""
    SELECT channel_id, CAST(sum(amount) AS BIGINT) AS revenue, count(*) AS gifts
    FROM donations WHERE {_COMPLETED} GROUP BY channel_id""",
    "campaign_vs_goal": f"""
    SELECT campaign_id, label, goal, raised, pct_of_goal FROM ({_CAMPAIGNS}) AS b
    WHERE campaign_id IN (SELECT campaign_id FROM donations WHERE {_COMPLETED})""",
    "top_donors": f"""
    SELECT donor_name, CAST(sum(amount) AS BIGINT) AS total, count(*) AS gifts
    FROM donations WHERE {_COMPLETED}
    GROUP BY donor_name ORDER BY total DESC, donor_name LIMIT 10""",
    "lapsed_by_segment_id": f"""
    SELECT p.name, p.segment_id, p.first_gift, p.lifecycle,
           {_SUM.format('d.amount')} AS lifetime_value
    FROM donors AS p LEFT JOIN donations AS d ON d.donor_name = p.name AND d.{_COMPLETED}
    WHERE p.lifecycle = 'lapsed'
    GROUP BY p.name, p.segment_id, p.first_gift, p.lifecycle""",
    "caller_totals": f"""
    SELECT caller_name, count(*) AS calls_placed, {_ANSWERED} AS connected, {_PLEDGED} AS pledges,
           CAST(sum(pledge) AS BIGINT) AS total_pledged,
           {_pct(_ANSWERED, 'count(*)')} AS connect_rate_pct
    FROM calls GROUP BY caller_name""",
}

# Gifts, calls and donors of one segment; gifts also of one campaign and channel.
_IN_SEGMENT = "(SELECT name FROM donors WHERE segment_id = 'BUILDING')"
_SCOPED_GIFTS = f"""(SELECT * FROM donations WHERE donor_name IN {_IN_SEGMENT}
                     AND campaign_id = '1-URGENT' AND channel_id = 'online')"""
_SEGMENT_GIFTS = f"(SELECT * FROM donations WHERE donor_name IN {_IN_SEGMENT})"
_SCOPED_CALLS = f"(SELECT * FROM calls WHERE contact IN {_IN_SEGMENT})"

SCOPED: dict[str, str] = {
    "scoped_overview": _overview(_SCOPED_GIFTS, _SCOPED_CALLS),
    "scoped_channel_breakdown": _channel_breakdown(_SEGMENT_GIFTS),
    "scoped_donor_segments": _donor_segments(
        _SCOPED_GIFTS, "(SELECT * FROM donors WHERE segment_id = 'BUILDING')"
    ),
}

# The same tables narrowed to a segment, a campaign and a channel, for every other report.
_NARROWED = (
    BASE.replace("donors AS (", "every_donor AS (").replace("donations AS (", "every_gift AS (").replace("calls AS (", "every_call AS (")
    + """,
donors AS (SELECT * FROM every_donor WHERE segment_id = 'BUILDING'),
donations AS (SELECT * FROM every_gift WHERE donor_name IN (SELECT name FROM donors)
              AND campaign_id = '1-URGENT' AND channel_id = 'online'),
calls AS (SELECT * FROM every_call WHERE contact IN (SELECT name FROM donors))
"""
)
SCOPED_REPORTS = (
    "donation_summary monthly_donations monthly_trend daily_trend campaign_breakdown donation_rows donations_export call_summary"
    " call_outcomes caller_leaderboard call_rows monthly_calls hour_heatmap calls_export donor_lifecycle donor_roster at_risk_donors"
).split()

# What the CRM pages made from customers and orders hold.
_DONOR_ITEMS = """,
donor_items AS (
    SELECT number, pos, name FROM (
        SELECT c_custkey // 50 AS number, c_custkey % 50 AS pos,
               CASE c_custkey % 8 WHEN 1 THEN 'Cust ' || c_name WHEN 3 THEN NULL WHEN 5 THEN NULL
                                  WHEN 7 THEN ' ' || c_name || ' ' ELSE c_name END AS name
        FROM customer
        UNION ALL
        SELECT c_custkey // 50 + 1000000000, c_custkey % 50, c_name
        FROM customer) AS given
    WHERE name IS NOT NULL)
"""

_GIFT_ITEMS = """,
gift_items AS (
    SELECT o_orderkey // 50 AS number, o_orderkey % 50 AS pos,
           'crm:' || CAST(o_orderkey AS VARCHAR) AS source_ref,
           CASE WHEN o_orderkey % 13 IN (0, 1) THEN DATE '2001-08-01'
                ELSE CAST(o_orderdate AS DATE) END AS gift_date,
           CASE WHEN o_orderkey % 17 = 0 THEN 'Unknown' ELSE c_name END AS donor_name,
           '2-HIGH' AS campaign_id, 'online' AS channel_id,
           CASE WHEN o_orderkey % 11 = 0 THEN CAST(round(o_totalprice) AS INT) + 0.5
                WHEN o_orderkey % 11 IN (1, 2) THEN 0
                ELSE CAST(round(o_totalprice) AS INT) END AS amount,
           'completed' AS status
    FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderkey % 7 <> 6 AND o_orderkey % 11 <> 3),
known_donations AS (SELECT * FROM donations WHERE status <> 'failed'),
new_gifts AS (
    SELECT DISTINCT gift_date, donor_name, campaign_id, channel_id,
           CAST(floor(amount + 0.5) AS INT) AS amount, status
    FROM gift_items
    WHERE donor_name IN (SELECT name FROM donors)
      AND NOT EXISTS (
        SELECT 1 FROM known_donations AS k
        WHERE k.gift_date = gift_items.gift_date AND k.donor_name = gift_items.donor_name
          AND k.campaign_id = gift_items.campaign_id AND k.channel_id = gift_items.channel_id
          AND k.amount = CAST(floor(gift_items.amount + 0.5) AS INT)))
"""

_DONOR_BATCH = """,
known_donors AS (SELECT * FROM donors WHERE lifecycle <> 'new'),
batch AS (
    SELECT name, number * 100 + pos AS seq, pos * 100 AS max_gift,
           CASE WHEN number >= 1000000000 THEN 'MACHINERY' ELSE 'BUILDING' END AS segment_id,
           CASE WHEN number >= 1000000000 THEN 'Feb 2024' ELSE 'Jan 2024' END AS first_gift,
           CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'active' END AS lifecycle
    FROM donor_items)
"""

JOBS: dict[str, str] = {
    "normalise_donors": BASE + _DONOR_ITEMS + """
    SELECT number AS page, CAST(pos AS INT) AS position, name, 'BUILDING' AS segment_id,
           0 AS max_gift, 'Jan 2024' AS first_gift, 'active' AS lifecycle
    FROM donor_items""",
    "normalise_donations": BASE + _GIFT_ITEMS + """
    SELECT number AS page, CAST(pos AS INT) AS position, source_ref, gift_date, donor_name,
           campaign_id, channel_id, CAST(amount AS DOUBLE) AS amount, status
    FROM gift_items""",
    "crm_items": """
    SELECT CASE WHEN o_orderkey % 7 = 6 THEN 'BIGINT' ELSE 'STRING' END AS id_kind,
           CASE o_orderkey % 11 WHEN 0 THEN 'DECIMAL' WHEN 1 THEN 'VOID' WHEN 2 THEN 'STRING'
                                WHEN 3 THEN 'ABSENT' ELSE 'BIGINT' END AS amount_kind,
           count(*) AS items
    FROM orders GROUP BY 1, 2""",
    "upsert_donors": BASE + _DONOR_ITEMS + _DONOR_BATCH + """,
    incoming AS (
        SELECT name, arg_max(segment_id, seq) AS segment_id, max(max_gift) AS max_gift,
               arg_min(first_gift, seq) AS first_gift, arg_max(lifecycle, seq) AS lifecycle
        FROM batch GROUP BY name)
    SELECT coalesce(k.name, i.name) AS name, coalesce(i.segment_id, k.segment_id) AS segment_id,
           CAST(CASE WHEN k.name IS NULL THEN i.max_gift WHEN i.name IS NULL THEN k.max_gift
                     WHEN i.max_gift > k.max_gift THEN i.max_gift ELSE k.max_gift END AS INT)
               AS max_gift,
           coalesce(k.first_gift, i.first_gift) AS first_gift,
           coalesce(i.lifecycle, k.lifecycle) AS lifecycle
    FROM known_donors AS k FULL JOIN incoming AS i ON i.name = k.name""",
    "insert_ignore": BASE + _DONOR_ITEMS + _DONOR_BATCH + """,
    first_rows AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1)
    SELECT name, segment_id, max_gift, first_gift, lifecycle FROM known_donors
    UNION ALL
    SELECT name, segment_id, CAST(max_gift AS INT), first_gift, lifecycle FROM first_rows
    WHERE name NOT IN (SELECT name FROM known_donors)""",
    "insert_new_donations": BASE + _GIFT_ITEMS + "SELECT * FROM new_gifts",
    "insert_new_donations_rejected": BASE + _GIFT_ITEMS + """
    SELECT 'donor_name unknown' AS reason, count(*) AS rows FROM gift_items
    WHERE donor_name NOT IN (SELECT name FROM donors)""",
    "insert_new_donations_by_source_ref": BASE + _GIFT_ITEMS + """
    SELECT source_ref, gift_date, donor_name, CAST(floor(amount + 0.5) AS INT) AS amount
    FROM gift_items
    WHERE donor_name IN (SELECT name FROM donors)
      AND source_ref NOT IN (SELECT 'crm:' || CAST(id AS VARCHAR) FROM known_donations)""",
    "assign_ids": """
    SELECT top + row_number() OVER () AS id
    FROM orders CROSS JOIN (SELECT max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F')
    WHERE o_orderstatus <> 'F'""",
    "replace_live_layer": BASE + """
    SELECT id, gift_date, donor_name, campaign_id, channel_id, amount, status FROM donations
    WHERE gift_date < DATE '2001-01-15'
    UNION ALL
    SELECT id, gift_date, donor_name, campaign_id, channel_id, amount * 2, status FROM donations
    WHERE gift_date >= DATE '2001-01-15'""",
    "replace_live_layer_stored": """
    SELECT 'donations' AS "table", {donations} AS content
    FROM (SELECT * REPLACE (CASE WHEN gift_date >= DATE '2001-01-15' THEN amount * 2 ELSE amount END AS amount) FROM donations)
    UNION ALL
    SELECT 'calls', {calls}
    FROM (SELECT * REPLACE ('missed' AS outcome, 0 AS pledge,
          CASE WHEN calls.call_time >= DATE '2024-01-15' THEN duration_sec + 1 ELSE duration_sec END AS duration_sec) FROM calls)""",
    "copy_tables": BASE + "".join(
        f"{' UNION ALL ' if i else ''}SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}"
        for i, t in enumerate(
            ("segments", "campaigns", "channels", "callers", "donors", "donations", "calls")
        )
    ),
    "validate_tables": BASE + """
    SELECT 'donors' AS "table", 'name repeated' AS rule, count(*) AS n FROM donors
    WHERE lifecycle = 'lapsed'
    UNION ALL SELECT 'donors', 'segment_id unknown', count(*) FROM donors
    WHERE segment_id = 'MACHINERY' AND lifecycle <> 'lapsed'
    UNION ALL SELECT 'donors', 'segment_id unknown', 2 * count(*) FROM donors
    WHERE segment_id = 'MACHINERY' AND lifecycle = 'lapsed'
    UNION ALL SELECT 'donations', 'donor_name unknown', count(*) FROM donations WHERE id % 10 = 0
    UNION ALL SELECT 'donations', 'status too long', count(*) FROM donations WHERE id % 20 = 1
    UNION ALL SELECT 'donations', 'status not allowed', count(*) FROM donations WHERE id % 20 = 1
    UNION ALL SELECT 'calls', 'outcome missing', count(*) FROM calls WHERE id % 7 = 0""",
    "sync": BASE + _DONOR_ITEMS + _GIFT_ITEMS + """
    SELECT 'crm' AS source, (SELECT count(*) FROM donor_items) AS donors,
           (SELECT count(*) FROM new_gifts) AS donations,
           (SELECT count(*) FROM gift_items WHERE donor_name = 'Unknown') AS rejected,
           false AS failed
    UNION ALL SELECT 'broken', 0, 0, 0, true""",
    "sync_stream": BASE + _GIFT_ITEMS + """
    SELECT gift_date, donor_name, campaign_id, channel_id, amount, status FROM known_donations
    UNION ALL
    SELECT gift_date, donor_name, campaign_id, channel_id, amount, status FROM new_gifts""",
    "sync_stream_donors": BASE + _DONOR_ITEMS + """
    SELECT coalesce(d.name, i.name) AS name, coalesce(i.segment_id, d.segment_id) AS segment_id,
           CAST(greatest(coalesce(d.max_gift, 0), coalesce(i.max_gift, d.max_gift)) AS INT) AS max_gift,
           coalesce(d.first_gift, 'Jan 2024') AS first_gift, coalesce(i.lifecycle, d.lifecycle) AS lifecycle
    FROM donors AS d FULL JOIN (
        SELECT DISTINCT name, 'BUILDING' AS segment_id, 0 AS max_gift, 'active' AS lifecycle FROM donor_items) AS i
      ON i.name = d.name""",
    "sync_by_source_ref": BASE + _GIFT_ITEMS + """
    SELECT gift_date, donor_name, campaign_id, channel_id, amount, status, NULL AS source_ref FROM known_donations
    UNION ALL
    SELECT gift_date, donor_name, campaign_id, channel_id, CAST(floor(amount + 0.5) AS INT), status, source_ref
    FROM gift_items WHERE donor_name IN (SELECT name FROM donors)""",
    "crm_bad_pages": BASE + _GIFT_ITEMS + """
    SELECT source_ref AS found FROM gift_items WHERE number % 5 <> 0
    UNION ALL SELECT DISTINCT 'bad ' || (o_orderkey // 50) FROM orders WHERE o_orderkey // 50 % 5 = 0""",
    "normalise_numeric_ids": """
    SELECT 'crm:' || CAST(o_orderkey AS VARCHAR) AS source_ref FROM orders WHERE o_orderkey % 11 <> 3""",
    "sync_stream_result": BASE + _DONOR_ITEMS + _GIFT_ITEMS + """
    SELECT 'crm' AS source, (SELECT count(*) FROM donor_items) AS donors,
           (SELECT count(*) FROM new_gifts) AS donations,
           (SELECT count(*) FROM gift_items WHERE donor_name = 'Unknown') AS rejected,
           false AS failed
    UNION ALL SELECT 'broken', 0, 0, 0, true""",
    # In the second run only what waits is tried again; in the third also the landed third, whose unknown donors wait already.
    "sync_incremental": BASE + _DONOR_ITEMS + _GIFT_ITEMS + """,
    unknown AS (SELECT count(*) AS n FROM gift_items WHERE donor_name = 'Unknown')
    SELECT 1 AS run, 'crm' AS source, (SELECT count(*) FROM donor_items) AS donors,
           (SELECT count(*) FROM new_gifts) AS donations, (SELECT n FROM unknown) AS rejected
    UNION ALL SELECT 2, 'crm', 0, 0, (SELECT n FROM unknown)
    UNION ALL SELECT 3, 'crm', (SELECT count(*) FROM donor_items WHERE number % 3 = 0), 0, (SELECT n FROM unknown)""",
    "replace_live_layer_undated": BASE + """
    SELECT id, CASE WHEN id % 9 <> 0 THEN gift_date END AS gift_date, donor_name, campaign_id, channel_id, amount, status
    FROM donations WHERE id % 9 = 0 OR gift_date < DATE '2001-01-15'
    UNION ALL
    SELECT id, gift_date, donor_name, campaign_id, channel_id, amount * 2, status FROM donations
    WHERE gift_date >= DATE '2001-01-15'""",
    "load_parquet": BASE + "SELECT * FROM donations",
    "load_csv": BASE + _CALLS_EXPORT,
    "load_json": BASE + "SELECT * FROM donors",
    "donations_csv": BASE + f"""
    SELECT gift_date AS "Date", donor_name AS "Donor", campaign AS "Campaign",
           channel AS "Channel", CAST(amount AS VARCHAR) AS "Amount", status AS "Status"
    FROM ({_DONATIONS_EXPORT}) AS e""",
    "calls_csv": BASE + f"""
    SELECT call_time AS "Time", caller_name AS "Caller", contact AS "Contact",
           duration_label AS "Duration", outcome AS "Outcome", CAST(pledge AS VARCHAR) AS "Pledge"
    FROM ({_CALLS_EXPORT}) AS e""",
}

# The same rule twice in the list above is one row of the report.
JOBS["validate_tables"] = JOBS["validate_tables"].replace(
    'SELECT \'donors\' AS "table"', 'SELECT "table", rule, CAST(sum(n) AS BIGINT) AS n FROM (SELECT \'donors\' AS "table"', 1
) + ') AS found GROUP BY "table", rule'


# All columns of each table.
CONTENT = {
    "segments": ("id", "label", "avg_gift", "donor_count", "color", "icon"),
    "campaigns": ("id", "label", "color", "goal"),
    "channels": ("id", "label", "color", "base_pct"),
    "callers": ("name", "role", "tenure", "conv_boost"),
    "donors": ("name", "segment_id", "max_gift", "first_gift", "lifecycle"),
    "donations": ("id", "gift_date", "donor_name", "campaign_id", "channel_id", "amount", "status"),
    "calls": (
        "id", "call_time", "caller_name", "contact", "duration_sec", "outcome", "pledge", "note_text", "note_context"
    ),
}

# The reports that ``publish`` writes, with their columns.
PUBLISHED = {
    "channel_breakdown": ("channel_id", "label", "color", "revenue", "gifts", "pct_of_total"),
    "donor_segments": ("segment_id", "label", "color", "donors", "total_raised", "avg_gift"),
    "donor_roster": ("name", "segment_id", "segment_label", "first_gift", "lifecycle", "gifts", "total", "avg_gift"),
    "at_risk_donors": ("name", "segment_label", "first_gift", "lifetime_value", "gift_count"),
}


def _text(columns: tuple[str, ...]) -> str:
    times = {"call_time": "strftime(call_time, '%Y-%m-%d %H:%M:%S.%f')"}
    return f"concat_ws('|', {', '.join(f"coalesce(CAST({times.get(c, c)} AS VARCHAR), '-')" for c in columns)})"


def _content(tables: tuple[str, ...] = tuple(CONTENT)) -> str:
    parts = (f"SELECT '{table}' AS \"table\", {_text(CONTENT[table])} AS content FROM {table}" for table in tables)
    return BASE + " UNION ALL ".join(parts)


JOBS["replace_live_layer_stored"] = BASE + JOBS["replace_live_layer_stored"].format(
    donations=_text(CONTENT["donations"]), calls=_text(CONTENT["calls"])
)
JOBS["publish"] = BASE + " UNION ALL ".join(
    f"SELECT '{name}' AS report, {_text(columns)} AS content FROM ({REPORTS[name]}) AS r_{name}"
    for name, columns in PUBLISHED.items()
)
for _row in (
    "load_all_parquet", "load_all_csv", "load_all_json", "load_all_orc", "copy_tables_content", "copy_to_catalog", "load_catalog"
):
    JOBS[_row] = _content()


def all_sql() -> dict[str, str]:
    reports = {name: BASE + body for name, body in (REPORTS | SCOPED).items()}
    narrowed = {f"scoped_{name}": _NARROWED + REPORTS[name] for name in SCOPED_REPORTS}
    return reports | narrowed | JOBS
