"""DuckDB SQL equal to each registered query of :mod:`adperf.catalog`.

Runs on the driver's pre-registered views (``events``, ``customer``, ``orders`` ...). The
adapter views are repeated as CTEs so every statement is self-contained.
"""

from __future__ import annotations

RAW = """raw AS (
  SELECT e.event_id AS id, e.user_id AS campaign_id,
    CASE WHEN e.event_type = 'error' THEN NULL WHEN e.user_id % 4 = 0 THEN 'meta'
         WHEN e.user_id % 4 = 1 THEN 'google' WHEN e.user_id % 4 = 2 THEN 'linkedin'
         ELSE 'tiktok' END AS platform,
    e.event_type AS event_type,
    CAST(CASE WHEN e.event_type = 'view' THEN 10 ELSE 0 END AS BIGINT) AS impressions,
    CAST(CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS clicks,
    CAST(CASE WHEN e.event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS BIGINT)
      AS conversions,
    CASE WHEN e.event_type = 'click'
         THEN CAST(e.value AS DECIMAL(18,2)) - CAST(5 AS DECIMAL(18,2))
         ELSE CAST(0 AS DECIMAL(18,2)) END AS spend,
    CASE WHEN e.event_type = 'purchase' THEN CAST(e.value AS DECIMAL(18,2))
         ELSE CAST(0 AS DECIMAL(18,2)) END AS revenue,
    e.ts AS event_time, r.r_name AS region
  FROM events e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

KEY_DAY = ("concat_ws(':', platform, CAST(campaign_id AS VARCHAR), event_type, "
           "strftime(event_time, '%Y-%m-%d'))")
KEY_TTL = "concat_ws(':', platform, CAST(campaign_id AS VARCHAR), event_type)"


def _valid(key_sql: str = KEY_DAY) -> str:
    return f"""valid AS (
  SELECT id, campaign_id, platform, COALESCE(NULLIF(event_type, ''), 'stats') AS event_type,
    GREATEST(COALESCE(impressions, 0), 0) AS impressions,
    GREATEST(COALESCE(clicks, 0), 0) AS clicks,
    GREATEST(COALESCE(conversions, 0), 0) AS conversions,
    GREATEST(COALESCE(spend, 0), CAST(0 AS DECIMAL(18,2))) AS spend,
    GREATEST(COALESCE(revenue, 0), CAST(0 AS DECIMAL(18,2))) AS revenue,
    event_time, COALESCE(NULLIF(region, ''), 'all') AS region, 'USD' AS currency,
    {key_sql} AS deduplication_key,
    event_time AS received_at, event_time AS processed_at
  FROM raw
  WHERE campaign_id IS NOT NULL AND platform IS NOT NULL AND platform <> ''
    AND event_time IS NOT NULL
)"""


# The last version per fact key; every path from facts to insights counts it once.
def _latest(src: str = "valid", name: str = "latest") -> str:
    return f"""{name} AS (
  SELECT * FROM {src} QUALIFY row_number() OVER (
    PARTITION BY campaign_id, event_time, deduplication_key
    ORDER BY processed_at DESC, id DESC) = 1
)"""


KEY_REPLAY = "concat_ws(':', platform, CAST(id AS VARCHAR))"

EVENT_COLS = ("id, campaign_id, platform, event_type, impressions, clicks, conversions, "
              "CAST(spend AS DOUBLE) AS spend, CAST(revenue AS DOUBLE) AS revenue, event_time, "
              "region, currency, deduplication_key")


def _ratios(p: str = "") -> str:
    def r(n, d):
        return (f"CASE WHEN {p}{d} > 0 THEN CAST({p}{n} AS DOUBLE) / CAST({p}{d} AS DOUBLE) "
                f"ELSE 0.0 END")
    return (f"{r('clicks', 'impressions')} AS ctr, {r('spend', 'clicks')} AS cpc, "
            f"{r('spend', 'conversions')} AS cpa, {r('revenue', 'spend')} AS roas, "
            f"{r('conversions', 'clicks')} AS conversion_rate")


def _rollup(src: str, date_expr: str, name: str, where: str = "TRUE") -> str:
    """CTE ``name`` with summed metrics (decimals kept) per insight key."""
    return f"""{name}_sums AS (
  SELECT campaign_id, {date_expr} AS date, platform, region,
    CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
    CAST(SUM(conversions) AS BIGINT) AS conversions,
    SUM(spend) AS spend, SUM(revenue) AS revenue
  FROM {src} WHERE {where}
  GROUP BY ALL
), {name} AS (
  SELECT campaign_id, date, platform, region, impressions, clicks, conversions,
    CAST(spend AS DOUBLE) AS spend, CAST(revenue AS DOUBLE) AS revenue, {_ratios()}
  FROM {name}_sums
)"""


INSIGHT_COLS = ("campaign_id, date, platform, region, impressions, clicks, conversions, spend, "
                "revenue, ctr, cpc, cpa, roas, conversion_rate")
DAY = "CAST(event_time AS DATE)"
WEEK = "CAST(date_trunc('week', event_time) AS DATE)"
MONTH = "CAST(date_trunc('month', event_time) AS DATE)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["validate_accept"] = _with(RAW, _valid()) + f"SELECT {EVENT_COLS} FROM valid"

SQL["validate_rejects"] = _with(RAW) + """SELECT id, campaign_id, event_type, event_time,
  CASE WHEN campaign_id IS NULL THEN 'missing campaign ID'
       WHEN platform IS NULL OR platform = '' THEN 'missing platform'
       WHEN event_time IS NULL THEN 'missing event time'
       ELSE 'missing deduplication key' END AS reject_reason
FROM raw
WHERE campaign_id IS NULL OR platform IS NULL OR platform = '' OR event_time IS NULL"""

SQL["dedup_last"] = _with(RAW, _valid(), """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY deduplication_key
                               ORDER BY processed_at DESC, id DESC) AS rn
  FROM valid
)""") + f"SELECT {EVENT_COLS} FROM ranked WHERE rn = 1"

# First-wins with a 7-day TTL that restarts only on accepted rows: follow successor
# pointers from each key's first row with a recursive CTE.
SQL["dedup_first_ttl"] = "WITH RECURSIVE " + ",\n".join([RAW, _valid(KEY_TTL), """nodes AS (
  SELECT deduplication_key AS k, received_at AS t, MIN(id) AS nid
  FROM valid GROUP BY 1, 2
)""", """succ AS (
  SELECT a.k, a.t, MIN(b.t) AS nt
  FROM nodes a LEFT JOIN nodes b ON a.k = b.k AND b.t >= a.t + INTERVAL 7 DAY
  GROUP BY a.k, a.t
)""", """chain(k, t) AS (
  SELECT k, MIN(t) FROM nodes GROUP BY k
  UNION ALL
  SELECT s.k, s.nt FROM chain c JOIN succ s ON s.k = c.k AND s.t = c.t WHERE s.nt IS NOT NULL
)"""]) + f"""
SELECT {EVENT_COLS} FROM valid v
JOIN nodes n ON v.deduplication_key = n.k AND v.received_at = n.t AND v.id = n.nid
JOIN chain c ON c.k = n.k AND c.t = n.t"""

SQL["insights_daily"] = _with(RAW, _valid(), _latest(), _rollup("latest", DAY, "daily")) + \
    f"SELECT {INSIGHT_COLS} FROM daily"
SQL["insights_weekly"] = _with(RAW, _valid(), _latest(), _rollup("latest", WEEK, "weekly")) + \
    f"SELECT {INSIGHT_COLS} FROM weekly"
SQL["insights_monthly"] = _with(RAW, _valid(), _latest(), _rollup("latest", MONTH, "monthly")) + \
    f"SELECT {INSIGHT_COLS} FROM monthly"
# Latest version wins; the full recompute is newer than the stale load for every key.
SQL["insights_latest"] = SQL["insights_daily"]

SQL["insights_filtered"] = _with(RAW, _valid(), _latest(), _rollup("latest", DAY, "daily")) + f"""
SELECT {INSIGHT_COLS} FROM daily
WHERE date >= DATE '2024-01-08' AND date <= DATE '2024-01-21'
  AND platform = 'google' AND region = 'AMERICA'"""

SQL["insights_default_range"] = _with(RAW, _valid(), _latest(), _rollup("latest", DAY, "daily")) + f"""
SELECT {INSIGHT_COLS} FROM daily
WHERE date >= DATE '2024-01-25' - INTERVAL 30 DAY AND date <= DATE '2024-01-25'"""

SQL["insights_for_owner"] = _with(RAW, _valid(), _latest(), _rollup("latest", DAY, "daily")) + f"""
SELECT {INSIGHT_COLS}, o.user_id FROM daily
JOIN (SELECT c_custkey AS campaign_id, CAST(c_nationkey AS BIGINT) AS user_id FROM customer) o
  USING (campaign_id)"""

SQL["reaggregate_range"] = _with(
    RAW, _valid(), _latest(),
    _rollup("latest", DAY, "stale", "event_time < TIMESTAMP '2024-01-15 12:00:00'"),
    _rollup("latest", DAY, "fresh", "event_time >= TIMESTAMP '2024-01-10 00:00:00' "
                                    "AND event_time < TIMESTAMP '2024-01-21 00:00:00'")) + f"""
SELECT {INSIGHT_COLS} FROM stale
WHERE date NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
UNION ALL
SELECT {INSIGHT_COLS} FROM fresh"""

# Applying the arrival batches one by one ends at the full daily roll-up.
SQL["rollup_incremental"] = SQL["insights_daily"]
# The stream stores every accepted event once under its own key; its insight table is the
# daily roll-up.
SQL["stream_ingest"] = _with(RAW, _valid(KEY_REPLAY), _latest(),
                             _rollup("latest", DAY, "daily")) + \
    f"SELECT {INSIGHT_COLS} FROM daily"


def _platform(col: str) -> str:
    return (f"CASE WHEN {col} % 4 = 0 THEN 'meta' WHEN {col} % 4 = 1 THEN 'google' "
            f"WHEN {col} % 4 = 2 THEN 'linkedin' ELSE 'tiktok' END")


CAMP = f"""camp AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, {_platform('o_orderkey')} AS platform,
    CAST(o_totalprice AS DECIMAL(12,2)) AS budget, o_orderdate AS start_date,
    o_orderdate + INTERVAL 90 DAY AS end_date, o_orderstatus AS status, o_orderdate AS created_at
  FROM orders
)"""
SNAP = "snap AS (SELECT * FROM camp WHERE created_at < TIMESTAMP '1998-01-01 00:00:00')"
CAMP_COLS = ("c.id, c.user_id, c.platform, CAST(c.budget AS DOUBLE) AS budget, c.start_date, "
             "c.end_date, c.status, c.created_at")

SQL["campaign_list"] = _with(CAMP) + f"""
SELECT {CAMP_COLS} FROM camp c WHERE c.platform = 'google' AND c.status = 'O'"""

SQL["campaign_get"] = _with(CAMP) + """
SELECT r.id, c.user_id, c.platform, CAST(c.budget AS DOUBLE) AS budget, c.start_date,
  c.end_date, c.status, c.created_at, c.id IS NOT NULL AS found
FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) r LEFT JOIN camp c ON r.id = c.id"""

SQL["campaign_upsert"] = _with(CAMP, f"""changes AS (
  SELECT l_orderkey AS id, l_shipdate AS updated_at, l_linenumber AS seq,
    {_platform('l_orderkey')} AS platform, CAST(l_extendedprice AS DECIMAL(12,2)) AS budget,
    l_shipdate AS start_date, l_shipdate + INTERVAL 90 DAY AS end_date, l_linestatus AS status
  FROM lineitem
)""", """latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC,
      platform DESC, budget DESC, start_date DESC, end_date DESC, status DESC) AS rn
    FROM changes) WHERE rn = 1
)""") + """
SELECT c.id, c.user_id,
  CASE WHEN l.id IS NULL THEN c.platform ELSE l.platform END AS platform,
  CAST(CASE WHEN l.id IS NULL THEN c.budget ELSE l.budget END AS DOUBLE) AS budget,
  CASE WHEN l.id IS NULL THEN c.start_date ELSE l.start_date END AS start_date,
  CASE WHEN l.id IS NULL THEN c.end_date ELSE l.end_date END AS end_date,
  CASE WHEN l.id IS NULL THEN c.status ELSE l.status END AS status,
  c.created_at,
  CASE WHEN l.id IS NULL THEN c.created_at ELSE l.updated_at END AS updated_at
FROM camp c LEFT JOIN latest l ON c.id = l.id"""

SQL["campaign_insert_absent"] = _with(CAMP, SNAP) + f"""
SELECT {CAMP_COLS},
  CASE WHEN EXISTS (SELECT 1 FROM snap s WHERE s.id = c.id) THEN 'already exists'
       ELSE 'inserted' END AS outcome
FROM camp c"""

SQL["campaign_orphans"] = _with(CAMP, SNAP) + """
SELECT l_orderkey AS campaign_id, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS spend
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.id = l.l_orderkey)"""

INC = """inc AS (
  SELECT l_orderkey AS campaign_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS spend FROM lineitem
)"""
TOTALS = """totals AS (
  SELECT campaign_id, SUM(spend) AS spend FROM inc
  WHERE campaign_id IS NOT NULL AND spend IS NOT NULL AND spend > 0 GROUP BY campaign_id
)"""

SQL["spend_totals"] = _with(INC, TOTALS) + \
    "SELECT campaign_id, CAST(spend AS DOUBLE) AS spend FROM totals"

SQL["budget_status"] = _with(CAMP, INC, TOTALS) + """
SELECT c.id AS campaign_id, CAST(c.budget AS DOUBLE) AS budget,
  CAST(COALESCE(t.spend, 0) AS DOUBLE) AS spend,
  CAST(c.budget - COALESCE(t.spend, 0) AS DOUBLE) AS remaining,
  CASE WHEN c.budget - COALESCE(t.spend, 0) <= 0 THEN 'Overspent' ELSE 'Active' END AS status
FROM camp c LEFT JOIN totals t ON c.id = t.campaign_id"""

SQL["spend_rejects"] = _with(CAMP, INC) + """
SELECT campaign_id, CAST(spend AS DOUBLE) AS spend, reason FROM (
  SELECT campaign_id, spend,
    CASE WHEN campaign_id IS NULL THEN 'campaign ID is required'
         WHEN spend IS NULL OR spend = 0 THEN 'spend is required'
         WHEN spend < 0 THEN 'spend amount cannot be negative'
         WHEN NOT EXISTS (SELECT 1 FROM camp c WHERE c.id = inc.campaign_id)
           THEN 'campaign not found' END AS reason
  FROM inc) WHERE reason IS NOT NULL"""

SQL["audit_unique"] = """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""


def _fk(name: str, child: str, ck: str, parent: str, pk: str) -> str:
    return (f"SELECT '{name}' AS constraint_name, COUNT(*) AS checked_rows, "
            f"COUNT(*) FILTER (WHERE ch.{ck} IS NOT NULL AND p.{pk} IS NULL) AS violations "
            f"FROM {child} ch LEFT JOIN (SELECT DISTINCT {pk} FROM {parent}) p "
            f"ON ch.{ck} = p.{pk}")


SQL["audit_fk"] = "\nUNION ALL\n".join([
    _fk("orders.o_custkey->customer", "orders", "o_custkey", "customer", "c_custkey"),
    _fk("lineitem.l_orderkey->orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    _fk("events.user_id->customer", "events", "user_id", "customer", "c_custkey"),
    _fk("customer.c_nationkey->nation", "customer", "c_nationkey", "nation", "n_nationkey"),
])

SQL["audit_nulls"] = _with(CAMP) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM camp"
    for c in ("id", "user_id", "platform", "budget", "start_date", "end_date", "status",
              "created_at"))

_PLATFORMS = "('meta', 'google', 'linkedin', 'tiktok')"
_CAMP_CHECKS = {
    "campaigns.budget_decimal_12_2":
        "budget IS NOT NULL AND TRY_CAST(budget AS DECIMAL(12,2)) IS NULL",
    "campaigns.platform_enum": f"platform IS NOT NULL AND platform NOT IN {_PLATFORMS}",
    "campaigns.platform_length": "length(platform) > 50",
    "campaigns.status_length": "length(status) > 50",
    "campaigns.end_before_start": "end_date < start_date",
}
_EVENT_CHECKS = {"events.platform_enum": f"platform IS NOT NULL AND platform NOT IN {_PLATFORMS}"}
for _m in ("impressions", "clicks", "conversions", "spend", "revenue"):
    _EVENT_CHECKS[f"events.{_m}_negative"] = f"{_m} < 0"

SQL["audit_domain"] = _with(RAW, f"""src AS (
  SELECT o_orderkey AS id, {_platform('o_orderkey')} AS platform, o_totalprice AS budget,
    o_orderdate AS start_date, o_orderdate + INTERVAL 90 DAY AS end_date,
    o_orderstatus AS status FROM orders
)""") + "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS check_name, COUNT(*) FILTER (WHERE COALESCE({c}, FALSE)) AS violations "
     f"FROM src" for n, c in _CAMP_CHECKS.items()]
    + [f"SELECT '{n}' AS check_name, COUNT(*) FILTER (WHERE COALESCE({c}, FALSE)) AS violations "
       f"FROM raw" for n, c in _EVENT_CHECKS.items()])


def _plan(src: str, as_of: str) -> str:
    return f"""SELECT x.campaign_id, x.platform, CAST(r.d AS DATE) AS day
FROM (SELECT campaign_id, platform,
        GREATEST(CAST(DATE '{as_of}' - INTERVAL 30 DAY AS DATE), CAST(start_date AS DATE)) AS s
      FROM {src}) x,
     LATERAL (SELECT unnest(generate_series(CAST(x.s AS TIMESTAMP), TIMESTAMP '{as_of} 00:00:00',
                                            INTERVAL 1 DAY)) AS d) r
WHERE x.s <= DATE '{as_of}'"""


SQL["fetch_plan"] = _with(CAMP, "cs AS (SELECT id AS campaign_id, platform, start_date FROM camp)") \
    + _plan("cs", "1997-01-01")

SQL["missing_days"] = _with(RAW, _valid(), _latest(), _rollup("latest", DAY, "daily"), """started AS (
  SELECT campaign_id, platform, MIN(event_time) AS start_date FROM valid GROUP BY 1, 2
)""", f"plan AS ({_plan('started', '2024-01-30')})") + """
SELECT p.campaign_id, p.platform, p.day FROM plan p
WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.campaign_id = p.campaign_id AND d.date = p.day)"""

SQL["event_json_roundtrip"] = _with(RAW) + f"""
SELECT id, campaign_id, platform, event_type, impressions, clicks, conversions,
  CAST(spend AS DOUBLE) AS spend, CAST(revenue AS DOUBLE) AS revenue, event_time, region,
  CAST(NULL AS VARCHAR) AS currency, {KEY_DAY} AS deduplication_key
FROM raw"""

SQL["payload_flatten"] = _with(RAW, _valid(), _latest(), _rollup("latest", DAY, "daily")) + """
SELECT campaign_id, platform, 'daily_stats' AS event_type, impressions, clicks, conversions,
  spend, revenue, CAST(date AS TIMESTAMP) AS event_time, 'all' AS region, 'USD' AS currency,
  platform || ':ext-' || CAST(campaign_id AS VARCHAR) || ':' || strftime(date, '%Y-%m-%d')
    AS deduplication_key
FROM daily"""

SQL["insights_owner_weekly"] = _with(
    RAW, _valid(), _latest(), """owned AS (
  SELECT v.*, CAST(c.c_nationkey AS BIGINT) AS user_id
  FROM latest v JOIN customer c ON v.campaign_id = c.c_custkey
  WHERE CAST(v.event_time AS DATE) >= DATE '2024-01-08'
    AND CAST(v.event_time AS DATE) <= DATE '2024-01-21'
)""", f"""weekly_sums AS (
  SELECT campaign_id, {WEEK} AS date, platform, region, user_id,
    CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
    CAST(SUM(conversions) AS BIGINT) AS conversions, SUM(spend) AS spend, SUM(revenue) AS revenue
  FROM owned GROUP BY ALL
)""") + f"""
SELECT campaign_id, date, platform, region, impressions, clicks, conversions,
  CAST(spend AS DOUBLE) AS spend, CAST(revenue AS DOUBLE) AS revenue, {_ratios()}, user_id
FROM weekly_sums"""

# The stored-table jobs end at the same tables as their in-memory twins.
SQL["batch_ingest_store"] = SQL["stream_ingest"]
SQL["reaggregate_store"] = SQL["reaggregate_range"]
SQL["payload_files"] = SQL["payload_flatten"]

# ---- rows that make the rules bite --------------------------------------------------------

SQL["dedup_redelivery"] = SQL["dedup_first_ttl"]
SQL["dedup_heavy"] = SQL["dedup_first_ttl"]

# One row per key, whatever is redelivered: the first by (received_at, id).
SQL["ingest_two_batches"] = _with(RAW, _valid(), """firsts AS (
  SELECT * FROM valid QUALIFY row_number() OVER (
    PARTITION BY deduplication_key ORDER BY received_at, id) = 1
)""", _rollup("firsts", DAY, "daily")) + f"SELECT {INSIGHT_COLS} FROM daily"
SQL["ingest_late"] = SQL["stream_ingest"]

SQL["ingest_rerun_corrected"] = _with(
    RAW.replace("e.ts AS event_time", "CASE WHEN e.event_type = 'click' "
                "THEN e.ts + INTERVAL 1 DAY ELSE e.ts END AS event_time"),
    _valid(KEY_REPLAY), _latest(), _rollup("latest", DAY, "daily")) + \
    f"SELECT {INSIGHT_COLS} FROM daily"

# The re-runs lose keys that the last batch brings again.
SQL["ingest_rerun_loses_keys"] = SQL["stream_ingest"]

SQL["reaggregate_corrected_region"] = _with(RAW, _valid(), _latest(), f"""fixed AS (
  SELECT * REPLACE (CASE WHEN event_type = 'purchase'
                          AND {DAY} BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
                         THEN 'MOVED' ELSE region END AS region) FROM latest
)""", _rollup("fixed", DAY, "daily")) + f"SELECT {INSIGHT_COLS} FROM daily"

# Every owner may refresh the own campaign, so the whole range is fresh.
SQL["reaggregate_requested"] = SQL["reaggregate_range"]

SQL["insights_request_stored"] = _with(
    RAW, _valid(), _latest(), """own AS (
  SELECT c_custkey AS campaign_id, CAST(c_nationkey AS BIGINT) AS user_id FROM customer
)""", """asked AS (
  SELECT campaign_id, user_id, 'ok' AS access FROM own
  UNION ALL SELECT campaign_id, user_id + 1, 'forbidden' FROM own
  UNION ALL SELECT campaign_id + 1000000000, user_id, 'not_found' FROM own
)""", _rollup("latest", WEEK, "weekly",
              "CAST(event_time AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-25'")) + f"""
SELECT a.user_id, access,
  CASE WHEN w.date IS NOT NULL THEN CAST(row_number() OVER (
    PARTITION BY a.user_id, a.campaign_id ORDER BY w.date, w.platform, w.region) AS INTEGER)
  END AS position,
  a.campaign_id, {INSIGHT_COLS.replace('campaign_id, ', '')}
FROM asked a LEFT JOIN weekly w ON a.campaign_id = w.campaign_id AND a.access = 'ok'"""

SQL["ensure_tables_roundtrip"] = _with(RAW, _valid()) + """
SELECT CAST(event_time AS DATE) AS event_date, 'all' AS ingest_batch, COUNT(*) AS n,
  CAST(SUM(clicks) AS BIGINT) AS clicks FROM valid GROUP BY 1"""

SQL["insights_subcent"] = _with(RAW, _valid(), _latest(), """thousandth AS (
  SELECT * REPLACE (spend * CAST(0.001 AS DECIMAL(4,3)) AS spend,
                    revenue * CAST(0.001 AS DECIMAL(4,3)) AS revenue) FROM latest
)""", _rollup("thousandth", DAY, "daily")) + f"SELECT {INSIGHT_COLS} FROM daily"

SQL["validate_reasons"] = _with(RAW) + f"""
SELECT reject_reason, id % 11 AS "case", COUNT(*) AS n, CAST(0 AS BIGINT) AS null_ids FROM (
  SELECT id, CASE
    WHEN id % 11 = 0 THEN 'missing campaign ID'
    WHEN id % 11 = 1 OR (platform IS NULL AND id % 11 <> 5) THEN 'missing platform'
    WHEN id % 11 = 2 THEN 'missing event time'
    WHEN id % 11 = 3 THEN 'missing deduplication key'
    WHEN id % 11 = 4 THEN 'amount out of range' END AS reject_reason FROM raw)
GROUP BY 1, 2"""

SQL["spend_rejects_mixed"] = _with(CAMP, """inc AS (
  SELECT CASE WHEN l_linenumber = 6 THEN l_orderkey + 1000000000
              WHEN l_linenumber <> 7 THEN l_orderkey END AS campaign_id,
         CASE WHEN l_linenumber = 4 THEN 0 WHEN l_linenumber <> 3
              THEN CAST(l_extendedprice AS DECIMAL(12,2)) - 20000 END AS spend
  FROM lineitem
)""") + SQL["spend_rejects"][SQL["spend_rejects"].index("\nSELECT campaign_id"):]

SQL["campaign_get_unknown"] = SQL["campaign_get"] + """
UNION ALL
SELECT DISTINCT l_orderkey + 1000000000, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
  CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP),
  CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), FALSE FROM lineitem"""

SQL["campaign_list_users"] = _with(CAMP) + f"""
SELECT {CAMP_COLS}, CAST(row_number() OVER (
    PARTITION BY c.user_id ORDER BY c.created_at DESC, c.id) AS INTEGER) AS position
FROM camp c WHERE c.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""

SQL["campaign_insert_dups"] = SQL["campaign_insert_absent"] + f"""
UNION ALL
SELECT {CAMP_COLS.replace('c.created_at', 'c.created_at + INTERVAL 1 DAY AS created_at')},
  'duplicate in batch' FROM camp c"""

SQL["audit_fk_orphans"] = "\nUNION ALL\n".join([
    _fk("orders.o_custkey->customer", "orders", "o_custkey",
        "(SELECT * FROM customer WHERE c_acctbal >= 0)", "c_custkey"),
    _fk("events.user_id->customer", "events", "user_id",
        "(SELECT * FROM customer WHERE c_acctbal >= 0)", "c_custkey"),
    _fk("lineitem.l_orderkey->orders", "lineitem", "l_orderkey",
        "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00')",
        "o_orderkey"),
])

_BROKEN = f"""broken AS (
  SELECT o_orderkey AS id, nullif(o_custkey % 10, 3) AS user_id,
    CASE WHEN o_orderstatus = 'F' THEN 'other' WHEN o_orderstatus = 'P' THEN repeat('x', 51)
         ELSE {_platform('o_orderkey')} END AS platform,
    CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1e8 ELSE o_totalprice END AS budget,
    CAST(NULL AS TIMESTAMP) AS start_none, o_orderdate AS start_date,
    o_orderdate - INTERVAL 1 DAY AS end_date,
    CASE WHEN o_orderstatus = 'P' THEN repeat(o_orderstatus, 60) ELSE o_orderstatus END AS status,
    CASE WHEN o_orderstatus <> 'F' THEN repeat(o_orderstatus, 256) END AS name,
    repeat('e', o_orderkey % 300) AS external_id FROM orders
), users AS (
  SELECT repeat('m', c_custkey % 300) AS email, repeat('n', c_custkey % 300 + 1) AS name,
    repeat('r', c_custkey % 300 + 2) AS role FROM customer
)"""

SQL["audit_nulls_found"] = _with(_BROKEN) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM broken"
    for c in ("id", "user_id", "start_none", "name", "platform"))

_FOUND = dict(_CAMP_CHECKS) | {"campaigns.name_length": "length(name) > 255",
                               "campaigns.external_id_length": "length(external_id) > 255"}
SQL["audit_domain_found"] = _with(_BROKEN) + "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS check_name, COUNT(*) FILTER (WHERE COALESCE({c}, FALSE)) AS violations "
     f"FROM broken" for n, c in _FOUND.items()]
    + [f"SELECT 'users.{c}_length' AS check_name, COUNT(*) FILTER (WHERE length({c}) > {n}) "
       f"AS violations FROM users" for c, n in (("email", 255), ("name", 255), ("role", 50))])

SQL["audit_currency"] = _with(RAW, _valid()) + """
SELECT campaign_id, CAST(2 AS BIGINT) AS currencies FROM valid GROUP BY campaign_id
HAVING COUNT(DISTINCT event_type = 'purchase') = 2"""

SQL["event_json_any_case"] = SQL["event_json_roundtrip"]
SQL["fetch_publish"] = SQL["payload_flatten"]

SQL["spend_running"] = _with(CAMP, """inc AS (
  SELECT CASE WHEN l_linenumber = 6 THEN l_orderkey + 1000000000
              WHEN l_linenumber <> 7 THEN l_orderkey END AS campaign_id,
         CAST(CASE WHEN l_linenumber = 4 THEN 0 WHEN l_linenumber <> 3
              THEN CAST(l_extendedprice AS DECIMAL(12,2)) - 20000 END AS DECIMAL(12,2)) AS spend,
         l_shipdate AS updated_at, l_linenumber AS seq
  FROM lineitem
)""", """budgets AS (
  SELECT id, CAST(budget * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS budget,
         CAST(budget * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS stored FROM camp
)""", """running AS (
  SELECT i.*, b.budget, b.stored + sum(spend) OVER (
      PARTITION BY campaign_id ORDER BY updated_at, seq, spend
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM inc i JOIN budgets b ON i.campaign_id = b.id WHERE spend > 0
)""") + """
SELECT campaign_id, updated_at, seq, CAST(spend AS DOUBLE) AS spend,
  CAST(total AS DOUBLE) AS new_spend, CAST(budget - total AS DOUBLE) AS remaining,
  CASE WHEN budget - total <= 0 THEN 'Overspent' ELSE 'Active' END AS status,
  budget - total <= 0 AND budget - total + spend > 0 AS became_overspent
FROM running"""

JUDGED = f"""judged AS (
  SELECT CASE WHEN l_linenumber = 6 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS id,
    CASE WHEN l_linenumber % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
    l_shipdate AS updated_at, l_linenumber AS seq, {_platform('l_orderkey')} AS platform,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS budget, l_shipdate AS start_date,
    l_shipdate + INTERVAL 90 DAY AS end_date, l_linestatus AS status,
    CASE WHEN l_linenumber = 6 THEN 'not_found' WHEN l_linenumber % 2 = 0 THEN 'forbidden'
         ELSE 'ok' END AS access
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
SQL["campaign_update_owned"] = SQL["campaign_upsert"].replace(
    SQL["campaign_upsert"][SQL["campaign_upsert"].index("changes AS ("):
                           SQL["campaign_upsert"].index("latest AS (")],
    JUDGED + ",\nchanges AS (SELECT * FROM judged WHERE access = 'ok'),\n")

SQL["campaign_update_refused"] = _with(JUDGED) + """
SELECT id, user_id, updated_at, seq, access FROM judged WHERE access <> 'ok'"""

SQL["fetch_plan_owned"] = _with(CAMP, """cs AS (
  SELECT id AS campaign_id, platform, start_date FROM camp
)""", f"plan AS ({_plan('cs', '1997-01-01')})") + """
SELECT p.campaign_id, c.user_id, 'ok' AS access, p.platform, p.day
FROM plan p JOIN camp c ON p.campaign_id = c.id
UNION ALL
SELECT id, user_id + 1, 'forbidden', CAST(NULL AS VARCHAR), CAST(NULL AS DATE) FROM camp
UNION ALL
SELECT id + 1000000000, user_id, 'not_found', CAST(NULL AS VARCHAR), CAST(NULL AS DATE) FROM camp"""

# stopped runs leave nothing: the rows are those of the corrected re-run alone
SQL["ingest_interrupted"] = SQL["ingest_rerun_corrected"]

SQL["stream_deltas"] = SQL["insights_daily"]

SQL["ingest_deltas"] = _with(RAW, _valid(KEY_REPLAY), """versions AS (
  SELECT * FROM valid WHERE event_type <> 'signup'
  UNION ALL
  SELECT * REPLACE ('MOVED' AS region, processed_at + INTERVAL 1 DAY AS processed_at)
  FROM valid WHERE event_type = 'purchase'
  UNION ALL
  SELECT * REPLACE ('LOST' AS region, processed_at - INTERVAL 1 DAY AS processed_at)
  FROM valid WHERE event_type = 'click'
)""", _latest("versions"), _rollup("latest", DAY, "daily")) + f"SELECT {INSIGHT_COLS} FROM daily"

SQL["message_log_ingest"] = SQL["insights_daily"]
SQL["message_log_sink"] = SQL["event_json_roundtrip"].replace(KEY_DAY, KEY_REPLAY)
SQL["stream_windows"] = SQL["insights_daily"]

SQL["store_retention"] = SQL["insights_daily"] + " WHERE date >= DATE '2024-01-08'"

SQL["insights_clustered"] = SQL["insights_daily"] + """
WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
  AND campaign_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)"""

SQL["dimension_scans"] = _with(CAMP) + """
SELECT c.id, c.user_id, u.c_name || '@example.org' AS email, c.platform,
  CAST(c.budget AS DOUBLE) AS budget, c.status, CAST(NULL AS VARCHAR) AS name,
  0 AS secret_columns
FROM camp c JOIN customer u ON c.user_id = u.c_custkey"""

SQL["validate_stamps"] = _with(RAW, _valid(KEY_REPLAY)) + """
SELECT id, CASE WHEN id % 3 > 0 THEN received_at ELSE TIMESTAMP '2024-02-01' END AS received_at,
  TIMESTAMP '2024-02-01 00:00:05' AS processed_at FROM valid"""

SQL["parse_days"] = """
SELECT l_linenumber AS line, CASE WHEN l_linenumber = 1 OR l_linenumber > 7
  THEN CAST(l_shipdate AS DATE) END AS day, count(*) AS n FROM lineitem GROUP BY 1, 2"""
