"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on the driver's tables registered as views.  The two
adapters are shared CTEs; every computed column is aliased to the same name
the Spark query produces.  Money is summed as DECIMAL(38,6) and reported in
cents as DOUBLE, mirroring ``functions.money``.
"""

from __future__ import annotations

from ..schema import ACTIVE_GAP_SECONDS, SOURCE_TYPE_MAP

_TYPE_CASE = "CASE e.event_type " + " ".join(
    f"WHEN '{src}' THEN '{dst}'" for src, dst in SOURCE_TYPE_MAP.items()) + " ELSE e.event_type END"

# Adapter A: canonical shop events (+ amount) from events and part.
SHOP_EVENTS = f"""
ev_k AS (
  SELECT e.*, TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k FROM events e
),
shop_events AS (
  SELECT e.event_id AS seq,
         CAST(e.event_id AS VARCHAR) AS event_id,
         {_TYPE_CASE} AS event_type,
         CAST(e.user_id AS VARCHAR) AS user_id,
         CAST(e.k AS VARCHAR) AS product_id,
         p.p_name AS product_name,
         e.value AS price,
         COALESCE(CAST(1 + e.k % 3 AS INTEGER), 1) AS quantity,
         e.ts AS ts,
         e.value * COALESCE(CAST(1 + e.k % 3 AS INTEGER), 1) AS amount
  FROM ev_k e LEFT JOIN part p ON e.k = p.p_partkey
),
purchases AS (
  SELECT * FROM shop_events WHERE event_type = 'purchase_completed' AND amount IS NOT NULL
)"""

# Adapter B: one purchase per order line.
SALES = """
sales AS (
  SELECT 'purchase_completed' AS event_type,
         CAST(l.l_partkey AS VARCHAR) AS product_id,
         p.p_name AS product_name,
         l.l_quantity AS quantity,
         l.l_extendedprice AS amount,
         o.o_orderdate AS ts
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""


def money(expr: str) -> str:
    return f"CAST(CAST(COALESCE(SUM(CAST({expr} AS DECIMAL(38,6))), 0) AS DECIMAL(38,2)) AS DOUBLE)"


def with_shop(body: str) -> str:
    return f"WITH {SHOP_EVENTS}\n{body}"


def with_sales(body: str) -> str:
    return f"WITH {SALES}\n{body}"


def js_fixed1(x: str) -> str:
    """JavaScript's toFixed(1): the double's exact value as a decimal (its
    shortest text would hide ties such as 1.15), rounded half away from zero."""
    exact = f"CAST(printf('%.24f', abs({x})) AS DECIMAL(38,20))"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) "
            f"|| CAST(round({exact}, 1)::DECIMAL(38,1) AS VARCHAR) END")


def _trend_cols(name: str, unit: str) -> str:
    prev = (f"CASE WHEN lag(period_start) OVER (ORDER BY period_start) = period_start - INTERVAL 1 {unit} "
            f"THEN lag({name}) OVER (ORDER BY period_start) END")
    prev = f"({prev})"
    pct = f"CASE WHEN {prev} IS NOT NULL AND {prev} <> 0 THEN ({name} - {prev}) / {prev} * 100 END"
    return (f"{name}, {prev} AS {name}_prev, {pct} AS {name}_trend_pct, "
            f"CASE WHEN ({pct}) IS NOT NULL THEN (CASE WHEN ({pct}) >= 0 THEN '+' ELSE '' END) "
            f"|| {js_fixed1(pct)} || '%' END AS {name}_trend, "
            f"CASE WHEN {prev} IS NOT NULL THEN {name} >= {prev} END AS {name}_up")


EVENT_COUNTS = with_shop("""
SELECT count_if(event_type = 'product_viewed') AS product_viewed,
       count_if(event_type = 'cart_added') AS cart_added,
       count_if(event_type = 'cart_removed') AS cart_removed,
       count_if(event_type = 'purchase_completed') AS purchase_completed,
       count_if(event_type = 'payment_failed') AS payment_failed,
       count(*) AS total
FROM shop_events""")

EVENT_COUNTS_DEDUP = with_shop("""
SELECT count_if(event_type = 'product_viewed') AS product_viewed,
       count_if(event_type = 'cart_added') AS cart_added,
       count_if(event_type = 'cart_removed') AS cart_removed,
       count_if(event_type = 'purchase_completed') AS purchase_completed,
       count_if(event_type = 'payment_failed') AS payment_failed,
       count(*) AS total
FROM (SELECT * FROM shop_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1)""")

EVENTS_BY_TYPE = with_shop("""
SELECT COALESCE(event_type, 'unknown') AS event_type, count(*) AS event_count
FROM shop_events GROUP BY 1""")

REVENUE_TOTAL = with_shop(f"""
SELECT {money("CASE WHEN event_type = 'purchase_completed' THEN amount END")} AS total_revenue,
       'INR' AS currency
FROM shop_events""")

CART_ABANDONMENT = with_shop("""
SELECT cart_added, purchases,
       CASE WHEN cart_added > 0 THEN 1.0 - purchases / cart_added END AS abandonment_rate
FROM (SELECT count_if(event_type = 'cart_added') AS cart_added,
             count_if(event_type = 'purchase_completed') AS purchases FROM shop_events)""")

FAILED_PAYMENT_RATE = with_shop("""
SELECT payment_failed, purchases,
       CASE WHEN payment_failed + purchases > 0
            THEN payment_failed / (payment_failed + purchases) END AS failed_payment_rate
FROM (SELECT count_if(event_type = 'payment_failed') AS payment_failed,
             count_if(event_type = 'purchase_completed') AS purchases FROM shop_events)""")

EVENT_BREAKDOWN = with_shop("""
SELECT 'Page Views' AS name, '#8ed5ff' AS color, count_if(event_type = 'product_viewed') AS value FROM shop_events
UNION ALL
SELECT 'Cart Additions', '#bdc2ff', count_if(event_type = 'cart_added') FROM shop_events
UNION ALL
SELECT 'Purchases', '#10b981', count_if(event_type = 'purchase_completed') FROM shop_events""")

PURCHASE_AMOUNT = with_shop("""
SELECT event_id, ts, product_name, price, quantity, amount FROM purchases""")

PRODUCT_COUNTS = with_shop("""
SELECT COALESCE(product_name, 'unknown') AS product_name, count(*) AS purchase_count
FROM purchases GROUP BY 1""")

TOP_PRODUCTS = with_shop("""
SELECT COALESCE(product_name, 'unknown') AS product_name, count(*) AS purchase_count
FROM purchases GROUP BY 1 ORDER BY purchase_count DESC, product_name DESC LIMIT 10""")

TOP_PRODUCTS_PERCENT = with_shop("""
SELECT product_name AS name, purchase_count AS sales,
       purchase_count / greatest(max(purchase_count) OVER (), 1) * 100 AS percent
FROM (SELECT COALESCE(product_name, 'unknown') AS product_name, count(*) AS purchase_count
      FROM purchases GROUP BY 1 ORDER BY purchase_count DESC, product_name DESC LIMIT 10)""")


def _revenue_window(unit: str) -> str:
    return with_shop(f"""
SELECT date_trunc('{unit}', ts) AS window_start, date_trunc('{unit}', ts) + INTERVAL 1 {unit} AS window_end,
       {money("amount")} AS revenue, count(*) AS purchases
FROM purchases GROUP BY 1, 2""")


def _revenue_period(view: str, unit: str) -> str:
    body = f"""
SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS period_start,
       {money("amount")} AS revenue, count(*) AS purchases
FROM {view} GROUP BY 1"""
    return with_shop(body) if view == "purchases" else with_sales(body)


ACTIVE_USERS_SLIDING = with_shop("""
SELECT date_trunc('minute', ts) - to_minutes(r.i) AS window_start,
       date_trunc('minute', ts) - to_minutes(r.i) + INTERVAL 5 MINUTE AS window_end,
       count(DISTINCT COALESCE(user_id, 'unknown')) AS active_users
FROM shop_events, range(0, 5) AS r(i)
GROUP BY 1, 2""")

_SESSIONS = f"""
flagged AS (
  SELECT ts, COALESCE(user_id, 'unknown') AS user_id,
         CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL
                OR ts - lag(ts) OVER (ORDER BY ts) >= INTERVAL {ACTIVE_GAP_SECONDS} SECOND
              THEN 1 ELSE 0 END AS is_start
  FROM shop_events
),
sess AS (
  SELECT ts, user_id, SUM(is_start) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM flagged
),
sessions AS (
  SELECT sid, min(ts) AS session_start, max(ts) + INTERVAL {ACTIVE_GAP_SECONDS} SECOND AS session_end,
         count(DISTINCT user_id) AS active_users, count(*) AS events
  FROM sess GROUP BY sid
)"""

ACTIVE_USER_SESSIONS = with_shop(f""",{_SESSIONS}
SELECT session_start, session_end, active_users, events FROM sessions""")

ACTIVE_USERS_NOW = with_shop(f""",{_SESSIONS}
SELECT CAST(COALESCE((SELECT active_users FROM sessions ORDER BY sid DESC LIMIT 1), 0) AS BIGINT)
         AS active_users,
       'last 5 minutes' AS "window"
""")

KPI_TREND = with_shop(f""",
per_day AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start,
         {money("CASE WHEN event_type = 'purchase_completed' THEN amount END")} AS revenue,
         count_if(event_type = 'purchase_completed') AS orders,
         count_if(event_type = 'payment_failed') AS failed_payments,
         count(DISTINCT COALESCE(user_id, 'unknown')) AS active_users
  FROM shop_events GROUP BY 1
)
SELECT period_start, {_trend_cols("revenue", "day")}, {_trend_cols("orders", "day")},
       {_trend_cols("failed_payments", "day")}, {_trend_cols("active_users", "day")}
FROM per_day""")

REVENUE_RUNNING = with_shop("""
SELECT event_id, ts, amount,
       CAST(CAST(SUM(CAST(amount AS DECIMAL(38,6))) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
                 AS DECIMAL(38,2)) AS DOUBLE) AS cumulative_revenue
FROM purchases""")

REVENUE_HISTORY = with_shop("""
SELECT event_id, ts, strftime(ts, '%H:%M:%S') AS name, revenue FROM (
  SELECT event_id, ts, seq,
         CAST(CAST(SUM(CAST(amount AS DECIMAL(38,6))) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
                   AS DECIMAL(38,2)) AS DOUBLE) AS revenue
  FROM purchases)
ORDER BY ts DESC, seq DESC LIMIT 20""")

_FEED = """,
feed AS (
  SELECT * FROM shop_events
  WHERE event_type IN ('purchase_completed', 'cart_added', 'payment_failed')
    AND (event_type <> 'purchase_completed' OR amount IS NOT NULL)
  ORDER BY ts DESC, seq DESC LIMIT 15
)"""

_FEED_COLS = """COALESCE(event_id, 'unknown') AS id,
       CASE event_type WHEN 'purchase_completed' THEN 'purchase' WHEN 'cart_added' THEN 'cart'
                       ELSE 'error' END AS type,
       CASE event_type WHEN 'purchase_completed' THEN 'Purchase Completed'
                       WHEN 'cart_added' THEN 'Cart Added' ELSE 'Payment Failed' END AS title,
       CASE event_type WHEN 'purchase_completed'
                       THEN COALESCE(product_name, 'Item') || ' - ₹' || CAST(amount AS VARCHAR)
                       WHEN 'cart_added' THEN COALESCE(product_name, 'Item')
                       ELSE 'Processing error' END AS subtitle"""

RECENT_EVENTS = with_shop(f"""{_FEED}
SELECT {_FEED_COLS}, 'Just now' AS time, ts FROM feed""")

FEED_AGE = with_shop(f"""{_FEED},
aged AS (
  SELECT *, (epoch_us((SELECT max(ts) FROM shop_events)) - epoch_us(ts)) // 1000000 AS secs FROM feed
)
SELECT {_FEED_COLS},
       CASE WHEN secs < 60 THEN 'Just now'
            WHEN secs < 3600 THEN CAST(secs // 60 AS VARCHAR) || 'm ago'
            WHEN secs < 86400 THEN CAST(secs // 3600 AS VARCHAR) || 'h ago'
            ELSE CAST(secs // 86400 AS VARCHAR) || 'd ago' END AS time,
       ts
FROM aged""")

ENRICHED_EVENTS = with_shop("""
SELECT s.event_id, s.event_type, s.user_id, s.product_id, s.product_name, s.price, s.quantity, s.ts,
       p.p_brand AS brand, p.p_type AS product_type, p.p_size AS size, p.p_retailprice AS retail_price
FROM shop_events s LEFT JOIN part p ON TRY_CAST(s.product_id AS BIGINT) = p.p_partkey""")

SALES_REVENUE_TOTAL = with_sales(f"""
SELECT {money("amount")} AS total_revenue, 'INR' AS currency FROM sales""")

SALES_TOP_PRODUCTS = with_sales("""
SELECT COALESCE(product_name, 'unknown') AS product_name, count(*) AS purchase_count
FROM sales GROUP BY 1 ORDER BY purchase_count DESC, product_name DESC LIMIT 10""")

SALES_TREND = with_sales(f""",
per_month AS (
  SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period_start,
         {money("amount")} AS revenue, count(*) AS orders
  FROM sales GROUP BY 1
)
SELECT period_start, {_trend_cols("revenue", "month")}, {_trend_cols("orders", "month")} FROM per_month""")


_KPI_PARTS = f""",{_SESSIONS},
kpi AS (
  SELECT {money("CASE WHEN event_type = 'purchase_completed' THEN amount END")} AS revenue,
         CAST(COALESCE((SELECT active_users FROM sessions ORDER BY sid DESC LIMIT 1), 0) AS BIGINT)
           AS active_users,
         count_if(event_type = 'purchase_completed') AS total_orders,
         count_if(event_type = 'payment_failed') AS failed_payments,
         count(*) AS total_events,
         count_if(event_type = 'product_viewed') AS product_viewed,
         count_if(event_type = 'cart_added') AS cart_added,
         count_if(event_type = 'cart_removed') AS cart_removed
  FROM shop_events
)"""

KPIS = with_shop(f"""{_KPI_PARTS}
SELECT revenue, active_users, total_orders, failed_payments, total_events FROM kpi""")

KPI_TEXT = with_shop(f"""{_KPI_PARTS}
SELECT '₹' || {js_fixed1("revenue / 1000")} || 'k' AS revenue_text,
       format('{{:,}}', active_users) AS active_users_text,
       format('{{:,}}', total_orders) AS total_orders_text,
       format('{{:,}}', failed_payments) AS failed_payments_text,
       CASE WHEN total_events >= 1000 THEN {js_fixed1("CAST(total_events AS DOUBLE) / 1000")} || 'k'
            ELSE CAST(total_events AS VARCHAR) END AS total_events_text
FROM kpi""")

_DASHBOARD_PARTS = f"""{_KPI_PARTS}{_FEED},
top AS (
  SELECT COALESCE(product_name, 'unknown') AS product_name, count(*) AS purchase_count
  FROM purchases GROUP BY 1 ORDER BY purchase_count DESC, product_name DESC LIMIT 10
),
hist AS (
  SELECT * FROM (
    SELECT ts, seq, strftime(ts, '%H:%M:%S') AS name,
           CAST(CAST(SUM(CAST(amount AS DECIMAL(38,6))) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
                     AS DECIMAL(38,2)) AS DOUBLE) AS revenue
    FROM purchases)
  ORDER BY ts DESC, seq DESC LIMIT 20
),
board AS (
  SELECT struct_pack(total_revenue := revenue, currency := 'INR') AS revenue,
         struct_pack(products := (SELECT list(struct_pack(product_name := product_name,
                                                          purchase_count := purchase_count)
                                         ORDER BY purchase_count DESC, product_name DESC) FROM top))
           AS top_products,
         struct_pack(product_viewed := product_viewed, cart_added := cart_added,
                     cart_removed := cart_removed, purchase_completed := total_orders,
                     payment_failed := failed_payments, total := total_events) AS event_counts,
         struct_pack(active_users := active_users, "window" := 'last 5 minutes') AS active_users,
         (SELECT list(struct_pack(id := id, type := type, title := title, subtitle := subtitle,
                                  time := 'Just now') ORDER BY ts DESC, seq DESC)
          FROM (SELECT {_FEED_COLS}, ts, seq FROM feed)) AS recent_events,
         (SELECT list(struct_pack(name := name, revenue := revenue) ORDER BY ts, seq) FROM hist)
           AS revenue_history
  FROM kpi
)"""

DASHBOARD = with_shop(f"""{_DASHBOARD_PARTS}
SELECT * FROM board""")

DASHBOARD_JSON = with_shop(f"""{_DASHBOARD_PARTS}
SELECT CAST(to_json(struct_pack(revenue := revenue, top_products := top_products,
                                event_counts := event_counts, active_users := active_users,
                                recent_events := recent_events, revenue_history := revenue_history))
            AS VARCHAR) AS dashboard
FROM board""")


_WIRE_JSON = """CAST(to_json(struct_pack(
    event_id := event_id, event_type := event_type, user_id := user_id, product_id := product_id,
    product_name := product_name, price := price, quantity := quantity,
    "timestamp" := regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''),
    metadata := CASE WHEN product_id IS NOT NULL THEN MAP {'k': product_id} ELSE MAP {} END)) AS VARCHAR)"""

KAFKA_ROWS = with_shop(f"""
SELECT user_id AS key, {_WIRE_JSON} AS value FROM shop_events""")

_CANON_COLS = """event_id, event_type, user_id, product_id, product_name, price, quantity, ts,
       CAST(to_json(CASE WHEN product_id IS NOT NULL THEN MAP {'k': product_id} ELSE MAP {} END)
            AS VARCHAR) AS metadata"""

VALID_EVENTS = with_shop(f"""
SELECT {_CANON_COLS} FROM shop_events""")

LENIENT_EVENTS = with_shop(f"""
SELECT {_CANON_COLS}, amount FROM shop_events""")

PARSE_EVENTS = with_shop("""
SELECT event_id, event_type, user_id, product_name, price, quantity, ts FROM shop_events""")

REJECTED_EVENTS = with_shop(f""",
raw_typed AS (
  SELECT s.* REPLACE (e.event_type AS event_type)
  FROM shop_events s JOIN events e ON s.seq = e.event_id
)
SELECT {_WIRE_JSON} AS raw_value,
       CASE WHEN event_type IN ('product_viewed', 'cart_added', 'cart_removed',
                                'purchase_completed', 'payment_failed') THEN NULL
            ELSE 'invalid_event_type_value' END AS reasons
FROM raw_typed
WHERE event_type NOT IN ('product_viewed', 'cart_added', 'cart_removed',
                         'purchase_completed', 'payment_failed')""")


# a copied event counts once by its id; id-less ones are events of their own, copies too
DEDUP_MISSING_IDS = with_shop("""
SELECT count_if(event_type = 'product_viewed') AS product_viewed, count_if(event_type = 'cart_added') AS cart_added,
       count_if(event_type = 'cart_removed') AS cart_removed,
       count_if(event_type = 'purchase_completed') AS purchase_completed,
       count_if(event_type = 'payment_failed') AS payment_failed, count(*) AS total
FROM (SELECT event_type FROM shop_events WHERE seq % 7 <> 0
      UNION ALL
      SELECT event_type FROM shop_events, range(0, 2) AS r(i) WHERE seq % 7 = 0 AND (seq % 5 = 0 OR i = 0))""")

LENIENT_MISSING_FIELDS = with_shop("""
SELECT seq, CASE WHEN seq % 7 <> 0 THEN event_id END AS event_id, event_type, COALESCE(user_id, 'unknown') AS user_id,
       CASE WHEN seq % 17 = 0 THEN 3000000000 ELSE quantity END AS quantity,
       CASE WHEN seq % 11 = 0 THEN ts WHEN seq % 13 = 0 THEN TIMESTAMP '2024-01-01 12:00:00' ELSE ts END AS ts
FROM shop_events""")

BAD_AMOUNTS = with_shop("""
SELECT count(*) AS total, count_if(event_type = 'purchase_completed') AS purchase_completed,
       CAST(CAST(COALESCE(SUM(CAST(CASE WHEN event_type = 'purchase_completed' AND seq % 19 <> 0 AND seq % 23 <> 0
                 THEN price * CASE WHEN seq % 17 = 0 THEN 3000000000 ELSE quantity END END AS DECIMAL(38,6))), 0)
            AS DECIMAL(38,2)) AS DOUBLE) AS total_revenue
FROM shop_events""")

INGEST_REASONS = with_shop("""
SELECT CASE seq % 10 WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'invalid_event_type_value'
            WHEN 2 THEN 'missing_user_id,missing_product_name' WHEN 3 THEN 'invalid_product_id'
            WHEN 4 THEN 'invalid_price' WHEN 5 THEN 'invalid_quantity' WHEN 6 THEN 'invalid_timestamp'
            WHEN 7 THEN 'invalid_metadata' ELSE '' END AS reasons, count(*) AS requests
FROM shop_events GROUP BY 1""")

INGEST_DEFAULTS = with_shop("""
SELECT event_id, event_type, COALESCE(user_id, 'anonymous') AS user_id, '17' AS product_id, 'thing' AS product_name,
       CAST(2.5 AS DOUBLE) AS price, CASE WHEN seq % 10 = 9 THEN 1 ELSE 2 END AS quantity, ts,
       CASE WHEN seq % 10 = 8 THEN '{"n":"5"}' ELSE '{}' END AS metadata
FROM shop_events WHERE seq % 10 IN (8, 9)""")

DASHBOARD_PAYLOAD = with_shop(f"""{_DASHBOARD_PARTS},
per_day AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start,
         {money("CASE WHEN event_type = 'purchase_completed' THEN amount END")} AS revenue,
         count_if(event_type = 'purchase_completed') AS orders,
         count_if(event_type = 'payment_failed') AS failed_payments,
         count(DISTINCT COALESCE(user_id, 'unknown')) AS active_users
  FROM shop_events GROUP BY 1
), trends AS (
  SELECT period_start, {_trend_cols("revenue", "day")}, {_trend_cols("orders", "day")},
         {_trend_cols("failed_payments", "day")}, {_trend_cols("active_users", "day")} FROM per_day
), t AS (SELECT * FROM trends ORDER BY period_start DESC LIMIT 1)
SELECT [struct_pack(title := 'Total Revenue', "value" := '₹' || {js_fixed1("board.revenue.total_revenue / 1000")} || 'k',
                    trend := t.revenue_trend, "trendUp" := t.revenue_up, subtitle := 'vs previous day'),
        struct_pack(title := 'Active Users', "value" := format('{{:,}}', board.active_users.active_users),
                    trend := t.active_users_trend, "trendUp" := t.active_users_up, subtitle := 'vs previous day'),
        struct_pack(title := 'Total Orders', "value" := format('{{:,}}', board.event_counts.purchase_completed),
                    trend := t.orders_trend, "trendUp" := t.orders_up, subtitle := 'vs previous day'),
        struct_pack(title := 'Failed Payments', "value" := format('{{:,}}', board.event_counts.payment_failed),
                    trend := t.failed_payments_trend, "trendUp" := t.failed_payments_up, subtitle := 'vs previous day')] AS kpis,
       struct_pack(revenue := board.revenue_history,
                   "topProducts" := (SELECT list(struct_pack(name := product_name, sales := purchase_count,
                        percent := purchase_count / greatest((SELECT max(purchase_count) FROM top), 1) * 100)
                        ORDER BY purchase_count DESC, product_name DESC) FROM top),
                   "eventBreakdown" := [struct_pack(name := 'Page Views', "value" := board.event_counts.product_viewed, color := '#8ed5ff'),
                        struct_pack(name := 'Cart Additions', "value" := board.event_counts.cart_added, color := '#bdc2ff'),
                        struct_pack(name := 'Purchases', "value" := board.event_counts.purchase_completed, color := '#10b981')]) AS charts,
       board.recent_events AS "liveEvents"
FROM board, t""")


UNPURCHASED_CARTS = with_shop("""
SELECT event_id, user_id, ts FROM shop_events c
WHERE event_type = 'cart_added' AND NOT EXISTS (
  SELECT 1 FROM shop_events p WHERE p.event_type = 'purchase_completed' AND p.user_id = c.user_id
     AND p.ts >= c.ts AND p.ts < c.ts + INTERVAL 1 DAY)""")


# the dashboard's parts over the events before each hour's end
DASHBOARD_TIMELINE = with_shop(f""",{_SESSIONS},
h AS (
  SELECT unnest(hours) + INTERVAL 1 HOUR AS as_of FROM (
    SELECT generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR) AS hours FROM shop_events)
),
c AS (
  SELECT as_of, {money("CASE WHEN event_type = 'purchase_completed' THEN amount END")} AS revenue,
         struct_pack(product_viewed := count_if(event_type = 'product_viewed'), cart_added := count_if(event_type = 'cart_added'),
                     cart_removed := count_if(event_type = 'cart_removed'),
                     purchase_completed := count_if(event_type = 'purchase_completed'),
                     payment_failed := count_if(event_type = 'payment_failed'), total := count(*)) AS event_counts
  FROM h JOIN shop_events ON ts < as_of GROUP BY as_of
),
u AS (
  SELECT as_of, count(DISTINCT user_id) AS users FROM (
    SELECT as_of, sid, user_id, max(sid) OVER (PARTITION BY as_of) AS newest, max(ts) OVER (PARTITION BY as_of) AS last_ts
    FROM h JOIN sess ON ts < as_of)
  WHERE sid = newest AND as_of < last_ts + INTERVAL {ACTIVE_GAP_SECONDS} SECOND GROUP BY as_of
),
p AS (
  SELECT as_of, list(struct_pack(product_name := product_name, purchase_count := n) ORDER BY n DESC, product_name DESC) AS products
  FROM (SELECT * FROM (SELECT as_of, COALESCE(product_name, 'unknown') AS product_name, count(*) AS n
                       FROM h JOIN purchases ON ts < as_of GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY n DESC, product_name DESC) <= 10)
  GROUP BY as_of
),
f AS (
  SELECT as_of, list(struct_pack(id := id, type := type, title := title, subtitle := subtitle, time := 'Just now')
                     ORDER BY ts DESC, seq DESC) AS recent_events
  FROM (SELECT as_of, ts, seq, {_FEED_COLS} FROM h JOIN shop_events ON ts < as_of
        WHERE event_type IN ('purchase_completed', 'cart_added', 'payment_failed')
          AND (event_type <> 'purchase_completed' OR amount IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY ts DESC, seq DESC) <= 15)
  GROUP BY as_of
),
r AS (
  SELECT ts, seq, strftime(ts, '%H:%M:%S') AS name,
         CAST(CAST(SUM(CAST(amount AS DECIMAL(38,6))) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS DOUBLE) AS revenue
  FROM purchases
),
y AS (
  SELECT as_of, list(struct_pack(name := name, revenue := revenue) ORDER BY ts, seq) AS revenue_history
  FROM (SELECT as_of, r.* FROM h JOIN r ON ts < as_of
        QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY ts DESC, seq DESC) <= 20)
  GROUP BY as_of
)
SELECT as_of, struct_pack(total_revenue := revenue, currency := 'INR') AS revenue,
       struct_pack(products := COALESCE(products, [])) AS top_products, event_counts,
       struct_pack(active_users := COALESCE(users, 0), "window" := 'last 5 minutes') AS active_users,
       COALESCE(recent_events, []) AS recent_events, COALESCE(revenue_history, []) AS revenue_history
FROM c LEFT JOIN u USING (as_of) LEFT JOIN p USING (as_of) LEFT JOIN f USING (as_of) LEFT JOIN y USING (as_of)""")


# murmur2 of the key's bytes, word by word; ids are ASCII digits
ARCHIVE_USER_HISTORY = with_shop(""",
newest AS (SELECT max(CAST(ts AS DATE)) AS d FROM shop_events),
busiest AS (
  SELECT user_id FROM shop_events, newest WHERE CAST(ts AS DATE) = d AND user_id IS NOT NULL
  GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10
)
SELECT event_id, event_type, user_id, ts FROM shop_events, newest
WHERE CAST(ts AS DATE) BETWEEN d - 6 AND d AND user_id IN (SELECT user_id FROM busiest)""")

KAFKA_PARTITIONS = with_shop("""
, b AS (
  SELECT event_id, user_id, list_transform(string_split(user_id, ''), lambda c: ascii(c)::HUGEINT) AS x, strlen(user_id) AS n FROM shop_events
), w AS (
  SELECT event_id, user_id, x, n, list_reduce(
    list_prepend(xor(2538058380::HUGEINT, n::HUGEINT), list_transform(range(n // 4),
      lambda i: ((x[i*4+1] + x[i*4+2] * 256 + x[i*4+3] * 65536 + x[i*4+4] * 16777216) * 1540483477) % 4294967296)),
    lambda h, k: xor((h * 1540483477) % 4294967296, (xor(k, k >> 24) * 1540483477) % 4294967296)) AS h
  FROM b
), t AS (
  SELECT event_id, user_id, CASE WHEN n % 4 = 0 THEN h ELSE
    (xor(h, x[n - n % 4 + 1] + CASE WHEN n % 4 > 1 THEN x[n - n % 4 + 2] * 256 ELSE 0 END
            + CASE WHEN n % 4 > 2 THEN x[n - n % 4 + 3] * 65536 ELSE 0 END) * 1540483477) % 4294967296 END AS h
  FROM w
), m AS (
  SELECT event_id, user_id, (xor(h, h >> 13) * 1540483477) % 4294967296 AS h FROM t
)
SELECT event_id, CASE WHEN user_id <> '' THEN ((xor(h, h >> 15) & 2147483647) % 12)::INTEGER END AS "partition" FROM m""")

WIRE_FIELD_PROFILE = f"""
WITH rows_ AS ({KAFKA_ROWS}), s AS (
  SELECT value, json_extract_string(value, '$.event_id')::BIGINT AS seq FROM rows_
), j AS (
  SELECT seq, left(value, length(value) - 1) || CASE WHEN seq % 100 = 7 THEN '' ELSE
           ',"session_id":"s' || (seq % 50) || '","context":{{"tags":["a",' || (seq % 3)
           || CASE WHEN seq % 4 = 0 THEN ',{{"deep":[true]}}' ELSE '' END || '],"ref":null}}}}' END AS value
  FROM s
), n AS (
  SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path,
         CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
                     WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
  FROM (SELECT value::JSON AS value FROM j WHERE seq % 100 <> 7) d, json_tree(d.value) t
  UNION ALL SELECT '$', 'malformed' FROM j WHERE seq % 100 = 7
)
SELECT path, kind, count(*) AS n FROM n GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {
        "event_counts": EVENT_COUNTS,
        "events_by_type": EVENTS_BY_TYPE,
        "event_counts_dedup": EVENT_COUNTS_DEDUP,
        "dedup_missing_ids": DEDUP_MISSING_IDS,
        "lenient_missing_fields": LENIENT_MISSING_FIELDS,
        "bad_amounts": BAD_AMOUNTS,
        "ingest_reasons": INGEST_REASONS,
        "ingest_defaults": INGEST_DEFAULTS,
        "dashboard_payload": DASHBOARD_PAYLOAD,
        "dashboard_timeline": DASHBOARD_TIMELINE,
        "revenue_total": REVENUE_TOTAL,
        "cart_abandonment": CART_ABANDONMENT,
        "failed_payment_rate": FAILED_PAYMENT_RATE,
        "event_breakdown": EVENT_BREAKDOWN,
        "purchase_amount": PURCHASE_AMOUNT,
        "product_counts": PRODUCT_COUNTS,
        "top_products": TOP_PRODUCTS,
        "top_products_percent": TOP_PRODUCTS_PERCENT,
        "revenue_per_minute": _revenue_window("minute"),
        "revenue_per_hour": _revenue_window("hour"),
        "revenue_by_week": _revenue_period("purchases", "week"),
        "revenue_by_month": _revenue_period("purchases", "month"),
        "revenue_by_year": _revenue_period("purchases", "year"),
        "active_users_sliding": ACTIVE_USERS_SLIDING,
        "active_user_sessions": ACTIVE_USER_SESSIONS,
        "active_users_now": ACTIVE_USERS_NOW,
        "kpi_trend": KPI_TREND,
        "revenue_running": REVENUE_RUNNING,
        "revenue_history": REVENUE_HISTORY,
        "recent_events": RECENT_EVENTS,
        "feed_age": FEED_AGE,
        "kpis": KPIS,
        "kpi_text": KPI_TEXT,
        "dashboard": DASHBOARD,
        "dashboard_json": DASHBOARD_JSON,
        "stream_dashboard": DASHBOARD,
        "stream_active_sessions": ACTIVE_USER_SESSIONS,
        "late_window_corrections": _revenue_window("minute"),
        "unpurchased_carts": UNPURCHASED_CARTS,
        "stream_dedup": DEDUP_MISSING_IDS,
        "kafka_rows": KAFKA_ROWS,
        "kafka_partitions": KAFKA_PARTITIONS,
        "archive_user_history": ARCHIVE_USER_HISTORY,
        "wire_field_profile": WIRE_FIELD_PROFILE,
        "parse_events": PARSE_EVENTS,
        "valid_events": VALID_EVENTS,
        "rejected_events": REJECTED_EVENTS,
        "lenient_events": LENIENT_EVENTS,
        "enriched_events": ENRICHED_EVENTS,
        "sales_revenue_total": SALES_REVENUE_TOTAL,
        "sales_top_products": SALES_TOP_PRODUCTS,
        "sales_revenue_by_week": _revenue_period("sales", "week"),
        "sales_revenue_by_month": _revenue_period("sales", "month"),
        "sales_revenue_by_year": _revenue_period("sales", "year"),
        "sales_trend": SALES_TREND,
    }
