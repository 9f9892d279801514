"""The answers of ``benchmark_queries`` in ANSI SQL over the benchmark tables."""

from __future__ import annotations

from lakeweave.benchmark_queries import OTHER_TABLES, STAR_TABLES

REGIONS = """
regions AS (
    SELECT c_custkey, c_name, c_mktsegment, r_name AS region
    FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey
)"""

CUSTOMERS = f"""{REGIONS},
customers AS (
    SELECT c_custkey AS customer_id, c_name AS name, region, c_mktsegment AS tier,
           (SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_custkey = c_custkey) AS signup_date
    FROM regions
)"""

LINES = """
lines AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
           CAST(l_quantity AS INTEGER) AS quantity,
           l_extendedprice / l_quantity AS unit_price,
           strftime(o_orderdate, '%Y-%m-%d') AS order_date,
           CASE WHEN l_returnflag = 'R' THEN 'CANCELLED'
                WHEN o_orderstatus = 'F' THEN 'DELIVERED'
                WHEN o_orderstatus = 'O' THEN 'SHIPPED'
                WHEN o_orderstatus = 'P' THEN 'PENDING' END AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

PRODUCTS = """
products AS (
    SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS sub_category,
           p_retailprice AS list_price, p_size % 2 = 1 AS is_active
    FROM part
)"""

EVENTS = f"""{REGIONS},
raw_events AS (
    SELECT event_id, user_id AS customer_id, event_type, props AS payload,
           strftime(ts, '%Y-%m-%d') AS event_date, region
    FROM events LEFT JOIN regions ON c_custkey = user_id
)"""

READINGS = f"""{REGIONS},
readings AS (
    SELECT event_id AS sensor_id, region AS location, event_type AS metric, value,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at
    FROM events LEFT JOIN regions ON c_custkey = user_id
)"""

RANKING = """CASE WHEN value IS NULL OR isnan(value) OR value > 50 THEN 'C'
     WHEN value > 20 THEN 'B' ELSE 'A' END AS ranking"""

CHOSEN = "region IN ('ASIA', 'EUROPE') AND event_date BETWEEN '2024-01-05' AND '2024-01-20'"

LTV = """
ltv AS (
    SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.region, c.c_mktsegment AS tier,
           count(l.order_id) AS total_orders,
           coalesce(round(sum(l.quantity * l.unit_price), 2), 0) AS lifetime_value,
           max(l.order_date) AS last_order_date
    FROM regions c
    LEFT JOIN lines l ON l.customer_id = c.c_custkey AND l.status IN ('SHIPPED', 'DELIVERED')
    GROUP BY ALL
)"""

REVENUE = """
revenue AS (
    SELECT name AS product_name, category, sub_category,
           count(order_id) AS order_count,
           CAST(sum(quantity) AS BIGINT) AS total_units,
           round(sum(quantity * unit_price), 2) AS total_revenue
    FROM lines JOIN products USING (product_id)
    WHERE status <> 'CANCELLED'
    GROUP BY name, category, sub_category
)"""

ALL_TABLES = STAR_TABLES + OTHER_TABLES


def _counts(names) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS tbl, count(*) AS rows FROM {name}" for name in names)


def _reconciled(name: str, source: str, first: str) -> str:
    return (
        f"SELECT '{name}' AS tbl, count(*) FILTER ({first}) AS rows_before,"
        f" count(*) - count(*) FILTER ({first}) AS rows_added, count(*) AS rows_after, true AS reconciled"
        f" FROM {source}"
    )


def _outside(domain: str, source: str, column: str, allowed: str) -> str:
    return (
        f"SELECT '{domain}' AS domain, {column} AS value, count(*) AS rows FROM {source}"
        f" WHERE {column} NOT IN ({allowed}) GROUP BY {column}"
    )


def _orphans(reference: str, source: str, key: str, parents: str) -> str:
    return (
        f"SELECT '{reference}' AS reference, {key} AS orphan_key, count(*) AS rows FROM {source}"
        f" WHERE {key} IS NOT NULL AND {key} NOT IN ({parents}) GROUP BY {key}"
    )


def _repeated(name: str, source: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS tbl, {key} AS key, count(*) AS rows FROM {source} GROUP BY {key} HAVING count(*) > 1"
    )


def _misdated(label: str, source: str, column: str) -> str:
    return (
        f"SELECT '{label}' AS column_name, {column} AS value, count(*) AS rows FROM {source}"
        rf" WHERE NOT regexp_full_match({column}, '\d{{4}}-\d{{2}}-\d{{2}}')"
        f" OR try_cast({column} AS DATE) IS NULL GROUP BY {column}"
    )


def _audited(rule: str, source: str, value: str, condition: str, having: str = "true") -> str:
    found = f"SELECT CAST({value} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {condition} GROUP BY 1 HAVING {having}"
    return (
        f"SELECT '{rule}' AS rule, count(*) AS bad_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows,"
        f" min(value) AS least_value, max(value) AS greatest_value FROM ({found})"
    )


BUYERS = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"
OFFERED = "SELECT p_partkey FROM part WHERE p_size % 2 = 1"

ORACLE_SQL = {
    "regional_summary": f"""WITH {CUSTOMERS}
SELECT region, tier, count(*) AS customer_count,
       min(signup_date) AS earliest_signup, max(signup_date) AS latest_signup
FROM customers GROUP BY region, tier""",
    "product_revenue": f"WITH {LINES}, {PRODUCTS}, {REVENUE} SELECT * FROM revenue",
    "customer_ltv": f"WITH {REGIONS}, {LINES}, {LTV} SELECT * FROM ltv",
    "event_funnel": f"""WITH {EVENTS}
SELECT region, event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_users
FROM raw_events GROUP BY region, event_type""",
    "customer_ltv_top5": f"""WITH {REGIONS}, {LINES}, {LTV}
SELECT customer_name, region, tier, total_orders, lifetime_value
FROM ltv ORDER BY lifetime_value DESC, customer_id LIMIT 5""",
    "sensor_ranking": f"SELECT event_id AS sensor_id, event_type AS metric, value, {RANKING} FROM events",
    "dedup_distinct": """SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS whole_value
FROM events""",
    "ingest_readings": f"WITH {READINGS} SELECT * FROM readings",
    "dedup_and_rank": f"WITH {READINGS} SELECT DISTINCT *, {RANKING} FROM readings",
    "rerun_append_growth": f"""WITH {READINGS}
SELECT 2 * (SELECT count(*) FROM readings) AS raw_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM readings)) AS distinct_rows""",
    "load_reconciliation": "\nUNION ALL\n".join(
        [
            _reconciled("customers", "customer", "WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')"),
            _reconciled("products", "part", "WHERE p_size % 2 = 1"),
            _reconciled(
                "orders",
                "lineitem JOIN orders ON l_orderkey = o_orderkey",
                "WHERE o_orderdate < TIMESTAMP '1998-01-01'",
            ),
            _reconciled("raw_events", "events", "WHERE ts < TIMESTAMP '2024-01-15'"),
        ]
    ),
    "labelled_counts": _counts(ALL_TABLES),
    "positional_append": f"WITH {PRODUCTS} SELECT * FROM products",
    "partitioned_roundtrip": f"""WITH {EVENTS}
SELECT event_date, region, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event
FROM raw_events GROUP BY event_date, region""",
    "pruned_read": f"WITH {EVENTS} SELECT * FROM raw_events WHERE {CHOSEN}",
    "replicate_partitions": f"""WITH {EVENTS}
SELECT event_date, region, event_type, count(*) AS events
FROM raw_events WHERE {CHOSEN} AND NOT (region = 'ASIA' AND event_date = '2024-01-05')
GROUP BY event_date, region, event_type""",
    "write_evidence": f"WITH {EVENTS} SELECT DISTINCT event_date, region FROM raw_events",
    "load_history": f"""WITH {READINGS}
SELECT 'sensor_readings' AS tbl, 'append' AS operation, count(*) AS rows_written FROM readings
UNION ALL
SELECT 'sensor_readings', 'append', count(*) FROM readings
UNION ALL
SELECT 'sensor_readings_ac', 'overwrite', count(*) FROM (SELECT DISTINCT * FROM readings)""",
    "directory_publish": f"WITH {REGIONS}, {LINES}, {LTV} SELECT * FROM ltv",
    "publish_verification": f"""WITH {CUSTOMERS}, {LINES}, {PRODUCTS}, {REVENUE},
sizes AS (
    SELECT 'regional_summary' AS tbl, count(*) AS n FROM (SELECT DISTINCT region, tier FROM customers)
    UNION ALL SELECT 'product_revenue', count(*) FROM revenue
    UNION ALL SELECT 'customer_ltv', count(*) FROM customer
    UNION ALL SELECT 'event_funnel', count(*) FROM (
        SELECT DISTINCT region, event_type FROM events LEFT JOIN regions ON c_custkey = user_id)
)
SELECT tbl, n AS rows_written, n AS rows_read, true AS verified FROM sizes""",
    "publish_self_read": f"""WITH {EVENTS}
SELECT region, event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_users
FROM raw_events WHERE event_type <> 'view' GROUP BY region, event_type""",
    "aggregates_from_tables": f"""WITH {CUSTOMERS}, {LINES}, {PRODUCTS}, {REVENUE}, {LTV},
summary AS (
    SELECT region, tier, count(*) AS n, max(signup_date) AS last_date FROM customers GROUP BY region, tier
), funnel AS (
    SELECT region, event_type, count(*) AS n, count(DISTINCT user_id) AS users
    FROM events LEFT JOIN regions ON c_custkey = user_id GROUP BY region, event_type
)
SELECT 'regional_summary' AS tbl, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total, CAST(0 AS DOUBLE) AS amount,
       max(last_date) AS last_date FROM summary
UNION ALL SELECT 'product_revenue', count(*), CAST(sum(order_count) AS BIGINT), round(sum(total_revenue), 0), NULL FROM revenue
UNION ALL SELECT 'customer_ltv', count(*), CAST(sum(total_orders) AS BIGINT), round(sum(lifetime_value), 0),
       max(last_order_date) FROM ltv
UNION ALL SELECT 'event_funnel', count(*), CAST(sum(n) AS BIGINT), CAST(sum(users) AS DOUBLE), NULL FROM funnel""",
    "inline_rows_joined": f"""WITH {REGIONS}, given(region, code) AS (VALUES ('ASIA', 'AS'), ('EUROPE', NULL), ('AFRICA', 'AF'))
SELECT region, code, customers FROM given
LEFT JOIN (SELECT region, count(*) AS customers FROM regions GROUP BY region) USING (region)""",
    "few_files": "SELECT CAST(2 AS BIGINT) AS files, count(*) AS rows FROM part",
    "table_comments": """SELECT column_name, comment, n_values FROM (
    VALUES ('product_id', 'product key'), ('name', 'product name'), ('category', 'main group'),
           ('sub_category', 'group within the category'), ('list_price', 'catalogue price'),
           ('is_active', 'still on sale')) AS c(column_name, comment)
JOIN (SELECT unnest(['product_id', 'name', 'category', 'sub_category', 'list_price', 'is_active']) AS column_name,
             unnest([count(p_partkey), count(p_name), count(p_type), count(p_brand), count(p_retailprice),
                     count(p_size)]) AS n_values FROM part) USING (column_name)""",
    "table_properties": """SELECT key, value, rows FROM (
    VALUES ('write.format.default', 'parquet'), ('write.parquet.compression-codec', 'snappy')) AS p(key, value),
    (SELECT count(*) AS rows FROM part)""",
    "overwrite_idempotent": f"WITH {PRODUCTS} SELECT * FROM products",
    "cross_catalog_copy": f"WITH {CUSTOMERS} SELECT * FROM customers",
    "ordered_write": f"""WITH {LINES}
SELECT CAST(8 AS BIGINT) AS files, count(*) AS rows, min(order_date) AS first_day, max(order_date) AS last_day,
       CAST(0 AS BIGINT) AS overlapping_files FROM lines""",
    "replicate_changes": f"""WITH {EVENTS}, grouped AS (
    SELECT event_date, region, count(*) AS n,
           coalesce(event_date = '2024-01-05' AND region = 'ASIA', false) AS changed,
           coalesce(event_date = '2024-01-20' AND region = 'EUROPE', false) AS gone
    FROM raw_events GROUP BY event_date, region
)
SELECT event_date, region, CASE WHEN gone THEN 0 ELSE n END AS events, CAST(changed AS BIGINT) AS changed_events,
       CASE WHEN changed THEN 'changed' WHEN gone THEN 'gone' END AS change,
       CASE WHEN changed THEN 1 WHEN gone THEN n ELSE 0 END AS row_changes
FROM grouped""",
    "chosen_partitions": f"""WITH {EVENTS}, days AS (
    SELECT event_date, region, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, event_date) AS place
    FROM raw_events GROUP BY event_date, region
)
SELECT event_id, event_type, e.event_date, e.region FROM raw_events e JOIN days d
ON e.event_date = d.event_date AND e.region IS NOT DISTINCT FROM d.region WHERE place = 1""",
    "published_partitions": f"""WITH {EVENTS}
SELECT event_date, event_type, count(*) AS events, region FROM raw_events
WHERE event_type <> 'view' GROUP BY event_date, event_type, region""",
    "refreshed_regions": f"""WITH {CUSTOMERS}
SELECT region, tier, count(*) AS customer_count,
       min(signup_date) AS earliest_signup, max(signup_date) AS latest_signup
FROM customers GROUP BY region, tier""",
    "refreshed_revenue": f"WITH {LINES}, {PRODUCTS}, {REVENUE} SELECT * FROM revenue",
    "refreshed_ltv": f"WITH {REGIONS}, {LINES}, {LTV} SELECT * FROM ltv",
    "refreshed_funnel": f"""WITH {EVENTS}
SELECT region, event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_users
FROM raw_events GROUP BY region, event_type""",
    "exact_revenue": f"""WITH {LINES}
SELECT status, CAST(round(sum(CAST(quantity * unit_price AS DECIMAL(38, 12))), 2) AS DOUBLE) AS revenue,
       CAST(1 AS BIGINT) AS different_totals, CAST(3 AS BIGINT) AS routes
FROM lines GROUP BY status""",
    "incremental_distinct": f"WITH {READINGS} SELECT DISTINCT *, {RANKING} FROM readings",
    "bucketed_ltv": f"WITH {REGIONS}, {LINES}, {LTV} SELECT * FROM ltv",
    "resumed_copy": f"WITH {PRODUCTS} SELECT *, 4 AS copied, 2 AS skipped FROM products",
    "load_quarantine": f"""WITH {LINES}, judged AS (
    SELECT *, product_id % 10 = 0 AS many, product_id % 15 = 0 AS free, coalesce(status = 'CANCELLED', false) AS cancelled FROM lines
)
SELECT 'quantity' AS column_name, 'no int' AS reason, count(*) AS rows FROM judged WHERE many
UNION ALL SELECT 'unit_price', 'no double', count(*) FROM judged WHERE free
UNION ALL SELECT NULL, 'not cancelled', count(*) FROM judged WHERE cancelled
UNION ALL SELECT NULL, 'offered', count(*) FROM judged
UNION ALL SELECT NULL, 'rejected', count(*) FROM judged WHERE many OR free OR cancelled
UNION ALL SELECT NULL, w, count(*) FROM judged, (VALUES ('accepted'), ('stored')) v(w) WHERE NOT (many OR free OR cancelled) GROUP BY w""",
    "audit_in_one_pass": f"WITH {REGIONS}, {LINES}\n" + "\nUNION ALL\n".join(
        [
            _audited("customers.region in its domain", "regions", "region", "region NOT IN ('AMERICA', 'EUROPE', 'ASIA')"),
            _audited("orders.status in its domain", "lines", "status", "status NOT IN ('PENDING', 'SHIPPED', 'DELIVERED')"),
            _audited("raw_events.event_type in its domain", "events", "event_type", "event_type NOT IN ('view', 'purchase')"),
            _audited("orders.order_date is a date", "lines", "order_date", "try_cast(order_date AS DATE) IS NULL AND order_date IS NOT NULL"),
            _audited("customers(customer_id) is unique", "customer", "c_custkey", "c_custkey IS NOT NULL", "count(*) > 1"),
            _audited("orders(order_id) is unique", "lines", "order_id", "order_id IS NOT NULL", "count(*) > 1"),
            _audited("orders.customer_id refers to building customers", "lines", "customer_id", f"customer_id NOT IN ({BUYERS})"),
            _audited("orders.product_id refers to products", "lines", "product_id", "product_id NOT IN (SELECT p_partkey FROM part)"),
            _audited("raw_events.customer_id refers to customers", "events", "user_id", "user_id NOT IN (SELECT c_custkey FROM customer)"),
            _audited("raw_events.payload has its attributes", "events", "event_type",
                     "(event_type = 'view' AND json_extract_string(props, '$.k') IS NULL)"
                     " OR (event_type = 'purchase' AND json_extract_string(props, '$.page') IS NULL)"),
        ]
    ),
    "compacted_table": f"WITH {LINES} SELECT status, count(*) AS rows, true AS fewer_files, true AS even_files FROM lines GROUP BY status",
    "filter_ne_in": f"""WITH {LINES}
SELECT 'not cancelled' AS selection, status, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units
FROM lines WHERE status != 'CANCELLED' GROUP BY status
UNION ALL
SELECT 'fulfilled', status, count(*), CAST(sum(quantity) AS BIGINT)
FROM lines WHERE status IN ('DELIVERED', 'SHIPPED') GROUP BY status""",
    "labelled_projection": f"""WITH {LINES}
SELECT 'orders' AS tbl, product_id, order_id, CAST(quantity AS BIGINT) AS units,
       round(quantity * unit_price, 2) AS amount, coalesce(status, 'UNKNOWN') AS status
FROM lines""",
    "sort_multi_key": f"""WITH {REGIONS}
SELECT c_custkey AS customer_id, c_name AS name, region, c_mktsegment AS tier
FROM regions ORDER BY region, tier, customer_id DESC""",
    "federated_inventory": f"""WITH sizes AS ({_counts(ALL_TABLES)})
SELECT DISTINCT
       CASE WHEN tbl IN ({", ".join(repr(name) for name in STAR_TABLES)})
            THEN 'operational' ELSE 'analytical' END AS catalog_name,
       tbl AS table_name, CAST(ordinal_position AS INTEGER) AS position, column_name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
            WHEN 'FLOAT[]' THEN 'array<float>' END AS data_type,
       rows AS row_count
FROM information_schema.columns JOIN sizes ON table_name = tbl""",
    "file_report": f"""SELECT tbl, 'PARQUET' AS file_format, rows AS record_count
FROM ({_counts(ALL_TABLES)})""",
    "reset_owned": """SELECT 'operational' AS catalog_name, 'products' AS tbl, 'dropped' AS first_outcome,
       'absent' AS second_outcome, count(*) AS rows_in_files, CAST(0 AS BIGINT) AS rows_made_anew FROM part
UNION ALL SELECT 'operational', 'raw_events', 'dropped', 'absent', count(*), 0 FROM events
UNION ALL SELECT 'analytical', 'customer', 'not owned', 'not owned', count(*), NULL FROM customer""",
    "orphan_keys": f"""WITH {LINES}
SELECT 'orders.customer_id' AS reference, count(*) AS child_rows,
       count(DISTINCT customer_id) FILTER (WHERE customer_id NOT IN (SELECT c_custkey FROM customer)) AS orphan_keys,
       count(*) FILTER (WHERE customer_id NOT IN (SELECT c_custkey FROM customer)) AS orphan_rows FROM lines
UNION ALL
SELECT 'orders.product_id', count(*),
       count(DISTINCT product_id) FILTER (WHERE product_id NOT IN (SELECT p_partkey FROM part)),
       count(*) FILTER (WHERE product_id NOT IN (SELECT p_partkey FROM part)) FROM lines
UNION ALL
SELECT 'raw_events.customer_id', count(*),
       count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer)),
       count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer)) FROM events""",
    "orphan_keys_of_filtered_parents": f"WITH {LINES}\n"
    + "\nUNION ALL\n".join(
        [
            _orphans("orders.customer_id", "lines", "customer_id", BUYERS),
            _orphans("orders.product_id", "lines", "product_id", OFFERED),
            _orphans("raw_events.customer_id", "events", "user_id", BUYERS),
        ]
    ),
    "domain_violations": f"WITH {REGIONS}, {LINES}\n"
    + "\nUNION ALL\n".join(
        [
            _outside("customers.region", "regions", "region", "'AMERICA', 'EUROPE', 'ASIA'"),
            _outside("customers.tier", "customer", "c_mktsegment", "'BUILDING', 'MACHINERY'"),
            _outside("orders.status", "lines", "status", "'PENDING', 'SHIPPED', 'DELIVERED'"),
            _outside("raw_events.event_type", "events", "event_type", "'view', 'purchase'"),
        ]
    ),
    "duplicate_keys": f"WITH {LINES}\n"
    + "\nUNION ALL\n".join(
        [
            _repeated("customers", "customer", "c_custkey"),
            _repeated("products", "part", "p_partkey"),
            _repeated("orders", "lines", "order_id"),
            _repeated("raw_events", "events", "event_id"),
        ]
    ),
    "bad_dates": f"WITH {LINES}\n"
    + "\nUNION ALL\n".join(
        [
            _misdated("order_date", "lines", "order_date"),
            _misdated("o_orderpriority", "orders", "o_orderpriority"),
            _misdated("o_orderdate", "(SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders)", "o_orderdate"),
        ]
    ),
    "payload_fields": """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events""",
    "payload_gaps": """SELECT event_type, count(*) AS events,
       count(*) FILTER (WHERE (event_type = 'view' AND json_extract_string(props, '$.k') IS NULL)
                           OR (event_type = 'purchase' AND json_extract_string(props, '$.page') IS NULL)) AS gaps
FROM events GROUP BY event_type""",
}
