"""DuckDB oracle SQL for every registered query.

The driver registers its parquet tables as views (``orders``, ``lineitem``,
``customer`` …).  Business tables are rebuilt from them with the same adapter
definitions as :mod:`farmspark.sources.tables`, as CTEs with names that do not
collide with the driver views.  Conventions: counts and integer sums cast to
BIGINT, money sums go through DECIMAL and end as DOUBLE, averages
``round(…, 2)``, single-quoted strings only, no clock functions.
"""

from __future__ import annotations

# Business-table adapters (keep in step with farmspark/sources/tables.py).
ADAPTERS = {
    "co": """
        SELECT o.o_orderkey AS order_id,
               o.o_custkey AS customer_id,
               o.o_orderpriority AS prawn_type,
               q.quantity,
               CAST(o.o_totalprice AS DECIMAL(12,2)) AS price,
               CASE WHEN o.o_orderstatus = 'O' THEN 'New'
                    WHEN o.o_orderstatus = 'P' THEN 'Processing'
                    WHEN o.o_orderkey % 2 = 0 THEN 'Delivered'
                    ELSE 'Completed' END AS status,
               CASE WHEN o.o_orderkey % 3 = 0 THEN 'Approved'
                    WHEN o.o_orderkey % 3 = 1 THEN 'Rejected' END AS approved_or_rejected,
               CASE WHEN o.o_orderkey % 4 = 0 THEN NULL
                    WHEN o.o_orderkey % 4 = 1 THEN ''
                    ELSE 'uploads/receipt_' || CAST(o.o_orderkey AS VARCHAR) || '.jpg' END AS payment_receipt,
               'Pond Road ' || CAST(o.o_custkey % 97 AS VARCHAR) AS address,
               CAST(NULL AS VARCHAR) AS assigned_by,
               CASE WHEN o.o_orderkey % 211 = 7 THEN NULL
                    ELSE o.o_orderdate + (o.o_orderkey % 1440) * INTERVAL 1 MINUTE END AS created_at,
               CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
                    ELSE o.o_orderdate + (o.o_orderkey % 1440) * INTERVAL 1 MINUTE + INTERVAL 1 DAY END AS updated_at
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, CAST(SUM(l_quantity) AS INTEGER) AS quantity
                   FROM lineitem GROUP BY l_orderkey) q ON o.o_orderkey = q.l_orderkey""",
    "cu": """
        SELECT c_custkey AS customer_id,
               c_name AS customer_name,
               lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS mobile_no,
               CASE WHEN c_custkey % 10 = 0 THEN NULL
                    WHEN c_custkey % 10 = 1 THEN ''
                    ELSE lower(c_name) || '@example.com' END AS email
        FROM customer""",
    "su": """
        SELECT s_suppkey AS supplier_id, s_name AS name,
               lower(s_name) || '@example.com' AS email,
               lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS mobile_no
        FROM supplier""",
    "wk": """
        SELECT s_suppkey AS id, replace(s_name, 'Supplier', 'Worker') AS name,
               lower(replace(s_name, 'Supplier', 'Worker')) || '@farm.example' AS email,
               '07' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS mobile_no
        FROM supplier""",
    "us": """
        SELECT 'S' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS serviceId,
               lower(c_name) || '@example.com' AS email,
               lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone
        FROM customer""",
    "inv": """
        SELECT p_partkey AS item_id, p_name AS name,
               CASE WHEN p_type = 'ECONOMY' THEN 'prawns' ELSE lower(p_type) END AS type,
               p_size AS quantity,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 20 AS INTEGER) END AS threshold,
               CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS INTEGER) AS DATE) AS date
        FROM part""",
    "so": """
        SELECT l_orderkey * 10 + l_linenumber AS supply_order_id,
               l_suppkey AS supplier_id,
               CASE WHEN l_linenumber = 7 THEN CAST(-1 AS BIGINT) ELSE l_partkey END AS item_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CASE WHEN l_returnflag = 'N' THEN 'New'
                    WHEN l_returnflag = 'A' THEN 'Accepted' ELSE 'Delivered' END AS status,
               l_shipdate + (l_orderkey % 1440) * INTERVAL 1 MINUTE AS order_date
        FROM lineitem""",
    "sd": """
        SELECT CASE WHEN user_id % 50 = 49 THEN NULL ELSE CAST(user_id AS INTEGER) END AS Pond_ID,
               value AS Water_Level,
               CASE WHEN event_type = 'error' THEN NULL ELSE 6 + (event_id % 30) / 10 END AS pH,
               CAST(20 + event_id % 15 AS DOUBLE) AS WaterTemp,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS TDS,
               CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN NULL
                    ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP)
                         + (extract('hour' FROM ts) - extract('hour' FROM ts) % 6) * INTERVAL 1 HOUR END AS Updated_at
        FROM events""",
    "tk": """
        SELECT event_id AS task_id, event_type AS title, props AS description,
               event_id % (SELECT max(s_suppkey) + 1 FROM supplier) AS worker_id,
               CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'pending' END AS status,
               ts AS created_date
        FROM events""",
    "fd": """
        SELECT s_suppkey AS feeding_ID,
               s_nationkey + 1 AS Pond_ID,
               CAST((s_suppkey * 3540) % 86400 AS INTEGER) AS feeding_sec
        FROM supplier""",
}

# Order matters only for readability; DuckDB drops unused CTEs.
_CTE_ORDER = ["co", "cu", "su", "wk", "us", "inv", "so", "sd", "tk", "fd"]


def with_adapters(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the adapter CTEs (and ``extra`` CTEs after them)."""
    parts = [f"{n} AS ({ADAPTERS[n]})" for n in _CTE_ORDER]
    for n, q in (extra or {}).items():
        parts.append(f"{n} AS ({q})")
    return "WITH " + ",\n".join(parts) + "\n" + body
