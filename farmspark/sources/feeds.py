"""Request feeds derived from the driver tables.

The reference answers one HTTP request at a time (``WHERE id = ?``, one
``UPDATE`` per call).  Here a batch of requests is a DataFrame: lookup keys
for the point reads and change logs (one row per request, ``seq`` = arrival
order) for the write rules.  For the test driver they are derived from the
``events`` / ``lineitem`` tables and name keys of the whole range of their
target table (an event id times a fixed factor, modulo the number of keys), so
they grow with the data; in production
they come from the request log.  The DuckDB text of each feed is in
:data:`FEED_SQL` and must stay in step with the Spark definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.sources.tables import Tables, top

#: spreads consecutive event ids over a key range
SPREAD = 48271
WORKERS_SQL = "(SELECT max(s_suppkey) + 1 FROM supplier)"


def workers(t: Tables):
    return top(t.worker, "id")


def _ev(t: Tables) -> DataFrame:
    return t.raw("events")


def order_keys(t: Tables) -> DataFrame:
    """Requested order ids; ids past the last order are not found."""
    return _ev(t).select((F.col("event_id") * 2).alias("order_id"))


def customer_keys(t: Tables) -> DataFrame:
    return _ev(t).select((F.col("user_id") * 11).alias("customer_id"))


def supplier_keys(t: Tables) -> DataFrame:
    return _ev(t).select(F.col("user_id").alias("supplier_id"))


def worker_emails(t: Tables) -> DataFrame:
    return _ev(t).select(F.concat(F.lit("worker#"), F.lpad((F.col("event_id") % workers(t)).cast("string"), 9, "0"),
                                  F.lit("@farm.example")).alias("email"))


def customer_emails(t: Tables) -> DataFrame:
    return _ev(t).select(F.concat(F.lit("customer#"), F.lpad((F.col("user_id") * 11).cast("string"), 9, "0"),
                                  F.lit("@example.com")).alias("email"))


def worker_mobiles(t: Tables) -> DataFrame:
    return _ev(t).select(F.concat(F.lit("07"), F.lpad((F.col("event_id") % workers(t)).cast("string"), 8, "0"))
                         .alias("mobile_no"))


def login_handles(t: Tables) -> DataFrame:
    """Handles typed at login: a name, an e-mail (padded), or unknown text."""
    e = _ev(t)
    k = F.col("event_id") % 5
    uid = F.col("user_id")
    return e.select(
        F.when(k == 0, F.concat(F.lit("Customer#"), F.lpad((uid * 11).cast("string"), 9, "0")))
         .when(k == 1, F.concat(F.lit("  customer#"), F.lpad((uid * 11).cast("string"), 9, "0"),
                                F.lit("@example.com ")))
         .when(k == 2, F.concat(F.lit("Worker#"), F.lpad((F.col("event_id") % workers(t)).cast("string"), 9, "0")))
         .when(k == 3, F.concat(F.lit("supplier#"), F.lpad(uid.cast("string"), 9, "0"), F.lit("@example.com")))
         .otherwise(F.concat(F.lit("nobody "), uid.cast("string"))).alias("handle"))


FEED_SQL = {
    "order_keys": "SELECT event_id * 2 AS order_id FROM events",
    "customer_keys": "SELECT user_id * 11 AS customer_id FROM events",
    "supplier_keys": "SELECT user_id AS supplier_id FROM events",
    "worker_emails": (f"SELECT 'worker#' || lpad(CAST(event_id % {WORKERS_SQL} AS VARCHAR), 9, '0') || '@farm.example' "
                      "AS email FROM events"),
    "customer_emails": ("SELECT 'customer#' || lpad(CAST(user_id * 11 AS VARCHAR), 9, '0') || '@example.com' "
                        "AS email FROM events"),
    "worker_mobiles": f"SELECT '07' || lpad(CAST(event_id % {WORKERS_SQL} AS VARCHAR), 8, '0') AS mobile_no FROM events",
    "login_handles": f"""
        SELECT CASE event_id % 5
                 WHEN 0 THEN 'Customer#' || lpad(CAST(user_id * 11 AS VARCHAR), 9, '0')
                 WHEN 1 THEN '  customer#' || lpad(CAST(user_id * 11 AS VARCHAR), 9, '0') || '@example.com '
                 WHEN 2 THEN 'Worker#' || lpad(CAST(event_id % {WORKERS_SQL} AS VARCHAR), 9, '0')
                 WHEN 3 THEN 'supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com'
                 ELSE 'nobody ' || CAST(user_id AS VARCHAR) END AS handle
        FROM events""",
}


# --- stream inputs derived from events (sensor documents, ticks, acks) -----

def sensor_docs(t: Tables) -> DataFrame:
    """Device documents as JSON text: complete, missing ``tds`` (view
    events), malformed (error events, never closed), or bare values."""
    e = _ev(t)
    lvl = F.concat(F.lit('{"waterLevelInside": '), F.col("value").cast("string"))
    temp = F.concat(F.lit(', "waterTemp": '), (20 + F.col("event_id") % 15).cast("string"))
    tds = F.concat(F.lit(', "tds": '), F.get_json_object("props", "$.k"))
    doc = (F.when(F.col("event_id") % 41 == 0, "null").when(F.col("event_id") % 43 == 0, "5")
           .when(F.col("event_type") == "error", lvl)
           .when(F.col("event_type") == "view", F.concat(lvl, temp, F.lit("}")))
           .otherwise(F.concat(lvl, temp, tds, F.lit("}"))))
    return e.select(doc.alias("doc"), F.col("ts").alias("arrived_at"))


def feeding_acks(t: Tables) -> DataFrame:
    """Acknowledgements of feeding_ID = user_id, some without one."""
    named = F.when(F.col("event_id") % 53 != 0, F.col("user_id"))
    return _ev(t).select(named.alias("feeding_ID"), F.col("ts").alias("ack_ts"))


FEED_SQL.update({
    "sensor_docs": """
        SELECT CASE WHEN event_id % 41 = 0 THEN 'null' WHEN event_id % 43 = 0 THEN '5'
                    WHEN event_type = 'error'
                      THEN '{"waterLevelInside": ' || CAST(value AS VARCHAR)
                    WHEN event_type = 'view'
                      THEN '{"waterLevelInside": ' || CAST(value AS VARCHAR) || ', "waterTemp": '
                           || CAST(20 + event_id % 15 AS VARCHAR) || '}'
                    ELSE '{"waterLevelInside": ' || CAST(value AS VARCHAR) || ', "waterTemp": '
                         || CAST(20 + event_id % 15 AS VARCHAR) || ', "tds": '
                         || json_extract_string(props, '$.k') || '}' END AS doc,
               ts AS arrived_at
        FROM events""",
    "feeding_acks": "SELECT CASE WHEN event_id % 53 <> 0 THEN user_id END AS feeding_ID, ts AS ack_ts FROM events",
    "ticks": "SELECT DISTINCT date_trunc('minute', ts) AS tick_ts FROM events",
})
