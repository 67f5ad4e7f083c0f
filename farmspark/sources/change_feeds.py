"""Change logs (one row per request, ``seq`` = arrival order) derived from the
driver's ``events`` table for the C-* rules, plus their DuckDB text.

Each feed mixes valid requests with the edge cases of its rule (blank and
falsy fields, malformed and oversized numbers, bad dates, unknown keys, several
changes to one key).  Keys come from the whole range of the target table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.sources.feeds import SPREAD, WORKERS_SQL, workers
from farmspark.sources.tables import Tables, top

# keys of the target tables: a tenth of the requests name unknown ones
ORDERS_SQL = "(SELECT max(o_orderkey) + 1 FROM orders)"
ITEMS_SQL = "(SELECT max(p_partkey) + 1 FROM part)"


def _range(n, e=None):
    return ((F.col("event_id") if e is None else e) * SPREAD) % F.floor(n * 1.1).cast("long")


def _range_sql(n: str, e: str = "event_id") -> str:
    return f"((({e}) * {SPREAD}) % CAST(floor({n} * 1.1) AS BIGINT))"


def _orders(t):
    return _range(top(t.raw("orders"), "o_orderkey"))


def _items(t):
    return _range(top(t.raw("part"), "p_partkey"))


def _cols():
    """event_id, user_id, value, ts, event_type and a NULL string (built per
    call: a Column needs an active session)."""
    return (F.col("event_id"), F.col("user_id"), F.col("value"), F.col("ts"), F.col("event_type"),
            F.lit(None).cast("string"))


def _ev(t: Tables, *types: str) -> DataFrame:
    e = t.raw("events")
    return e.where(F.col("event_type").isin(*types)) if types else e


def _s(c) -> F.Column:
    return c.cast("string")


def orders_form(t: Tables) -> DataFrame:
    """C-1 web order form."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"),
        F.when(E % 11 == 0, F.lit(None).cast("long")).otherwise(U * 11).alias("customer_id"),
        F.when(E % 4 == 0, "Tiger").when(E % 4 == 1, "White").when(E % 4 == 2, "King")
         .otherwise("").alias("prawn_type"),
        F.when(E % 31 == 0, F.lit(3_000_000_000)).otherwise(F.floor(V).cast("long")).alias("quantity"),
        F.when(E % 37 == 0, F.lit(99_999_999_999).cast("decimal(14,2)"))
         .otherwise((V * 10).cast("decimal(14,2)")).alias("price"),
        F.when(E % 5 == 0, NULL_S).when(E % 5 == 1, "").when(E % 5 == 2, "New")
         .when(E % 5 == 3, "Completed").otherwise("Delivered").alias("status"),
        TS.alias("created_at"))


def app_orders(t: Tables) -> DataFrame:
    """C-2 customer-app orders with receipt file name."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), (U * 11).alias("customer_id"),
        F.when(E % 9 == 0, NULL_S).otherwise("Tiger").alias("prawn_type"),
        F.when(E % 31 == 0, F.lit(3_000_000_000)).otherwise(F.floor(V).cast("long")).alias("quantity"),
        F.when(E % 37 == 0, F.lit(99_999_999_999).cast("decimal(14,2)"))
         .otherwise((V * 10).cast("decimal(14,2)")).alias("price"),
        F.when(E % 13 == 0, "").otherwise(F.concat(F.lit("Pond Road "), _s(U % 97))).alias("location"),
        F.when(E % 7 == 0, NULL_S).otherwise(F.concat(F.lit("r"), _s(E), F.lit(".jpg"))).alias("receipt"),
        TS.alias("created_at"))


def purchase_form(t: Tables) -> DataFrame:
    """C-3 purchase orders to suppliers."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"),
        F.when(E % 19 == 0, F.lit(None).cast("long")).otherwise(U).alias("supplier_id"),
        F.when(E % 17 == 0, F.lit(None).cast("long")).otherwise(_items(t)).alias("item_id"),
        F.when(E % 31 == 0, F.lit(3_000_000_000)).otherwise(F.floor(V).cast("long")).alias("quantity"),
        F.when(E % 37 == 0, F.lit(99_999_999_999).cast("decimal(14,2)"))
         .otherwise(V.cast("decimal(14,2)")).alias("price"),
        TS.alias("order_date"))


def item_form(t: Tables) -> DataFrame:
    """C-4 new stock items with free-text quantity."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"),
        F.when(E % 23 == 0, NULL_S).otherwise(F.concat(F.lit("item "), _s(E % 50))).alias("name"),
        F.when(E % 3 == 0, "prawns").when(E % 3 == 1, "feed").otherwise("").alias("type"),
        F.when(E % 8 == 0, NULL_S).when(E % 8 == 1, "").when(E % 8 == 2, "12abc").when(E % 8 == 3, "-3")
         .when(E % 8 == 4, "3.7").when(E % 8 == 5, "0").when(E % 16 == 6, "3000000000")
         .when(E % 16 == 7, "99999999999999999999").otherwise(_s(U)).alias("qty"))


def task_form(t: Tables) -> DataFrame:
    """C-5 task assignments."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), F.concat(F.lit("Feed pond "), _s(U)).alias("title"),
        F.col("props").alias("description"), (E % workers(t)).alias("worker_id"), TS.alias("created_date"))


def stock_moves(t: Tables, kinds: tuple[str, ...] = ("issue", "receive")) -> DataFrame:
    """C-6 / C-7: purchases issue stock, sign-ups receive it (text fields)."""
    E, U, V, TS, TY, NULL_S = _cols()
    f = _ev(t, "purchase", "signup").select(
        E.alias("seq"),
        F.when(TY == "purchase", "issue").otherwise("receive").alias("kind"),
        F.when(E % 101 == 0, "x")
         .when(E % 103 == 0, F.concat(F.lit(" "), _s(_items(t)), F.lit("abc")))
         .otherwise(_s(_items(t))).alias("item_id"),
        F.when(E % 97 == 0, "").when(E % 89 == 0, "abc").when(E % 83 == 0, "-1").when(E % 79 == 0, "3.7")
         .when(E % 73 == 0, NULL_S).when(E % 67 == 0, "3000000000").when(E % 61 == 0, "99999999999999999999")
         .otherwise(_s(1 + E % 5)).alias("qty"),
        F.when(E % 71 == 0, NULL_S).when(E % 59 == 0, "notadate").otherwise(F.date_format(F.to_date(TS), "yyyy-MM-dd")).alias("date"))
    return f.where(F.col("kind").isin(*kinds))


def approvals(t: Tables) -> DataFrame:
    """C-8 approve / reject actions; several per order."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), _orders(t).alias("order_id"),
        F.when(TY == "click", "approved").when(TY == "view", "rejected").when(TY == "error", "Approved")
         .when(TY == "signup", "").otherwise("approved").alias("action"))


def status_changes(t: Tables) -> DataFrame:
    """C-9 order status changes; several per order."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), _orders(t).alias("order_id"),
        F.when(TY == "click", "Processing").when(TY == "view", "Delivered").when(TY == "purchase", "Completed")
         .when(TY == "signup", "Shipped").otherwise("").alias("status"))


def assignments(t: Tables) -> DataFrame:
    """C-10 assigned-by changes."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), _orders(t).alias("order_id"),
        F.when(E % 6 == 0, "").otherwise(F.concat(F.lit("Worker "), _s(U % 25))).alias("assigned_by"))


def _supply_key(t):
    return _orders(t) * 10 + (1 + F.col("event_id") % 7)


def supply_status(t: Tables) -> DataFrame:
    """C-11 supplier-app status changes by supply order id."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), _supply_key(t).alias("supply_order_id"),
        F.when(E % 9 == 0, NULL_S).when(TY == "click", "Accepted").when(TY == "view", "Shipped")
         .otherwise("Delivered").alias("status"))


def supply_status_owned(t: Tables) -> DataFrame:
    """C-12 status changes naming a supplier: the owner, another supplier,
    or (for unknown orders) any supplier."""
    E, U, V, TS, TY, NULL_S = _cols()
    owners = (t.supply_orders.groupBy("supply_order_id").agg(F.min("supplier_id").alias("_owner")))
    e = _ev(t).withColumn("supply_order_id", _supply_key(t))
    j = e.join(owners, "supply_order_id", "left")
    return j.select(
        E.alias("seq"), "supply_order_id",
        F.when(F.col("_owner").isNull(), U).when(E % 3 == 0, F.col("_owner") + 1)
         .otherwise(F.col("_owner")).alias("supplier_id"),
        F.when(E % 11 == 0, "").otherwise("Shipped").alias("status"))


def worker_updates(t: Tables) -> DataFrame:
    """C-13 worker profile edits."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"), _range(workers(t)).alias("id"),
        F.when(E % 7 == 0, "").otherwise(F.concat(F.lit("Worker "), _s(U))).alias("name"),
        F.concat(F.lit("w"), _s(U), F.lit("@farm.example")).alias("email"),
        F.concat(F.lit("07"), F.lpad(_s(U), 8, "0")).alias("mobile_no"))


def worker_deletes(t: Tables) -> DataFrame:
    """C-14 worker deletions, one per event (repeats and unknown ids).  There are
    many more requests than workers: they name every third id, so that some
    workers stay."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(E.alias("seq"), (_range(workers(t)) * 3 + 1).alias("id"))


def first_worker_deletes(t: Tables) -> DataFrame:
    """C-14 the deletions of one small batch (repeats and unknown ids), fewer
    than there are workers, as ``chained_batches`` chains them."""
    E, U, V, TS, TY, NULL_S = _cols()
    who = F.when(E % 5 == 0, E - 1).otherwise(E)
    return _ev(t).where(E <= F.floor(workers(t) * 0.7)).select(E.alias("seq"), _range(workers(t), who).alias("id"))


def task_completions(t: Tables) -> DataFrame:
    """C-15 task completions by worker e-mail."""
    E, U, V, TS, TY, NULL_S = _cols()
    widx = F.when(E % 10 == 0, 1_000_000 + U).when(E % 3 == 0, (E + 1) % workers(t)).otherwise(E % workers(t))
    return _ev(t).select(
        E.alias("seq"), F.when(E % 50 == 0, F.lit(None).cast("long")).otherwise(E).alias("task_id"),
        F.concat(F.lit("worker#"), F.lpad(_s(widx), 9, "0"), F.lit("@farm.example")).alias("email"))


def signups(t: Tables) -> DataFrame:
    """C-16 sign-ups of all four account kinds (padded text, repeats)."""
    E, U, V, TS, TY, NULL_S = _cols()
    return _ev(t).select(
        E.alias("seq"),
        F.when(E % 4 == 0, "customer").when(E % 4 == 1, "supplier").when(E % 4 == 2, "worker")
         .otherwise("user").alias("kind"),
        F.when(E % 9 == 0, "  ").otherwise(F.concat(F.lit("  New "), _s(U), F.lit(" "))).alias("name"),
        F.when(E % 5 == 0, NULL_S)
         .when(E % 5 == 1, F.concat(F.lit(" customer#"), F.lpad(_s(U * 11), 9, "0"), F.lit("@example.com")))
         .when(E % 5 == 2, F.concat(F.lit("worker#"), F.lpad(_s(E % workers(t)), 9, "0"), F.lit("@farm.example")))
         .when(E % 5 == 3, F.concat(F.lit("supplier#"), F.lpad(_s(U), 9, "0"), F.lit("@example.com")))
         .otherwise(F.concat(F.lit("new"), _s(U), F.lit("@example.com "))).alias("email"),
        F.when(E % 6 == 0, F.concat(F.lit("07"), F.lpad(_s(E % workers(t)), 8, "0")))
         .otherwise(F.concat(F.lit("09"), F.lpad(_s(U), 8, "0"))).alias("mobile_no"))


CHANGE_SQL = {
    "orders_form": f"""
        SELECT event_id AS seq,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id * 11 END AS customer_id,
               CASE event_id % 4 WHEN 0 THEN 'Tiger' WHEN 1 THEN 'White' WHEN 2 THEN 'King' ELSE '' END AS prawn_type,
               CASE WHEN event_id % 31 = 0 THEN 3000000000 ELSE CAST(floor(value) AS BIGINT) END AS quantity,
               CASE WHEN event_id % 37 = 0 THEN CAST(99999999999 AS DECIMAL(14,2))
                    ELSE CAST(value * 10 AS DECIMAL(14,2)) END AS price,
               CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'New' WHEN 3 THEN 'Completed'
                    ELSE 'Delivered' END AS status,
               ts AS created_at
        FROM events""",
    "app_orders": f"""
        SELECT event_id AS seq, user_id * 11 AS customer_id,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'Tiger' END AS prawn_type,
               CASE WHEN event_id % 31 = 0 THEN 3000000000 ELSE CAST(floor(value) AS BIGINT) END AS quantity,
               CASE WHEN event_id % 37 = 0 THEN CAST(99999999999 AS DECIMAL(14,2))
                    ELSE CAST(value * 10 AS DECIMAL(14,2)) END AS price,
               CASE WHEN event_id % 13 = 0 THEN '' ELSE 'Pond Road ' || CAST(user_id % 97 AS VARCHAR) END AS location,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'r' || CAST(event_id AS VARCHAR) || '.jpg' END AS receipt,
               ts AS created_at
        FROM events""",
    "purchase_form": f"""
        SELECT event_id AS seq,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE user_id END AS supplier_id,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE {_range_sql(ITEMS_SQL)} END AS item_id,
               CASE WHEN event_id % 31 = 0 THEN 3000000000 ELSE CAST(floor(value) AS BIGINT) END AS quantity,
               CASE WHEN event_id % 37 = 0 THEN CAST(99999999999 AS DECIMAL(14,2))
                    ELSE CAST(value AS DECIMAL(14,2)) END AS price,
               ts AS order_date
        FROM events""",
    "item_form": f"""
        SELECT event_id AS seq,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'item ' || CAST(event_id % 50 AS VARCHAR) END AS name,
               CASE event_id % 3 WHEN 0 THEN 'prawns' WHEN 1 THEN 'feed' ELSE '' END AS type,
               CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '12abc' WHEN 3 THEN '-3'
                    WHEN 4 THEN '3.7' WHEN 5 THEN '0'
                    ELSE CASE event_id % 16 WHEN 6 THEN '3000000000' WHEN 7 THEN '99999999999999999999'
                              ELSE CAST(user_id AS VARCHAR) END END AS qty
        FROM events""",
    "task_form": f"""
        SELECT event_id AS seq, 'Feed pond ' || CAST(user_id AS VARCHAR) AS title, props AS description,
               event_id % {WORKERS_SQL} AS worker_id, ts AS created_date
        FROM events""",
    "stock_moves": f"""
        SELECT event_id AS seq,
               CASE WHEN event_type = 'purchase' THEN 'issue' ELSE 'receive' END AS kind,
               CASE WHEN event_id % 101 = 0 THEN 'x'
                    WHEN event_id % 103 = 0 THEN ' ' || CAST({_range_sql(ITEMS_SQL)} AS VARCHAR) || 'abc'
                    ELSE CAST({_range_sql(ITEMS_SQL)} AS VARCHAR) END AS item_id,
               CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'abc'
                    WHEN event_id % 83 = 0 THEN '-1' WHEN event_id % 79 = 0 THEN '3.7'
                    WHEN event_id % 73 = 0 THEN NULL WHEN event_id % 67 = 0 THEN '3000000000'
                    WHEN event_id % 61 = 0 THEN '99999999999999999999' ELSE CAST(1 + event_id % 5 AS VARCHAR) END AS qty,
               CASE WHEN event_id % 71 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 'notadate' ELSE strftime(ts, '%Y-%m-%d') END AS date
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "approvals": f"""
        SELECT event_id AS seq, {_range_sql(ORDERS_SQL)} AS order_id,
               CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'rejected' WHEN 'error' THEN 'Approved'
                    WHEN 'signup' THEN '' ELSE 'approved' END AS action
        FROM events""",
    "status_changes": f"""
        SELECT event_id AS seq, {_range_sql(ORDERS_SQL)} AS order_id,
               CASE event_type WHEN 'click' THEN 'Processing' WHEN 'view' THEN 'Delivered'
                    WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'Shipped' ELSE '' END AS status
        FROM events""",
    "assignments": f"""
        SELECT event_id AS seq, {_range_sql(ORDERS_SQL)} AS order_id,
               CASE WHEN event_id % 6 = 0 THEN '' ELSE 'Worker ' || CAST(user_id % 25 AS VARCHAR) END AS assigned_by
        FROM events""",
    "supply_status": f"""
        SELECT event_id AS seq, {_range_sql(ORDERS_SQL)} * 10 + (1 + event_id % 7) AS supply_order_id,
               CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_type = 'click' THEN 'Accepted'
                    WHEN event_type = 'view' THEN 'Shipped' ELSE 'Delivered' END AS status
        FROM events""",
    "supply_status_owned": f"""
        SELECT e.event_id AS seq, e.k AS supply_order_id,
               CASE WHEN o.owner IS NULL THEN e.user_id WHEN e.event_id % 3 = 0 THEN o.owner + 1
                    ELSE o.owner END AS supplier_id,
               CASE WHEN e.event_id % 11 = 0 THEN '' ELSE 'Shipped' END AS status
        FROM (SELECT *, {_range_sql(ORDERS_SQL)} * 10 + (1 + event_id % 7) AS k FROM events) e
        LEFT JOIN (SELECT supply_order_id, min(supplier_id) AS owner FROM so GROUP BY supply_order_id) o
          ON o.supply_order_id = e.k""",
    "worker_updates": f"""
        SELECT event_id AS seq, {_range_sql(WORKERS_SQL)} AS id,
               CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Worker ' || CAST(user_id AS VARCHAR) END AS name,
               'w' || CAST(user_id AS VARCHAR) || '@farm.example' AS email,
               '07' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS mobile_no
        FROM events""",
    "worker_deletes": f"SELECT event_id AS seq, {_range_sql(WORKERS_SQL)} * 3 + 1 AS id FROM events",
    "first_worker_deletes": f"""
        SELECT event_id AS seq, {_range_sql(WORKERS_SQL, "CASE WHEN event_id % 5 = 0 THEN event_id - 1 ELSE event_id END")} AS id
        FROM events WHERE event_id <= floor({WORKERS_SQL} * 0.7)""",
    "task_completions": f"""
        SELECT event_id AS seq, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id END AS task_id,
               'worker#' || lpad(CAST(CASE WHEN event_id % 10 = 0 THEN 1000000 + user_id
                                           WHEN event_id % 3 = 0 THEN (event_id + 1) % {WORKERS_SQL}
                                           ELSE event_id % {WORKERS_SQL} END AS VARCHAR), 9, '0') || '@farm.example' AS email
        FROM events""",
    "signups": f"""
        SELECT event_id AS seq,
               CASE event_id % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' WHEN 2 THEN 'worker'
                    ELSE 'user' END AS kind,
               CASE WHEN event_id % 9 = 0 THEN '  ' ELSE '  New ' || CAST(user_id AS VARCHAR) || ' ' END AS name,
               CASE event_id % 5 WHEN 0 THEN NULL
                    WHEN 1 THEN ' customer#' || lpad(CAST(user_id * 11 AS VARCHAR), 9, '0') || '@example.com'
                    WHEN 2 THEN 'worker#' || lpad(CAST(event_id % {WORKERS_SQL} AS VARCHAR), 9, '0') || '@farm.example'
                    WHEN 3 THEN 'supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com'
                    ELSE 'new' || CAST(user_id AS VARCHAR) || '@example.com ' END AS email,
               CASE WHEN event_id % 6 = 0 THEN '07' || lpad(CAST(event_id % {WORKERS_SQL} AS VARCHAR), 8, '0')
                    ELSE '09' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS mobile_no
        FROM events""",
}
