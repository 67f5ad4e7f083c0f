"""Keys for what is written: chained batches on a versioned snapshot, SNK-1 rows
and SNK-2 reports read back in their order."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from farmspark.keys.changes_keys import RULE_CTES, _stock_sql, money_out
from farmspark.operators import reads as R
from farmspark.operators import reports as RP
from farmspark.plans import jobs
from farmspark.plans import snapshots as S
from farmspark.plans.sinks import read_ordered, write_report, write_rows
from farmspark.registry import query
from farmspark.session import scratch_path
from farmspark.sources import change_feeds as CF
from farmspark.sources.tables import Tables

TABLES = ["customer_order", "customer", "inventory", "worker"]


def chained_batches(t: Tables):
    """C-2, C-9, C-6 / C-7, C-13 and C-14 one after the other as batch jobs on a
    versioned snapshot, every batch applied twice; orders, items and workers then."""
    root = scratch_path(t.spark, f"chain-{uuid.uuid4().hex}")
    snap = f"{root}/snapshot"
    jobs.write_snapshot(t, snap, TABLES)
    steps = [("place_orders", CF.app_orders(t)), ("set_order_status", CF.status_changes(t)),
             ("stock_changes", CF.stock_moves(t)), ("update_workers", CF.worker_updates(t)),
             ("delete_workers", CF.first_worker_deletes(t))]
    for i, (rule, changes) in enumerate(steps):
        path = f"{root}/requests/batch-{i}"
        changes.write.parquet(path)
        for _ in range(2):
            jobs.apply_batch(t.spark, snap, path, rule, snap)
    S.compact(t.spark, snap, "inventory", everything=True)
    now = Tables.from_snapshot(t.spark, snap)

    def rows(df, kind, key, text, number):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), text.alias("text"), number.cast("int").alias("number"))
    return (rows(now.customer_order, "order", "order_id", F.col("status"), F.col("quantity"))
            .unionByName(rows(now.inventory, "item", "item_id", F.col("date").cast("string"), F.col("quantity")))
            .unionByName(rows(now.worker, "worker", "id", F.col("email"), F.lit(None))))


def _named(rule: str, chk: str, **bases: str) -> dict[str, str]:
    """A rule's CTEs with its ``chk`` named ``chk``, over other base tables."""
    out = {}
    for name, sql in RULE_CTES[rule].items():
        for old, new in {"chk": chk, **bases}.items():
            sql = re.sub(rf"\b{old}\b", new, sql)
        out[chk if name == "chk" else name] = sql
    return out


_STOCK = re.sub(r"\bchk\b", "chk_m", _stock_sql(("issue", "receive"))[0])
_CHAIN = {
    **_named("place_orders", "chk_p"),
    "co2": """SELECT order_id, quantity, status FROM co UNION ALL
              SELECT (SELECT max(order_id) FROM co) + row_number() OVER (ORDER BY seq), CAST(quantity AS INTEGER), 'New'
              FROM chk_p WHERE reason IS NULL""",
    **_named("set_order_status", "chk_s", co="co2"),
    "last_status": "SELECT order_id, arg_max(status, seq) AS status FROM chk_s WHERE reason IS NULL GROUP BY order_id",
    **_named("stock_apply", "chk_m"),
    "inv2": _STOCK,
    **_named("update_workers", "chk_u"),
    "last_email": "SELECT id, arg_max(email, seq) AS email FROM chk_u WHERE reason IS NULL GROUP BY id",
    **_named("delete_workers", "chk_d"),
    "worker_deletes": CF.CHANGE_SQL["first_worker_deletes"],
}
query("chained_batches", """
    SELECT 'order' AS kind, order_id AS id, coalesce(l.status, b.status) AS text, quantity AS number
    FROM co2 b LEFT JOIN last_status l USING (order_id)
    UNION ALL SELECT 'item', item_id, CAST(date AS VARCHAR), quantity FROM inv2
    UNION ALL SELECT 'worker', id, coalesce(l.email, b.email), NULL FROM wk b LEFT JOIN last_email l USING (id)
    WHERE id NOT IN (SELECT id FROM chk_d WHERE reason IS NULL)""", extra=_CHAIN)(chained_batches)


def written_rows(t: Tables):
    """SNK-1 the order table (J-1), newest first, as JSON lines, read back with positions."""
    path = scratch_path(t.spark, f"rows-{uuid.uuid4().hex}")
    df = money_out(R.order_table(t))
    write_rows(df, path, order=[F.desc("Date"), F.col("order_id")])
    return read_ordered(t.spark, path, df.schema)


query("write_rows", """
    SELECT row_number() OVER (ORDER BY o.created_at DESC NULLS LAST, o.order_id) AS position, o.order_id,
           c.customer_name AS "Customer", o.prawn_type AS "PrawnType", o.quantity AS "Quantity",
           CAST(o.price AS DOUBLE) AS "Amount", o.status AS "Status", o.created_at AS "Date"
    FROM co o JOIN cu c ON o.customer_id = c.customer_id""")(written_rows)


def written_report(t: Tables):
    """SNK-2 the sales report (R-1) as CSV files, read back with positions."""
    path = scratch_path(t.spark, f"report-{uuid.uuid4().hex}")
    df = RP.sales_report(t)
    write_report(df, path)
    return read_ordered(t.spark, path, RP.rows(df).schema, "csv")


query("write_report", """
    SELECT row_number() OVER (ORDER BY o.created_at DESC NULLS LAST, o.order_id) AS position,
           o.order_id AS "Order ID", c.customer_name AS "Customer",
           strftime(o.created_at, '%A %-d %B %Y') AS "Date", o.status AS "Status",
           CAST(o.price AS DOUBLE) AS "Amount", o.quantity AS "Quantity"
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.status IN ('Completed', 'Delivered')""")(written_report)
