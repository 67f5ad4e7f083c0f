"""Projections, filters, sorts (P-1 … P-14) and joins (J-1 … J-12).

Point lookups of the reference (``WHERE id = ?``) take a DataFrame of keys and
become semi-joins or equi-joins, so a batch of a million lookups is one join,
not a loop.  The distinct requested keys are counted and broadcast when under
a bound (:func:`~farmspark.plans.broadcast.restrict_to_keys`), so the big
table is scanned and probed but not shuffled; beyond the bound it is a shuffle
semi-join.  Dimension joins carry no hints: Catalyst broadcasts a dimension
whose Parquet size is under the threshold and falls back to a sort-merge join
otherwise; AQE splits skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.plans.broadcast import KEYS_BROADCAST_BYTES, bounded_broadcast, restrict_to_keys, small_keys
from farmspark.plans.ids import dense_ids
from farmspark.sources.tables import Tables

# The per-pond maxima are broadcast when at most this many ponds exist.
LATEST_BROADCAST_BYTES = 32 << 20

ORDER_COLS = ["order_id", "customer_id", "prawn_type", "quantity", "price", "status",
              "approved_or_rejected", "payment_receipt", "address", "assigned_by",
              "created_at", "updated_at"]
SUPPLY_COLS = ["supply_order_id", "supplier_id", "item_id", "quantity", "price", "status",
               "order_date"]


def _money(col: str) -> F.Column:
    return F.col(col).cast("double")


def _orders_view(df: DataFrame) -> DataFrame:
    """Order rows with money as a JSON number (double)."""
    return df.select(*[_money(c).alias(c) if c == "price" else F.col(c) for c in df.columns])


# --- P: projections / filters -------------------------------------------

def inventory_items(t: Tables) -> DataFrame:
    """P-1 item pick list."""
    return t.inventory.select("item_id", "name")


def inventory_table(t: Tables) -> DataFrame:
    """P-2 whole stock table (explicit columns, T-22)."""
    return t.inventory.select("item_id", "name", "type", "quantity", "threshold", "date")


def supplier_list(t: Tables) -> DataFrame:
    """P-3."""
    return t.supplier.select("supplier_id", "name")


def worker_list(t: Tables) -> DataFrame:
    """P-4."""
    return t.worker.select("id", "name")


def registered_workers(t: Tables) -> DataFrame:
    """P-5 worker directory; mobile_no is renamed workerDetails."""
    return t.worker.select("id", "name", "email", F.col("mobile_no").alias("workerDetails"))


def worker_recipients(t: Tables) -> DataFrame:
    """A-17 (dormant alert job) the worker e-mail list, one row per worker.
    The reference joins the list into one ``', '``-separated header in the
    mail transport; that join is left to delivery (not built), so no single
    row has to hold every address."""
    return t.worker.select("email")


def approved_orders(t: Tables, ordered: bool = False) -> DataFrame:
    """P-6 approved orders, newest first."""
    out = _orders_view(t.customer_order.where(F.col("approved_or_rejected") == "Approved")
                       .select(*ORDER_COLS))
    return out.orderBy(F.desc("created_at")) if ordered else out


def order_items(t: Tables, order_ids: DataFrame) -> DataFrame:
    """P-7 item lines of the given orders with display text (T-19: NULL
    stays NULL instead of printing 'null Kg')."""
    o = restrict_to_keys(t.customer_order, order_ids, ["order_id"])
    return o.select("order_id",
                    F.col("prawn_type").alias("name"),
                    F.concat(F.col("quantity").cast("string"), F.lit(" Kg")).alias("quantity"),
                    F.concat(F.lit("Rs. "), X.money_text("price")).alias("price"))


def order_status(t: Tables, order_ids: DataFrame) -> DataFrame:
    """P-8 status of the given orders."""
    return (restrict_to_keys(t.customer_order, order_ids, ["order_id"])
            .select("order_id", "status"))


def order_status_not_found(t: Tables, order_ids: DataFrame) -> DataFrame:
    """P-8 requested order ids that do not exist (404 list)."""
    k = order_ids.select("order_id").distinct()
    return k.join(restrict_to_keys(t.customer_order.select("order_id"), k, ["order_id"]), "order_id", "left_anti")


def order_receipt_ref(t: Tables, order_ids: DataFrame) -> DataFrame:
    """P-9 receipt path; NULL or '' counts as not found."""
    return (restrict_to_keys(t.customer_order, order_ids, ["order_id"])
            .where(~X.blank("payment_receipt"))
            .select("order_id", "payment_receipt"))


def customer_orders(t: Tables, customer_ids: DataFrame, ordered: bool = False) -> DataFrame:
    """P-10 orders of the given customers, newest first."""
    o = (restrict_to_keys(t.customer_order, customer_ids, ["customer_id"])
         .select("customer_id", "order_id", "prawn_type", "quantity", _money("price").alias("price"),
                 "status", "approved_or_rejected", "created_at", "updated_at"))
    return o.orderBy(F.desc("created_at")) if ordered else o


def supply_orders_all(t: Tables, ordered: bool = False) -> DataFrame:
    """P-11 every supply order, newest first."""
    out = _orders_view(t.supply_orders.select(*SUPPLY_COLS))
    return out.orderBy(F.desc("order_date")) if ordered else out


def feeding_timetable(t: Tables, ordered: bool = False) -> DataFrame:
    """P-12 schedule sorted by pond then time."""
    out = t.feeding_schedule.select("feeding_ID", "Pond_ID", "feeding_sec",
                                    X.sec_to_time_text("feeding_sec").alias("feeding_time"))
    return out.orderBy("Pond_ID", "feeding_sec") if ordered else out


def sensor_data_view(t: Tables, ordered: bool = False) -> DataFrame:
    """P-13 readings with Date yyyy/MM/dd and Time HH.00, newest first."""
    s = t.sensors_data
    out = s.select("Pond_ID", "Water_Level", "pH", "WaterTemp", "TDS",
                   X.fmt("Updated_at", X.SLASH_DATE).alias("Date"),
                   X.hour_text("Updated_at").alias("Time"),
                   "Updated_at")
    if ordered:
        out = out.orderBy(F.desc("Updated_at"))
    return out.drop("Updated_at")


def available_types(t: Tables) -> DataFrame:
    """P-14 DISTINCT prawn item names in stock (quantity > 10)."""
    return (t.inventory.where((F.col("quantity") > 10) & (F.col("type") == "prawns"))
            .select("name").distinct())


def available_types_array(t: Tables) -> DataFrame:
    """P-14 flattened form ``{prawnTypes: [...]}`` as its elements in order:
    (position, prawn_type).  The catalogue grows, so no row holds it whole; a
    caller that knows it to be small makes the array."""
    names = available_types(t).select(F.col("name").alias("prawn_type"))
    return dense_ids(names, F.lit(0), "position", "prawn_type").select("position", "prawn_type")


# --- J: joins --------------------------------------------------------------

def _order_customer(t: Tables) -> DataFrame:
    return t.customer_order.join(t.customer, "customer_id", "inner")


def order_table(t: Tables, ordered: bool = False) -> DataFrame:
    """J-1 orders with customer name, newest first."""
    out = _order_customer(t).select(
        "order_id", F.col("customer_name").alias("Customer"), F.col("prawn_type").alias("PrawnType"),
        F.col("quantity").alias("Quantity"), _money("price").alias("Amount"),
        F.col("status").alias("Status"), F.col("created_at").alias("Date"))
    return out.orderBy(F.desc("Date")) if ordered else out


def sales_rows(t: Tables) -> DataFrame:
    return (t.customer_order.where(F.col("status").isin(*X.SALE_STATUSES))
            .join(t.customer, "customer_id", "inner"))


def sales_records(t: Tables, ordered: bool = False) -> DataFrame:
    """J-2 completed/delivered orders with customer name."""
    out = sales_rows(t).select(
        F.col("order_id").alias("Order_ID"), F.col("customer_name").alias("Customer"),
        F.col("created_at").alias("Order_Date"), F.col("status").alias("Status"),
        _money("price").alias("Amount"), F.col("quantity").alias("Quantity"))
    return out.orderBy(F.desc("Order_Date")) if ordered else out


def order_detail(t: Tables, order_ids: DataFrame) -> DataFrame:
    """J-3 order header; paid iff delivered."""
    o = restrict_to_keys(_order_customer(t), order_ids, ["order_id"])
    return o.select(
        F.col("order_id").alias("orderId"), F.col("created_at").alias("orderDate"),
        F.when(F.col("status") == "Delivered", "Paid").otherwise("Pending").alias("paymentStatus"),
        F.lit("Online Payment").alias("paymentMethod"),
        F.col("payment_receipt").alias("paymentReceipt"), "status", "approved_or_rejected")


def order_customer(t: Tables, order_ids: DataFrame) -> DataFrame:
    """J-4 contact of an order; the address comes from the order."""
    o = restrict_to_keys(_order_customer(t), order_ids, ["order_id"])
    return o.select("order_id", F.col("customer_name").alias("name"), "address",
                    F.col("mobile_no").alias("phone"), "email")


def purchased_items(t: Tables, ordered: bool = False) -> DataFrame:
    """J-5 supply orders with supplier and item names (3-way inner join)."""
    out = (t.supply_orders
           .join(t.supplier.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id")
           .join(t.inventory.select("item_id", "name"), "item_id")
           .select("supply_order_id", "supplier_name", "name", "quantity", _money("price").alias("price"),
                   "status", "order_date"))
    return out.orderBy(F.desc("order_date")) if ordered else out


def supply_order_detail(t: Tables) -> DataFrame:
    """J-6 supply orders; item and supplier names kept NULL when missing."""
    return (t.supply_orders
            .join(t.inventory.select("item_id", F.col("name").alias("item_name")), "item_id", "left")
            .join(t.supplier.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id", "left")
            .select(*SUPPLY_COLS, "item_name", "supplier_name")
            .withColumn("price", _money("price")))


def supplier_orders(t: Tables, supplier_ids: DataFrame, ordered: bool = False) -> DataFrame:
    """J-7 orders of the given suppliers with item name, newest first."""
    out = (restrict_to_keys(t.supply_orders, supplier_ids, ["supplier_id"])
           .join(t.inventory.select("item_id", F.col("name").alias("item_name")), "item_id")
           .select(*SUPPLY_COLS, "item_name")
           .withColumn("price", _money("price")))
    return out.orderBy(F.desc("order_date")) if ordered else out


def order_contact(t: Tables, order_ids: DataFrame) -> DataFrame:
    """J-8 customer e-mail of each given order; NULL/'' dropped."""
    return (restrict_to_keys(_order_customer(t), order_ids, ["order_id"])
            .where(~X.blank("email"))
            .select("order_id", "email"))


def order_message_rows(t: Tables, order_ids: DataFrame) -> DataFrame:
    """J-9 order + customer columns used by the update message (N-6)."""
    return (restrict_to_keys(_order_customer(t), order_ids, ["order_id"])
            .select("order_id", "prawn_type", "quantity", _money("price").alias("price"), "status",
                    "approved_or_rejected", "created_at", "updated_at", "email", "customer_name"))


def latest_per_pond(t: Tables, broadcast_bytes: int = LATEST_BROADCAST_BYTES,
                    readings: DataFrame | None = None) -> DataFrame:
    """J-10 the latest reading(s) of each pond.

    Aggregate + equi-join back, as the reference does: ties are all kept
    (T-8), a NULL pond or a pond whose times are all NULL drops out (T-9).
    The per-pond maxima are pre-aggregated map-side, then broadcast when
    their size is under ``broadcast_bytes`` so the readings are never
    shuffled; beyond it the join is a sort-merge on (pond, time), which also
    spreads one hot pond across many partitions.
    """
    s = readings if readings is not None else t.sensors_data
    latest = (s.where(F.col("Pond_ID").isNotNull() & F.col("Updated_at").isNotNull())
              .groupBy(F.col("Pond_ID").alias("_pond"))
              .agg(F.max("Updated_at").alias("_latest")))
    latest, _ = bounded_broadcast(latest, broadcast_bytes)
    j = s.join(latest, (F.col("Pond_ID") == F.col("_pond")) & (F.col("Updated_at") == F.col("_latest")),
               "inner")
    return j.select("Pond_ID", "Water_Level", "pH", "WaterTemp", "TDS")


def worker_tasks(t: Tables, emails: DataFrame, ordered: bool = False) -> DataFrame:
    """J-11 tasks of the workers with the given e-mails, oldest first."""
    w = (restrict_to_keys(t.worker, emails, ["email"])
         .select(F.col("id").alias("worker_id"), "email"))
    w, _ = bounded_broadcast(w, KEYS_BROADCAST_BYTES)
    out = (t.task.join(w, "worker_id", "inner")
           .select("email", "task_id", "title", "description", "worker_id", "status", "created_date"))
    return out.orderBy("created_date") if ordered else out


def exists_check(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """J-12 existence test of the reference ("query then test length") as a
    semi/anti pair: one row per distinct requested key with ``found``."""
    k = small_keys(keys, [key])
    # the found keys are no more than the requested ones
    present = table.select(key).join(k, key, "left_semi").distinct().withColumn("found", F.lit(True))
    return k.join(present, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
