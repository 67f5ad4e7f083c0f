"""Outgoing messages (N-1 … N-8) as outbox rows.

Each notice is one join of the accepted changes with the rows the reference
re-reads for its mail, then a ``concat`` template; one row per message in
the :data:`~farmspark.sources.schemas.OUTBOX` shape (kind, ref_id,
recipient, subject, body).  Delivery (SMTP) is not part of the package.

A NULL inside a template prints ``null`` as a JS template string does; a
NULL or empty customer e-mail drops the message, as the reference does.
Addresses the reference hard-wires (manager, admin) and the closing brand
line are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.plans.broadcast import (UPDATE_BROADCAST_BYTES, bounded_broadcast, materialized, restrict_to_keys,
                                       small_keys_flag)
from farmspark.sources.tables import Tables


@dataclass(frozen=True)
class NoticeConfig:
    manager_email: str = "manager@farm.example"
    admin_email: str = "admin@farm.example"
    brand: str = "FarmOps"


DEFAULT = NoticeConfig()

# Subjects and bodies below are the reference's message texts.
INDENT = " " * 20


def _t(x) -> Column:
    """Template slot: text of the value, 'null' for NULL."""
    return F.coalesce(X.c(x).cast("string"), F.lit("null"))


def _stamp(x) -> Column:
    return F.coalesce(X.fmt(x, X.STAMP), F.lit("null"))


def _lines(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _row(kind: str, ref: Column, recipient: Column, subject: Column, body: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), ref.cast("long").alias("ref_id"), recipient.alias("recipient"),
            subject.alias("subject"), body.alias("body")]


def _with_customer_email(t: Tables, accepted: DataFrame, keys_bounded: bool = False) -> DataFrame:
    """accepted ⋈ order ⋈ customer, keeping only a usable e-mail (J-8).
    ``keys_bounded``: the accepted order ids are already known to be within
    the broadcast bound (from the rule's existence check)."""
    if keys_bounded:
        k, bounded = F.broadcast(accepted.select("order_id").distinct()), True
    else:
        k, bounded = small_keys_flag(accepted, ["order_id"])
    o = t.customer_order.select("order_id", "customer_id").join(k, "order_id", "left_semi")
    if bounded:
        # order_id is the key of customer_order: at most one customer per
        # requested order, so this key set has the same proven bound
        c = t.customer.select("customer_id", "email").join(
            F.broadcast(o.select("customer_id").distinct()), "customer_id", "left_semi")
    else:
        # read for the keys of the customers and by the join with them
        o, _ = materialized(o, "orders")
        c = restrict_to_keys(t.customer.select("customer_id", "email"), o, ["customer_id"])
    return accepted.join(o.join(c, "customer_id", "inner"), "order_id", "inner").where(~X.blank("email"))


def order_status_notice(t: Tables, accepted: DataFrame, keys_bounded: bool = False) -> DataFrame:
    """N-1 one message per accepted status change to the order's customer."""
    j = _with_customer_email(t, accepted, keys_bounded)
    return j.select(*_row(
        "order_status", F.col("order_id"), F.col("email"), F.lit("Order Status Update"),
        _lines("Your order #", _t("order_id"), " status has been updated to: ", _t("status"),
               ". Thank you for your business!")))


def order_approval_notice(t: Tables, accepted: DataFrame, keys_bounded: bool = False) -> DataFrame:
    """N-2 one message per accepted approval / rejection."""
    j = _with_customer_email(t, accepted, keys_bounded)
    return j.select(*_row(
        "order_approval", F.col("order_id"), F.col("email"), F.lit("Order Approval Update"),
        _lines("Your order #", _t("order_id"), " has been ", F.lower("action"),
               ". Thank you for your business!")))


def purchase_order_notice(t: Tables, accepted: DataFrame) -> DataFrame:
    """N-3 new purchase order to its supplier (accepted C-3 rows with ids)."""
    s = restrict_to_keys(t.supplier, accepted, ["supplier_id"])
    j = accepted.join(s.select("supplier_id", F.col("name").alias("_sname"), F.col("email").alias("_semail")),
                      "supplier_id", "inner")
    return j.select(*_row(
        "purchase_order", F.col("supply_order_id"), F.col("_semail"), F.lit("New Purchase Order"),
        _lines("Hello ", _t("_sname"), ",\n\nA new purchase order has been created.\n\nOrder ID: ",
               _t("supply_order_id"), "\nItem ID: ", _t("item_id"), "\nQuantity: ", _t("quantity"),
               "\nPrice: ", _t(X.price_text("price")), "\nStatus: New\n\nThank you.")))


def supply_status_notice(t: Tables, accepted: DataFrame, cfg: NoticeConfig = DEFAULT) -> DataFrame:
    """N-4 owned supply status change to the manager.  The reference re-reads
    the order by id only and takes its first row; here the row with the
    lowest (supplier_id, item_id, order_date) is used, pre-aggregated per id."""
    so = restrict_to_keys(t.supply_orders, accepted, ["supply_order_id"])
    # one row per order first, then the names of that row's item and supplier
    best, small = bounded_broadcast(
        so.groupBy("supply_order_id").agg(F.min(F.struct("supplier_id", "item_id", "order_date")).alias("_b"))
        .select("supply_order_id", "_b.*"), UPDATE_BROADCAST_BYTES)

    def names(table: DataFrame, key: str, out: str) -> DataFrame:
        # no more rows than ``best``, of whose keys they are
        wanted = best.select(key).distinct()
        found = table.join(F.broadcast(wanted) if small else wanted, key, "left_semi")
        found = found.select(key, F.col("name").alias(out))
        return F.broadcast(found) if small else found

    detail = (best.join(names(t.inventory, "item_id", "item_name"), "item_id", "left")
              .join(names(t.supplier, "supplier_id", "supplier_name"), "supplier_id", "left")
              .select("supply_order_id", F.struct("item_name", "supplier_name", "order_date").alias("_r")))
    j = accepted.select("supply_order_id", "status").join(detail, "supply_order_id", "left")
    na = lambda c: F.when(F.col("_r").isNull(), F.lit("N/A")).otherwise(c)
    return j.select(*_row(
        "supply_status", F.col("supply_order_id"), F.lit(cfg.manager_email),
        _lines("Supply order #", _t("supply_order_id"), ' status updated to "', _t("status"), '"'),
        _lines("Order ID: ", _t("supply_order_id"), "\nItem: ", na(_t("_r.item_name")),
               "\nSupplier: ", na(_t("_r.supplier_name")), "\nNew status: ", _t("status"),
               "\nOrder date: ", na(_stamp("_r.order_date")))))


def new_order_notice(t: Tables, accepted: DataFrame, cfg: NoticeConfig = DEFAULT) -> DataFrame:
    """N-5 order placed in the customer app, to the admin."""
    cu = restrict_to_keys(t.customer, accepted, ["customer_id"])
    j = accepted.join(cu.select("customer_id", "customer_name", "email"), "customer_id", "inner")
    return j.select(*_row(
        "new_order", F.col("order_id"), F.lit(cfg.admin_email), F.lit("New Order Placed"),
        _lines("New order (ID: ", _t("order_id"), ") from ", _t("customer_name"), " (", _t("email"),
               "):\nProduct: ", _t("prawn_type"), "\nQuantity: ", _t("quantity"), "\nPrice: ",
               _t(X.price_text("price")), "\nLocation: ", _t("location"),
               "\nStatus: New\nApproved/Rejected: Pending\nReceipt filename: ", _t("receipt"))))


def order_update_message(t: Tables, order_ids: DataFrame, cfg: NoticeConfig = DEFAULT) -> DataFrame:
    """N-6 full update text of the given orders (J-9); approval falsy → 'N/A'.
    Timestamps print as yyyy-MM-dd HH:mm:ss (the reference prints a JS Date)."""
    from farmspark.operators.reads import order_message_rows
    r = order_message_rows(t, order_ids)
    return r.select(*_row(
        "order_update", F.col("order_id"), F.col("email"), F.lit("Order Update"),
        _lines("Dear ", _t("customer_name"), ",\n\nYour order (ID: ", _t("order_id"),
               ") status has been updated.\n\nDetails:\n- Product: ", _t("prawn_type"),
               "\n- Quantity: ", _t("quantity"), "\n- Price: ", _t(X.money_text("price")),
               "\n- Status: ", _t("status"), "\n- Approved/Rejected: ",
               X.or_default("approved_or_rejected", "N/A"), "\n- Created At: ", _stamp("created_at"),
               "\n- Updated At: ", _stamp("updated_at"),
               f"\n\nThank you for your business!\n\nBest regards,\n{cfg.brand} Team")))


def worker_order_notice(accepted: DataFrame, cfg: NoticeConfig = DEFAULT) -> DataFrame:
    """N-7 worker-app order status change, to the manager (sent even when no
    order matched)."""
    return accepted.select(*_row(
        "worker_order", F.col("order_id"), F.lit(cfg.manager_email), F.lit("Order Status Updated"),
        _lines("Order ID: ", _t("order_id"), "\nStatus: ", _t("status"))))


def worker_task_notice(accepted: DataFrame, cfg: NoticeConfig = DEFAULT) -> DataFrame:
    """N-7 task completed by a worker, to the manager (only after a match)."""
    return accepted.select(*_row(
        "worker_task", F.col("task_id"), F.lit(cfg.manager_email), F.lit("Task Status Updated"),
        _lines("Task ID: ", _t("task_id"), "\nStatus: completed")))


def welcome_notice(customers: DataFrame, suppliers: DataFrame, workers: DataFrame,
                   cfg: NoticeConfig = DEFAULT) -> DataFrame:
    """N-8 welcome messages for accepted sign-ups.  The worker text of the
    reference also mails the clear password; that line is left out."""
    b = cfg.brand
    cust = customers.select(*_row(
        "welcome_customer", F.col("customer_id"), F.col("email"), F.lit(f"Welcome to {b}!"),
        _lines("Hello ", _t("name"), f",\n\nWelcome to {b}! Your account has been created successfully.\n\n"
               "Username: ", _t("name"), "\n\nPlease login using your email and password. Keep your "
               f"credentials safe.\n\nBest regards,\n{b} Team")))
    supp = suppliers.select(*_row(
        "welcome_supplier", F.col("supplier_id"), F.col("email"), F.lit(f"Welcome to {b}!"),
        _lines("Hello ", _t("name"), f",\n\nWelcome to {b}! Your supplier account has been created "
               "successfully.\n\nUsername: ", _t("name"), "\n\nPlease login using your email and password. "
               f"Keep your credentials safe.\n\nBest regards,\n{b} Team")))
    work = workers.select(*_row(
        "welcome_worker", F.col("id"), F.col("email"), F.lit("Your Worker Account Details"),
        # the mail of the reference carries the indents of its source text
        _lines("Hello ", _t("name"), f",\n\n{INDENT}Your account has been created successfully.\n\n{INDENT}Username: ",
               _t("name"), f"\n{INDENT}User ID: ", _t("worker_code"),
               f"\n\n{INDENT}Please login using this credentials and dont forget these things.\n{INDENT}")))
    return cust.unionByName(supp).unionByName(work)
