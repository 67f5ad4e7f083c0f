"""Date-bounded reports (R-1 … R-4).

The bound applies only when both ends are given (T-7).  The sales and water
reports include the whole end day (``DATE(x) BETWEEN``), the purchase report
compares the DATETIME with the bare date and so stops at 00:00 of the end day
(T-6).  Both forms are written as column ranges, which the Parquet scan
receives as pushed filters.  Column headers are the report labels; the rows
keep their sort key in a hidden column that :func:`sort_report` uses and drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.sources.tables import Tables

SORT_KEY = "_sort_ts"


def _both(start: str | None, end: str | None) -> bool:
    return bool(start) and bool(end)


def sales_report(t: Tables, start: str | None = None, end: str | None = None) -> DataFrame:
    """R-1 completed/delivered sales; date as 'Wednesday 5 January 2000'."""
    o = t.customer_order.where(F.col("status").isin(*X.SALE_STATUSES))
    if _both(start, end):
        o = X.prune_months(o, start, end).where(X.day_bounds("created_at", start, end))
    return (o.join(t.customer, "customer_id", "inner")
            .select(F.col("order_id").alias("Order ID"), F.col("customer_name").alias("Customer"),
                    X.fmt("created_at", X.LONG_DATE).alias("Date"), F.col("status").alias("Status"),
                    F.col("price").cast("double").alias("Amount"), F.col("quantity").alias("Quantity"),
                    F.col("created_at").alias(SORT_KEY)))


def purchase_report(t: Tables, start: str | None = None, end: str | None = None) -> DataFrame:
    """R-2 supply orders with supplier and item names; end day cut at 00:00."""
    so = t.supply_orders
    if _both(start, end):
        so = X.prune_months(so, start, end).where(X.stamp_bounds("order_date", start, end))
    return (so.join(t.supplier.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id")
            .join(t.inventory.select("item_id", "name"), "item_id")
            .select(F.col("supply_order_id").alias("Order ID"), F.col("supplier_name").alias("Supplier Name"),
                    F.col("name").alias("Item Name"), F.col("quantity").alias("Quantity"),
                    F.col("price").cast("double").alias("Price"), F.col("status").alias("Status"),
                    F.col("order_date").alias("Order Date"), F.col("order_date").alias(SORT_KEY)))


def water_report(t: Tables, start: str | None = None, end: str | None = None) -> DataFrame:
    """R-3 readings; TDS is labelled 'Salinity level'."""
    s = t.sensors_data
    if _both(start, end):
        s = X.prune_months(s, start, end).where(X.day_bounds("Updated_at", start, end))
    return s.select(F.col("Pond_ID").alias("Pond ID"), X.fmt("Updated_at", X.WATER_DATE).alias("Date"),
                    X.hour_text("Updated_at").alias("Time"), F.col("Water_Level").alias("Water level"),
                    F.col("pH").alias("pH level"), F.col("TDS").alias("Salinity level"),
                    F.col("WaterTemp").alias("Temperature"), F.col("Updated_at").alias(SORT_KEY))


def inventory_report(t: Tables) -> DataFrame:
    """R-4 every item with its last update date; no filter, no order."""
    return t.inventory.select(F.col("item_id").alias("ID"), F.col("name").alias("Item Name"),
                              F.col("quantity").alias("Quantity"),
                              X.fmt("date", X.LONG_DATE).alias("Last Update"))


def sort_report(df: DataFrame) -> DataFrame:
    """Newest first (the reference's ORDER BY … DESC), ties by the first column, then
    drop the key."""
    if SORT_KEY not in df.columns:
        return df
    return df.orderBy(F.col(SORT_KEY).desc(), F.col(f"`{df.columns[0]}`")).drop(SORT_KEY)


def rows(df: DataFrame) -> DataFrame:
    """Report rows without the hidden sort key (unsorted)."""
    return df.drop(SORT_KEY) if SORT_KEY in df.columns else df


__all__ = ["sales_report", "purchase_report", "water_report", "inventory_report",
           "sort_report", "rows"]
