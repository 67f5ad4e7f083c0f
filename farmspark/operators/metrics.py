"""Aggregates (A-1 … A-16).

All global or grouped aggregates are plain ``agg`` calls: Spark plans a
partial (map-side) aggregate before the exchange, so a hot group costs one
pre-aggregated row per task, not a skewed shuffle.  Filters are written so
that they reach the Parquet scan (see :func:`~farmspark.functions.exprs.year_range`).

Each grouped operator takes ``ordered``: the reference always sorts, but the
sort is a range shuffle that only report sinks need, so it is opt-in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.operators import reads
from farmspark.sources.tables import Tables


def _sales(t: Tables) -> DataFrame:
    return t.customer_order.where(F.col("status").isin(*X.SALE_STATUSES))


def _money_sum(col: str) -> F.Column:
    # exact decimal sum, returned as a double (JSON number)
    return F.sum(col).cast("double")


def revenue_total(t: Tables) -> DataFrame:
    """A-1 SUM(price) over every order, any status (T-2)."""
    return t.customer_order.agg(_money_sum("price").alias("totalRevenue"))


def new_orders_count(t: Tables) -> DataFrame:
    """A-2 orders with status 'New' (T-14)."""
    return (t.customer_order.where(F.col("status") == "New")
            .agg(F.count(F.lit(1)).alias("newOrders")))


def low_stock_count(t: Tables, margin: int = X.LOW_STOCK_MARGIN) -> DataFrame:
    """A-3 items with quantity < threshold + margin; NULL threshold never counts."""
    return (t.inventory.where(F.col("quantity") < F.col("threshold") + F.lit(margin))
            .agg(F.count(F.lit(1)).alias("lowStockItems")))


def _by_month_name(df: DataFrame, value: F.Column, ordered: bool) -> DataFrame:
    out = (df.groupBy(F.month("created_at").alias("_m"), X.month_name("created_at").alias("month"))
           .agg(value.alias("revenue")))
    if ordered:
        out = out.orderBy(F.col("_m").asc_nulls_first())
    return out.select("month", "revenue")


def revenue_by_month_name(t: Tables, ordered: bool = False) -> DataFrame:
    """A-4 SUM(price) per month of year, all years merged, calendar order (T-3)."""
    return _by_month_name(t.customer_order, _money_sum("price"), ordered)


def sales_count(t: Tables) -> DataFrame:
    """A-5."""
    return _sales(t).agg(F.count(F.lit(1)).alias("totalSales"))


def sales_revenue(t: Tables) -> DataFrame:
    """A-6."""
    return _sales(t).agg(_money_sum("price").alias("totalRevenue"))


def sales_count_by_month_name(t: Tables, ordered: bool = False) -> DataFrame:
    """A-7 COUNT(*) per month of year, **named revenue** (T-1)."""
    return _by_month_name(_sales(t), F.count(F.lit(1)), ordered)


def _recent(t: Tables, as_of_year: int) -> DataFrame:
    # T-5: the reference reads the server clock; here the year is a parameter
    o = X.prune_months(t.customer_order, f"{as_of_year - 1}-01-01", f"{as_of_year}-12-31")
    return o.where(X.year_range("created_at", [as_of_year - 1, as_of_year]))


def qty_daily(t: Tables, as_of_year: int, ordered: bool = False) -> DataFrame:
    """A-8 SUM(quantity) per day of this and the previous year."""
    out = (_recent(t, as_of_year)
           .groupBy(X.fmt("created_at", X.DAY).alias("day"), F.year("created_at").alias("year"))
           .agg(F.sum("quantity").cast("long").alias("total_quantity")))
    return out.orderBy("day") if ordered else out


def qty_weekly(t: Tables, as_of_year: int, ordered: bool = False) -> DataFrame:
    """A-9 SUM(quantity) per (year, MySQL WEEK mode 0) (T-4)."""
    out = (_recent(t, as_of_year)
           .groupBy(F.year("created_at").alias("year"), X.mysql_week0("created_at").alias("week"))
           .agg(F.sum("quantity").cast("long").alias("total_quantity")))
    return out.orderBy("year", "week") if ordered else out


def qty_monthly(t: Tables, as_of_year: int, ordered: bool = False) -> DataFrame:
    """A-10 SUM(quantity) per year-month."""
    out = (_recent(t, as_of_year)
           .groupBy(X.fmt("created_at", X.MONTH).alias("month"), F.year("created_at").alias("year"))
           .agg(F.sum("quantity").cast("long").alias("total_quantity")))
    return out.orderBy("month") if ordered else out


def max_time_per_pond(t: Tables) -> DataFrame:
    """A-11 MAX(Updated_at) GROUP BY Pond_ID (NULL pond is its own group)."""
    return t.sensors_data.groupBy("Pond_ID").agg(F.max("Updated_at").alias("latest_time"))


def pond_averages(t: Tables, broadcast_bytes: int = reads.LATEST_BROADCAST_BYTES) -> DataFrame:
    """A-12 … A-15 in one pass: averages over the latest reading(s) of each
    pond (ties weigh more than once, T-8), NULLs ignored, rounded to 2."""
    latest = reads.latest_per_pond(t, broadcast_bytes=broadcast_bytes)
    return latest.agg(
        X.round2(F.avg("Water_Level")).alias("average_water_level"),
        X.round2(F.avg("pH")).alias("average_pH"),
        X.round2(F.avg("WaterTemp")).alias("average_temperature"),
        X.round2(F.avg("TDS")).alias("average_tds"))


def avg_water_level(t: Tables) -> DataFrame:
    """A-12."""
    return pond_averages(t).select("average_water_level")


def avg_ph(t: Tables) -> DataFrame:
    """A-13."""
    return pond_averages(t).select("average_pH")


def avg_temperature(t: Tables) -> DataFrame:
    """A-14."""
    return pond_averages(t).select("average_temperature")


def avg_tds(t: Tables) -> DataFrame:
    """A-15."""
    return pond_averages(t).select("average_tds")


def averages_text(averages: DataFrame) -> DataFrame:
    """T-11: the reference returns the averages as 2-decimal text; the query
    keeps numbers and this view is for the JSON sink."""
    return averages.select(*[X.money_text(c).alias(c) for c in averages.columns])


def distinct_types(t: Tables) -> DataFrame:
    """A-16 / P-14 DISTINCT item names with quantity > 10 and type 'prawns'."""
    return (t.inventory.where((F.col("quantity") > 10) & (F.col("type") == "prawns"))
            .select("name").distinct())
