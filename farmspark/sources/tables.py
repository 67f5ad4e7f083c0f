"""SRC-1: load the business tables.

Two ways in:

* :meth:`Tables.from_snapshot` reads business tables written by our own jobs
  (one Parquet folder per table, explicit schema, no inference).
* :meth:`Tables.from_driver` derives them from the driver's TPC-H-ish tables
  with the adapters below.  The same adapters are written in DuckDB SQL in
  :mod:`farmspark.oracle_sql`; keep the two in step.

Every adapter is a narrow projection (plus one pre-aggregated join for the
order quantity), so Catalyst prunes the Parquet columns and pushes filters of
the consuming query down to the scan.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farmspark.sources import schemas


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table with its declared schema."""
    return spark.read.schema(schemas.RAW[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _minutes(c: Column) -> Column:
    return F.make_dt_interval(mins=c)


def adapt_customer_order(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # order quantity = sum of its lines; partial aggregation before the
    # shuffle keeps the lineitem side to one row per order key
    qty = (lineitem.groupBy("l_orderkey")
           .agg(F.sum("l_quantity").cast("int").alias("quantity")))
    key = F.col("o_orderkey")
    created = F.col("o_orderdate") + _minutes(key % 1440)
    return (orders.join(qty, orders.o_orderkey == qty.l_orderkey, "left")
            .select(
                key.alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("o_orderpriority").alias("prawn_type"),
                F.col("quantity"),
                F.col("o_totalprice").cast(schemas.MONEY).alias("price"),
                F.when(F.col("o_orderstatus") == "O", "New")
                 .when(F.col("o_orderstatus") == "P", "Processing")
                 .when(key % 2 == 0, "Delivered")
                 .otherwise("Completed").alias("status"),
                F.when(key % 3 == 0, "Approved")
                 .when(key % 3 == 1, "Rejected").alias("approved_or_rejected"),
                F.when(key % 4 == 0, F.lit(None).cast("string"))
                 .when(key % 4 == 1, F.lit(""))
                 .otherwise(F.concat(F.lit("uploads/receipt_"), key.cast("string"), F.lit(".jpg")))
                 .alias("payment_receipt"),
                F.concat(F.lit("Pond Road "), (F.col("o_custkey") % 97).cast("string")).alias("address"),
                F.lit(None).cast("string").alias("assigned_by"),
                F.when(key % 211 == 7, F.lit(None).cast("timestamp_ntz")).otherwise(created).alias("created_at"),
                F.when(key % 5 == 0, F.lit(None).cast("timestamp_ntz"))
                 .otherwise(created + F.make_dt_interval(days=F.lit(1))).alias("updated_at"),
            ))


def adapt_customer(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.lpad(k.cast("string"), 10, "0").alias("mobile_no"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
         .when(k % 10 == 1, F.lit(""))
         .otherwise(F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"))


def adapt_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("mobile_no"))


def adapt_worker(supplier: DataFrame) -> DataFrame:
    """Workers: one per supplier row of the driver data (scales with it)."""
    k = F.col("s_suppkey")
    name = F.regexp_replace(F.col("s_name"), "Supplier", "Worker")
    return supplier.select(
        k.alias("id"),
        name.alias("name"),
        F.concat(F.lower(name), F.lit("@farm.example")).alias("email"),
        F.concat(F.lit("07"), F.lpad(k.cast("string"), 8, "0")).alias("mobile_no"))


def adapt_users(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("S"), F.lpad(k.cast("string"), 6, "0")).alias("serviceId"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lpad(k.cast("string"), 10, "0").alias("phone"))


def adapt_inventory(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("item_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "prawns").otherwise(F.lower("p_type")).alias("type"),
        F.col("p_size").alias("quantity"),
        F.when(k % 7 == 0, F.lit(None).cast("int")).otherwise((k % 20).cast("int")).alias("threshold"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).alias("date"))


def adapt_supply_orders(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("supply_order_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(-1).cast("long"))
         .otherwise(F.col("l_partkey")).alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(schemas.MONEY).alias("price"),
        F.when(F.col("l_returnflag") == "N", "New")
         .when(F.col("l_returnflag") == "A", "Accepted")
         .otherwise("Delivered").alias("status"),
        (F.col("l_shipdate") + _minutes(F.col("l_orderkey") % 1440)).alias("order_date"))


def adapt_sensors_data(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    return events.select(
        F.when(F.col("user_id") % 50 == 49, F.lit(None).cast("int"))
         .otherwise(F.col("user_id").cast("int")).alias("Pond_ID"),
        F.col("value").alias("Water_Level"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(6 + (eid % 30) / 10).alias("pH"),
        (20 + eid % 15).cast("double").alias("WaterTemp"),
        F.get_json_object("props", "$.k").cast("double").alias("TDS"),
        F.when((F.col("event_type") == "signup") & (eid % 5 == 0), F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts") - F.hour("ts") % 6))
         .alias("Updated_at"))


def top(df: DataFrame, key: str) -> Column:
    """Number of keys 0 … max of a table, as a scalar subquery."""
    return df.agg(F.max(key) + 1).scalar()


def adapt_task(events: DataFrame, supplier: DataFrame) -> DataFrame:
    """Tasks are spread over all workers (one per supplier row)."""
    return events.select(
        F.col("event_id").alias("task_id"),
        F.col("event_type").alias("title"),
        F.col("props").alias("description"),
        (F.col("event_id") % top(supplier, "s_suppkey")).alias("worker_id"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("pending").alias("status"),
        F.col("ts").alias("created_date"))


def adapt_feeding_schedule(supplier: DataFrame) -> DataFrame:
    """One feeding slot per supplier row of the driver data (scales with it)."""
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("feeding_ID"),
        (F.col("s_nationkey") + 1).alias("Pond_ID"),
        ((k * 3540) % 86400).cast("int").alias("feeding_sec"))


class Tables:
    """The business tables as DataFrames.  Frames are built on first use,
    so a query only lists and plans the tables it reads."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame | Callable[[], DataFrame]],
                 raw_dir: str | None = None):
        self.spark = spark
        self._thunks = dict(frames)
        self._built: dict[str, DataFrame] = {}
        # rules built side by side share the frames
        self._lock = threading.RLock()
        self.raw_dir = raw_dir

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self._thunks}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "raw_dir"):
            raise AttributeError(name)
        built = self.__dict__["_built"]
        with self.__dict__["_lock"]:
            if name not in built:
                thunks = self.__dict__["_thunks"]
                if name not in thunks:
                    raise AttributeError(name)
                f = thunks[name]
                built[name] = f() if callable(f) else f
            return built[name]

    def raw(self, name: str) -> DataFrame:
        if self.raw_dir is None:
            raise ValueError("raw driver tables are only known for Tables.from_driver")
        return read_raw(self.spark, self.raw_dir, name)

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        r = lambda n: read_raw(spark, sf_dir, n)
        frames = {
            "customer_order": lambda: adapt_customer_order(r("orders"), r("lineitem")),
            "customer": lambda: adapt_customer(r("customer")),
            "supplier": lambda: adapt_supplier(r("supplier")),
            "worker": lambda: adapt_worker(r("supplier")),
            "users": lambda: adapt_users(r("customer")),
            "inventory": lambda: adapt_inventory(r("part")),
            "supply_orders": lambda: adapt_supply_orders(r("lineitem")),
            "sensors_data": lambda: adapt_sensors_data(r("events")),
            "task": lambda: adapt_task(r("events"), r("supplier")),
            "feeding_schedule": lambda: adapt_feeding_schedule(r("supplier")),
        }
        return cls(spark, frames, sf_dir)

    @classmethod
    def from_snapshot(cls, spark: SparkSession, root: str) -> "Tables":
        """The newest version of a snapshot (:mod:`farmspark.plans.snapshots`), or
        plain table folders below ``root`` where nothing was published."""
        from farmspark.plans import snapshots as S
        newest = S.manifest(spark, root)
        if newest.version:
            return cls.from_manifest(spark, newest)
        frames = {n: (lambda p=os.path.join(root, n), n=n: spark.read.schema(S.table_schema(n)).parquet(p))
                  for n in schemas.BUSINESS if S.exists(spark, os.path.join(root, n))}
        return cls(spark, frames, None)

    @classmethod
    def from_manifest(cls, spark: SparkSession, version) -> "Tables":
        """The tables of one version of a snapshot."""
        from farmspark.plans import snapshots as S
        return cls(spark, {n: (lambda n=n, p=p: S.read_table(spark, n, p)) for n, p in version.tables.items()}, None)

    def with_ids(self, version, name: str, ids: DataFrame) -> "Tables":
        """These tables, of ``name`` only the months of ``version`` that can hold one
        of the ``ids`` (one column): for lookups by id."""
        from farmspark.plans import snapshots as S
        parts = version.tables[name]
        months = S.months_of_ids(parts, ids, ids.columns[0])
        return self if months is None else self.with_table(name, S.read_table(self.spark, name, parts, months))

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        frames = dict(self._thunks)
        frames[name] = df
        return Tables(self.spark, frames, self.raw_dir)


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables.from_driver(spark, sf_dir)
