"""Explicit schemas: nothing is inferred at read time.

Business tables follow the column use of the reference handlers.  Credential
columns (passwords) are never part of any schema here, so they can never be
loaded or leaked by a ``SELECT *``.
"""

from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
TS, DT = T.TimestampNTZType(), T.DateType()
MONEY = T.DecimalType(12, 2)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- driver tables (TPC-H-ish + events), as written by the test driver ----
RAW = {
    "region": _st(("r_regionkey", I), ("r_name", S)),
    "nation": _st(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _st(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                    ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _st(("s_suppkey", L), ("s_name", S), ("s_nationkey", I),
                    ("s_acctbal", D)),
    "part": _st(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                ("p_size", I), ("p_retailprice", D)),
    "orders": _st(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                  ("o_totalprice", D), ("o_orderdate", TS),
                  ("o_orderpriority", S)),
    "lineitem": _st(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                    ("l_linenumber", I), ("l_quantity", D),
                    ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                    ("l_returnflag", S), ("l_linestatus", S),
                    ("l_shipdate", TS)),
    "events": _st(("event_id", L), ("ts", TS), ("user_id", L),
                  ("event_type", S), ("value", D), ("props", S)),
}

# --- business tables ------------------------------------------------------
CUSTOMER_ORDER = _st(
    ("order_id", L), ("customer_id", L), ("prawn_type", S), ("quantity", I),
    ("price", MONEY), ("status", S), ("approved_or_rejected", S),
    ("payment_receipt", S), ("address", S), ("assigned_by", S),
    ("created_at", TS), ("updated_at", TS))
CUSTOMER = _st(("customer_id", L), ("customer_name", S), ("mobile_no", S),
               ("email", S))
SUPPLIER = _st(("supplier_id", L), ("name", S), ("email", S), ("mobile_no", S))
WORKER = _st(("id", L), ("name", S), ("email", S), ("mobile_no", S))
USERS = _st(("serviceId", S), ("email", S), ("phone", S))
INVENTORY = _st(("item_id", L), ("name", S), ("type", S), ("quantity", I),
                ("threshold", I), ("date", DT))
SUPPLY_ORDERS = _st(("supply_order_id", L), ("supplier_id", L), ("item_id", L),
                    ("quantity", I), ("price", MONEY), ("status", S),
                    ("order_date", TS))
SENSORS_DATA = _st(("Pond_ID", I), ("Water_Level", D), ("pH", D),
                   ("WaterTemp", D), ("TDS", D), ("Updated_at", TS))
TASK = _st(("task_id", L), ("title", S), ("description", S), ("worker_id", L),
           ("status", S), ("created_date", TS))
# feeding_time (TIME) is held as int seconds of day: ADDTIME(t, 15 min) may
# pass 24:00, which a TIME value cannot hold.
FEEDING_SCHEDULE = _st(("feeding_ID", L), ("Pond_ID", I), ("feeding_sec", I))
THRESHOLDS = _st(("min_water_level", D), ("max_water_level", D),
                 ("min_temperature", D), ("max_temperature", D),
                 ("min_tds", D), ("max_tds", D))

BUSINESS = {
    "customer_order": CUSTOMER_ORDER,
    "customer": CUSTOMER,
    "supplier": SUPPLIER,
    "worker": WORKER,
    "users": USERS,
    "inventory": INVENTORY,
    "supply_orders": SUPPLY_ORDERS,
    "sensors_data": SENSORS_DATA,
    "task": TASK,
    "feeding_schedule": FEEDING_SCHEDULE,
}

# Sensor device document (SRC-2): {waterLevelInside, waterTemp, tds}
SENSOR_JSON = _st(("waterLevelInside", D), ("waterTemp", D), ("tds", D))

# Outbox rows (SNK-5): one message per row; delivery is not part of this
# package.
OUTBOX = _st(("kind", S), ("ref_id", L), ("recipient", S), ("subject", S),
             ("body", S))

REJECTS = _st(("seq", L), ("reason", S))
