"""Keys for P-1 … P-14, J-1 … J-12 and A-1 … A-17."""

from __future__ import annotations

from farmspark.operators import metrics as M
from farmspark.operators import reads as R
from farmspark.registry import AS_OF_YEAR, query
from farmspark.sources import feeds

Y0, Y1 = AS_OF_YEAR - 1, AS_OF_YEAR
LATEST = """SELECT s.Pond_ID, s.Water_Level, s.pH, s.WaterTemp, s.TDS
            FROM sd s JOIN (SELECT Pond_ID, max(Updated_at) AS latest_time FROM sd GROUP BY Pond_ID) m
              ON s.Pond_ID = m.Pond_ID AND s.Updated_at = m.latest_time"""
WEEK0 = "CAST(strftime(created_at, '%U') AS INTEGER)"
ORDER_COLS_SQL = ("order_id, customer_id, prawn_type, quantity, CAST(price AS DOUBLE) AS price, status, "
                  "approved_or_rejected, payment_receipt, address, assigned_by, created_at, updated_at")
SUPPLY_COLS_SQL = ("so.supply_order_id, so.supplier_id, so.item_id, so.quantity, CAST(so.price AS DOUBLE) AS price, "
                   "so.status, so.order_date")

# ---------------------------------------------------------------- aggregates
query("revenue_total", "SELECT CAST(SUM(price) AS DOUBLE) AS totalRevenue FROM co")(M.revenue_total)
query("new_orders_count",
      "SELECT CAST(COUNT(*) AS BIGINT) AS newOrders FROM co WHERE status = 'New'")(M.new_orders_count)
query("low_stock_count",
      "SELECT CAST(COUNT(*) AS BIGINT) AS lowStockItems FROM inv WHERE quantity < threshold + 25")(M.low_stock_count)
query("revenue_by_month_name", """
    SELECT strftime(created_at, '%B') AS month, CAST(SUM(price) AS DOUBLE) AS revenue
    FROM co GROUP BY month(created_at), strftime(created_at, '%B')""")(M.revenue_by_month_name)
query("sales_count", """SELECT CAST(COUNT(*) AS BIGINT) AS totalSales FROM co
                        WHERE status IN ('Completed', 'Delivered')""")(M.sales_count)
query("sales_revenue", """SELECT CAST(SUM(price) AS DOUBLE) AS totalRevenue FROM co
                          WHERE status IN ('Completed', 'Delivered')""")(M.sales_revenue)
query("sales_count_by_month_name", """
    SELECT strftime(created_at, '%B') AS month, CAST(COUNT(*) AS BIGINT) AS revenue
    FROM co WHERE status IN ('Completed', 'Delivered')
    GROUP BY month(created_at), strftime(created_at, '%B')""")(M.sales_count_by_month_name)
query("qty_daily", f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(year(created_at) AS INTEGER) AS year,
           CAST(SUM(quantity) AS BIGINT) AS total_quantity
    FROM co WHERE year(created_at) IN ({Y0}, {Y1}) GROUP BY 1, 2""")(lambda t: M.qty_daily(t, AS_OF_YEAR))
query("qty_weekly", f"""
    SELECT CAST(year(created_at) AS INTEGER) AS year, {WEEK0} AS week,
           CAST(SUM(quantity) AS BIGINT) AS total_quantity
    FROM co WHERE year(created_at) IN ({Y0}, {Y1}) GROUP BY 1, 2""")(lambda t: M.qty_weekly(t, AS_OF_YEAR))
query("qty_monthly", f"""
    SELECT strftime(created_at, '%Y-%m') AS month, CAST(year(created_at) AS INTEGER) AS year,
           CAST(SUM(quantity) AS BIGINT) AS total_quantity
    FROM co WHERE year(created_at) IN ({Y0}, {Y1}) GROUP BY 1, 2""")(lambda t: M.qty_monthly(t, AS_OF_YEAR))
query("max_time_per_pond",
      "SELECT Pond_ID, max(Updated_at) AS latest_time FROM sd GROUP BY Pond_ID")(M.max_time_per_pond)
_AVG = {"average_water_level": "Water_Level", "average_pH": "pH",
        "average_temperature": "WaterTemp", "average_tds": "TDS"}
query("pond_averages",
      "SELECT " + ", ".join(f"round(avg({c}), 2) AS {a}" for a, c in _AVG.items()) + " FROM latest",
      extra={"latest": LATEST})(M.pond_averages)
for _key, _fn, _alias in [("avg_water_level", M.avg_water_level, "average_water_level"),
                          ("avg_ph", M.avg_ph, "average_pH"),
                          ("avg_temperature", M.avg_temperature, "average_temperature"),
                          ("avg_tds", M.avg_tds, "average_tds")]:
    query(_key, f"SELECT round(avg({_AVG[_alias]}), 2) AS {_alias} FROM latest",
          extra={"latest": LATEST})(_fn)
query("distinct_types",
      "SELECT DISTINCT name FROM inv WHERE quantity > 10 AND type = 'prawns'")(M.distinct_types)

# ------------------------------------------------------------ projections
query("inventory_items", "SELECT item_id, name FROM inv")(R.inventory_items)
query("inventory_table",
      "SELECT item_id, name, type, quantity, threshold, date FROM inv")(R.inventory_table)
query("supplier_list", "SELECT supplier_id, name FROM su")(R.supplier_list)
query("worker_list", "SELECT id, name FROM wk")(R.worker_list)
query("worker_recipients", "SELECT email FROM wk")(R.worker_recipients)
query("registered_workers",
      "SELECT id, name, email, mobile_no AS workerDetails FROM wk")(R.registered_workers)
query("approved_orders",
      f"SELECT {ORDER_COLS_SQL} FROM co WHERE approved_or_rejected = 'Approved'")(R.approved_orders)
query("order_items", """
    SELECT order_id, prawn_type AS name, CAST(quantity AS VARCHAR) || ' Kg' AS quantity,
           'Rs. ' || CAST(CAST(price AS DECIMAL(38,2)) AS VARCHAR) AS price
    FROM co WHERE order_id IN (SELECT order_id FROM order_keys)""",
      feeds=("order_keys",))(lambda t: R.order_items(t, feeds.order_keys(t)))
query("order_status", "SELECT order_id, status FROM co WHERE order_id IN (SELECT order_id FROM order_keys)",
      feeds=("order_keys",))(lambda t: R.order_status(t, feeds.order_keys(t)))
query("order_status_not_found", """
    SELECT DISTINCT k.order_id FROM order_keys k
    WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.order_id = k.order_id)""",
      feeds=("order_keys",))(lambda t: R.order_status_not_found(t, feeds.order_keys(t)))
query("order_receipt_ref", """
    SELECT order_id, payment_receipt FROM co
    WHERE order_id IN (SELECT order_id FROM order_keys)
      AND payment_receipt IS NOT NULL AND payment_receipt <> ''""",
      feeds=("order_keys",))(lambda t: R.order_receipt_ref(t, feeds.order_keys(t)))
query("customer_orders", """
    SELECT customer_id, order_id, prawn_type, quantity, CAST(price AS DOUBLE) AS price, status,
           approved_or_rejected, created_at, updated_at
    FROM co WHERE customer_id IN (SELECT customer_id FROM customer_keys)""",
      feeds=("customer_keys",))(lambda t: R.customer_orders(t, feeds.customer_keys(t)))
query("supply_orders_all", f"SELECT {SUPPLY_COLS_SQL} FROM so")(R.supply_orders_all)
query("feeding_timetable", """
    SELECT feeding_ID, Pond_ID, feeding_sec,
           lpad(CAST(feeding_sec // 3600 AS VARCHAR), 2, '0') || ':' ||
           lpad(CAST((feeding_sec % 3600) // 60 AS VARCHAR), 2, '0') || ':' ||
           lpad(CAST(feeding_sec % 60 AS VARCHAR), 2, '0') AS feeding_time
    FROM fd""")(R.feeding_timetable)
query("sensor_data_view", """
    SELECT Pond_ID, Water_Level, pH, WaterTemp, TDS, strftime(Updated_at, '%Y/%m/%d') AS Date,
           strftime(Updated_at, '%H') || '.00' AS Time
    FROM sd""")(R.sensor_data_view)
query("available_types",
      "SELECT DISTINCT name FROM inv WHERE quantity > 10 AND type = 'prawns'")(R.available_types)
query("available_types_array", """
    SELECT row_number() OVER (ORDER BY name) AS position, name AS prawn_type
    FROM (SELECT DISTINCT name FROM inv WHERE quantity > 10 AND type = 'prawns')""")(R.available_types_array)

# ------------------------------------------------------------------ joins
query("order_table", """
    SELECT o.order_id, c.customer_name AS Customer, o.prawn_type AS PrawnType, o.quantity AS Quantity,
           CAST(o.price AS DOUBLE) AS Amount, o.status AS Status, o.created_at AS Date
    FROM co o JOIN cu c ON o.customer_id = c.customer_id""")(R.order_table)
query("sales_records", """
    SELECT o.order_id AS Order_ID, c.customer_name AS Customer, o.created_at AS Order_Date,
           o.status AS Status, CAST(o.price AS DOUBLE) AS Amount, o.quantity AS Quantity
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.status IN ('Completed', 'Delivered')""")(R.sales_records)
query("order_detail", """
    SELECT o.order_id AS orderId, o.created_at AS orderDate,
           CASE WHEN o.status = 'Delivered' THEN 'Paid' ELSE 'Pending' END AS paymentStatus,
           'Online Payment' AS paymentMethod, o.payment_receipt AS paymentReceipt, o.status,
           o.approved_or_rejected
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.order_id IN (SELECT order_id FROM order_keys)""",
      feeds=("order_keys",))(lambda t: R.order_detail(t, feeds.order_keys(t)))
query("order_customer", """
    SELECT o.order_id, c.customer_name AS name, o.address, c.mobile_no AS phone, c.email
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.order_id IN (SELECT order_id FROM order_keys)""",
      feeds=("order_keys",))(lambda t: R.order_customer(t, feeds.order_keys(t)))
query("purchased_items", """
    SELECT so.supply_order_id, s.name AS supplier_name, i.name, so.quantity, CAST(so.price AS DOUBLE) AS price,
           so.status, so.order_date
    FROM so JOIN su s ON so.supplier_id = s.supplier_id JOIN inv i ON so.item_id = i.item_id""")(R.purchased_items)
query("supply_order_detail", f"""
    SELECT {SUPPLY_COLS_SQL}, i.name AS item_name, s.name AS supplier_name
    FROM so LEFT JOIN inv i ON so.item_id = i.item_id
            LEFT JOIN su s ON so.supplier_id = s.supplier_id""")(R.supply_order_detail)
query("supplier_orders", f"""
    SELECT {SUPPLY_COLS_SQL}, i.name AS item_name
    FROM so JOIN inv i ON so.item_id = i.item_id
    WHERE so.supplier_id IN (SELECT supplier_id FROM supplier_keys)""",
      feeds=("supplier_keys",))(lambda t: R.supplier_orders(t, feeds.supplier_keys(t)))
query("order_contact", """
    SELECT o.order_id, c.email FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.order_id IN (SELECT order_id FROM order_keys) AND c.email IS NOT NULL AND c.email <> ''""",
      feeds=("order_keys",))(lambda t: R.order_contact(t, feeds.order_keys(t)))
query("order_message_rows", """
    SELECT o.order_id, o.prawn_type, o.quantity, CAST(o.price AS DOUBLE) AS price, o.status,
           o.approved_or_rejected, o.created_at, o.updated_at, c.email, c.customer_name
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.order_id IN (SELECT order_id FROM order_keys)""",
      feeds=("order_keys",))(lambda t: R.order_message_rows(t, feeds.order_keys(t)))
query("latest_per_pond", LATEST)(R.latest_per_pond)
query("worker_tasks", """
    SELECT w.email, t.task_id, t.title, t.description, t.worker_id, t.status, t.created_date
    FROM tk t JOIN (SELECT id, email FROM wk WHERE email IN (SELECT email FROM worker_emails)) w
      ON t.worker_id = w.id""",
      feeds=("worker_emails",))(lambda t: R.worker_tasks(t, feeds.worker_emails(t)))
query("exists_check", """
    SELECT k.order_id, EXISTS (SELECT 1 FROM co WHERE co.order_id = k.order_id) AS found
    FROM (SELECT DISTINCT order_id FROM order_keys) k""",
      feeds=("order_keys",))(lambda t: R.exists_check(feeds.order_keys(t), t.customer_order, "order_id"))
