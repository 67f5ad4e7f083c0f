"""Keys for R-1 … R-4 (rows of the report, hidden sort key dropped)."""

from __future__ import annotations

from farmspark.operators import reports as RP
from farmspark.registry import query

SALES_RANGE = ("2000-01-01", "2000-03-31")
PURCHASE_RANGE = ("2000-01-01", "2000-01-31")
WATER_RANGE = ("2024-01-05", "2024-01-10")

query("sales_report", f"""
    SELECT o.order_id AS "Order ID", c.customer_name AS "Customer",
           strftime(o.created_at, '%A %-d %B %Y') AS "Date", o.status AS "Status",
           CAST(o.price AS DOUBLE) AS "Amount", o.quantity AS "Quantity"
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.status IN ('Completed', 'Delivered')
      AND CAST(o.created_at AS DATE) BETWEEN DATE '{SALES_RANGE[0]}' AND DATE '{SALES_RANGE[1]}'""")(
    lambda t: RP.rows(RP.sales_report(t, *SALES_RANGE)))
query("sales_report_all", """
    SELECT o.order_id AS "Order ID", c.customer_name AS "Customer",
           strftime(o.created_at, '%A %-d %B %Y') AS "Date", o.status AS "Status",
           CAST(o.price AS DOUBLE) AS "Amount", o.quantity AS "Quantity"
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.status IN ('Completed', 'Delivered')""")(
    lambda t: RP.rows(RP.sales_report(t, SALES_RANGE[0], None)))
query("purchase_report", f"""
    SELECT so.supply_order_id AS "Order ID", s.name AS "Supplier Name", i.name AS "Item Name",
           so.quantity AS "Quantity", CAST(so.price AS DOUBLE) AS "Price", so.status AS "Status",
           so.order_date AS "Order Date"
    FROM so JOIN su s ON so.supplier_id = s.supplier_id JOIN inv i ON so.item_id = i.item_id
    WHERE so.order_date BETWEEN TIMESTAMP '{PURCHASE_RANGE[0]}' AND TIMESTAMP '{PURCHASE_RANGE[1]}'""")(
    lambda t: RP.rows(RP.purchase_report(t, *PURCHASE_RANGE)))
query("water_report", f"""
    SELECT Pond_ID AS "Pond ID", strftime(Updated_at, '%A, %d %B %Y') AS "Date",
           strftime(Updated_at, '%H') || '.00' AS "Time", Water_Level AS "Water level",
           pH AS "pH level", TDS AS "Salinity level", WaterTemp AS "Temperature"
    FROM sd WHERE CAST(Updated_at AS DATE) BETWEEN DATE '{WATER_RANGE[0]}' AND DATE '{WATER_RANGE[1]}'""")(
    lambda t: RP.rows(RP.water_report(t, *WATER_RANGE)))
query("inventory_report", """
    SELECT item_id AS "ID", name AS "Item Name", quantity AS "Quantity",
           strftime(date, '%A %-d %B %Y') AS "Last Update"
    FROM inv""")(RP.inventory_report)
