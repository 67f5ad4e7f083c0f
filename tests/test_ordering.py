"""SURVEY §5.3: the driver compares without order, so the reference's ORDER BY
is asserted here for every ordered read, aggregate and report."""

import calendar

import pytest

from farmspark.operators import metrics as M
from farmspark.operators import reads as R
from farmspark.operators import reports as RP
from farmspark.sources import feeds
from farmspark.sources.tables import Tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def t(spark):
    return Tables.from_driver(spark, SF_SMALL)


def _desc_nulls_last(vals):
    present = [v for v in vals if v is not None]
    return present == sorted(present, reverse=True) and all(v is None for v in vals[len(present):])


CASES = {
    "approved_orders": (lambda t: R.approved_orders(t, ordered=True), "created_at", "desc"),
    "customer_orders": (lambda t: R.customer_orders(t, feeds.customer_keys(t), ordered=True), "created_at", "desc"),
    "supply_orders_all": (lambda t: R.supply_orders_all(t, ordered=True), "order_date", "desc"),
    "order_table": (lambda t: R.order_table(t, ordered=True), "Date", "desc"),
    "sales_records": (lambda t: R.sales_records(t, ordered=True), "Order_Date", "desc"),
    "purchased_items": (lambda t: R.purchased_items(t, ordered=True), "order_date", "desc"),
    "supplier_orders": (lambda t: R.supplier_orders(t, feeds.supplier_keys(t), ordered=True), "order_date", "desc"),
    "worker_tasks": (lambda t: R.worker_tasks(t, feeds.worker_emails(t), ordered=True), "created_date", "asc"),
    "qty_daily": (lambda t: M.qty_daily(t, 2001, ordered=True), "day", "asc"),
    "qty_monthly": (lambda t: M.qty_monthly(t, 2001, ordered=True), "month", "asc"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_single_key_order(t, name):
    fn, col, direction = CASES[name]
    vals = [r[col] for r in fn(t).collect()]
    assert vals, name
    if direction == "desc":
        assert _desc_nulls_last(vals), name
    else:
        assert vals == sorted(vals), name


def test_two_key_orders(t):
    w = [(r.year, r.week) for r in M.qty_weekly(t, 2001, ordered=True).collect()]
    assert w == sorted(w)
    f = [(r.Pond_ID, r.feeding_sec) for r in R.feeding_timetable(t, ordered=True).collect()]
    assert f == sorted(f)


def test_month_name_orders_are_calendar(t):
    months = list(calendar.month_name)[1:]
    for df in (M.revenue_by_month_name(t, ordered=True), M.sales_count_by_month_name(t, ordered=True)):
        got = [r.month for r in df.collect() if r.month is not None]
        assert got == [m for m in months if m in got]


def test_sensor_view_and_reports_newest_first(t):
    dates = [r.Date for r in R.sensor_data_view(t, ordered=True).collect()]
    assert _desc_nulls_last(dates)  # yyyy/MM/dd sorts as text
    created = {r.order_id: r.created_at for r in t.customer_order.select("order_id", "created_at").collect()}
    ids = [r["Order ID"] for r in RP.sort_report(RP.sales_report(t)).collect()]
    assert _desc_nulls_last([created[i] for i in ids])
    placed = {}
    for r in t.supply_orders.select("supply_order_id", "order_date").collect():
        placed.setdefault(r.supply_order_id, set()).add(r.order_date)
    rows = RP.sort_report(RP.purchase_report(t)).collect()
    assert _desc_nulls_last([r["Order Date"] for r in rows])
    assert all(r["Order Date"] in placed[r["Order ID"]] for r in rows)
