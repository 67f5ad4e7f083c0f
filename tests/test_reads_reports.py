"""T-6 … T-11 and ordering of the reads and reports."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from farmspark.operators import metrics as M
from farmspark.operators import reads as R
from farmspark.operators import reports as RP

T0 = dt.datetime(2024, 1, 1)


def _readings():
    d = lambda day, h=0: dt.datetime(2024, 1, day, h)
    return [
        (1, 10.0, 7.0, 25.0, 50.0, d(2)),   # pond 1: two rows tie on the latest time
        (1, 20.0, None, 27.0, 60.0, d(2)),
        (1, 99.0, 9.0, 30.0, 70.0, d(1)),
        (2, 5.0, 6.0, 20.0, 10.0, None),    # pond 2: only NULL time -> vanishes
        (None, 50.0, 6.5, 21.0, 11.0, d(5)),  # NULL pond -> vanishes
        (3, 8.0, 8.0, 22.0, 12.0, d(3)),    # pond 3: one NULL time, one real
        (3, 1.0, 1.0, 1.0, 1.0, None),
    ]


def test_latest_per_pond_ties_and_nulls(tables):
    t = tables(sensors_data=_readings())
    got = sorted((r.Pond_ID, r.Water_Level) for r in R.latest_per_pond(t).collect())
    assert got == [(1, 10.0), (1, 20.0), (3, 8.0)]


def test_latest_per_pond_without_broadcast(tables):
    t = tables(sensors_data=_readings())
    got = sorted((r.Pond_ID, r.Water_Level) for r in R.latest_per_pond(t, broadcast_bytes=0).collect())
    assert got == [(1, 10.0), (1, 20.0), (3, 8.0)]


def test_pond_averages_weigh_ties(tables):
    t = tables(sensors_data=_readings())
    r = M.pond_averages(t).first()
    assert r.average_water_level == round((10 + 20 + 8) / 3, 2)
    assert r.average_pH == round((7 + 8) / 2, 2)  # NULL pH ignored
    assert M.averages_text(M.pond_averages(t)).first().average_temperature == "24.67"


def _orders():
    base = dict(customer_id=1, prawn_type="Tiger", quantity=10, price=Decimal("100.00"),
                approved_or_rejected=None, payment_receipt=None, address=None, assigned_by=None,
                updated_at=None)
    rows = []
    for i, (st, ts) in enumerate([("Completed", dt.datetime(2000, 1, 1, 0, 0)),
                                  ("Delivered", dt.datetime(2000, 1, 31, 0, 0)),
                                  ("Delivered", dt.datetime(2000, 1, 31, 0, 1)),
                                  ("Completed", dt.datetime(2000, 1, 31, 23, 59)),
                                  ("Completed", dt.datetime(2000, 2, 1, 0, 0)),
                                  ("New", dt.datetime(2000, 1, 15))]):
        rows.append(dict(base, order_id=i, status=st, created_at=ts))
    cols = ["order_id", "customer_id", "prawn_type", "quantity", "price", "status", "approved_or_rejected",
            "payment_receipt", "address", "assigned_by", "created_at", "updated_at"]
    return [tuple(r[c] for c in cols) for r in rows]


def test_sales_report_keeps_whole_end_day(tables):
    t = tables(customer_order=_orders(), customer=[(1, "Ann", "0000000001", "ann@x")])
    ids = sorted(r["Order ID"] for r in RP.rows(RP.sales_report(t, "2000-01-01", "2000-01-31")).collect())
    assert ids == [0, 1, 2, 3]  # T-6: sales keeps 23:59 of the end day, drops Feb 1


def test_half_given_range_is_ignored(tables):
    t = tables(customer_order=_orders(), customer=[(1, "Ann", "0000000001", "ann@x")])
    assert RP.rows(RP.sales_report(t, "2000-01-01", None)).count() == 5  # T-7


def test_purchase_report_cuts_end_day_at_midnight(tables):
    so = [(i, 1, 1, 1, Decimal("1.00"), "New", ts) for i, ts in enumerate(
        [dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 31, 0, 0), dt.datetime(2000, 1, 31, 0, 1),
         dt.datetime(2000, 1, 31, 23, 59), dt.datetime(2000, 2, 1)])]
    t = tables(supply_orders=so, supplier=[(1, "S", "s@x", "1")],
               inventory=[(1, "item", "prawns", 5, 1, dt.date(2024, 1, 1))])
    ids = sorted(r["Order ID"] for r in RP.rows(RP.purchase_report(t, "2000-01-01", "2000-01-31")).collect())
    assert ids == [0, 1]


def test_report_sort_is_newest_first(tables):
    t = tables(customer_order=_orders(), customer=[(1, "Ann", "0000000001", "ann@x")])
    ids = [r["Order ID"] for r in RP.sort_report(RP.sales_report(t)).collect()]
    assert ids == [4, 3, 2, 1, 0]
    dates = [r["Date"] for r in RP.sort_report(RP.sales_report(t)).collect()]
    assert dates[-1] == "Saturday 1 January 2000"


def test_ordered_reads(tables):
    t = tables(customer_order=_orders(), customer=[(1, "Ann", "0000000001", "ann@x")])
    got = [r.Date for r in R.order_table(t, ordered=True).collect()]
    assert got == sorted(got, reverse=True)
    months = [r.month for r in M.sales_count_by_month_name(t, ordered=True).collect()]
    assert months == ["January", "February"]


def test_monthly_weekly_daily_totals_agree(spark):
    from farmspark.sources.tables import Tables
    from tests.conftest import SF_SMALL
    t = Tables.from_driver(spark, SF_SMALL)
    tot = lambda df: df.agg(F.sum("total_quantity")).first()[0]
    assert tot(M.qty_daily(t, 2001)) == tot(M.qty_weekly(t, 2001)) == tot(M.qty_monthly(t, 2001))


@pytest.mark.parametrize("start,end,n", [("2000-01-01", "2000-01-01", 1), ("2000-01-31", "2000-01-31", 3)])
def test_day_bounds(tables, start, end, n):
    t = tables(customer_order=_orders(), customer=[(1, "Ann", "0000000001", "ann@x")])
    assert RP.rows(RP.sales_report(t, start, end)).count() == n


def test_month_groups_merge_years_and_null_first(tables):
    """T-3: months of different years merge; a NULL date is its own group, first."""
    rows = _orders()
    extra = list(rows[0])
    extra[0], extra[10] = 99, None  # order without a date
    extra2 = list(rows[0])
    extra2[0], extra2[10] = 98, dt.datetime(2001, 1, 5)
    t = tables(customer_order=rows + [tuple(extra), tuple(extra2)])
    got = [(r.month, r.revenue) for r in M.sales_count_by_month_name(t, ordered=True).collect()]
    assert got == [(None, 1), ("January", 5), ("February", 1)]


def test_low_stock_null_threshold_never_counts(tables):
    """T-13: quantity < threshold + 25; a NULL threshold never counts."""
    inv = [(1, "a", "prawns", 10, None, dt.date(2024, 1, 1)),
           (2, "b", "prawns", 30, 10, dt.date(2024, 1, 1)),
           (3, "c", "prawns", 40, 10, dt.date(2024, 1, 1))]
    assert M.low_stock_count(tables(inventory=inv)).first().lowStockItems == 1
