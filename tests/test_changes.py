"""C-* rules: reject reasons in check order, multi-change semantics, ids,
and the accepted + rejected = input property."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from farmspark.operators import changes as C

D = dt.date(2024, 1, 1)


def _inventory():
    return [(1, "tiger", "prawns", 10, 5, D), (2, "feed", "feed", None, 5, D), (3, "net", "gear", 0, None, D)]


def test_stock_reasons_and_effects(tables, spark):
    t = tables(inventory=_inventory())
    rows = [
        (1, "issue", "1", "3", "2024-02-01"),      # ok
        (2, "receive", "1", "5", "2024-02-03"),    # ok, last date
        (3, "issue", "1", "0", "2024-02-02"),      # text "0" is accepted
        (4, "issue", "x", "1", "2024-02-01"),      # bad id
        (5, "issue", "2", "", "2024-02-01"),       # empty qty
        (6, "issue", "2", "abc", "2024-02-01"),    # non-numeric
        (7, "issue", "2", "12abc", "2024-02-01"),  # JS isNaN -> rejected
        (8, "issue", "2", "-1", "2024-02-01"),     # negative
        (9, "issue", "2", "3.7", None),            # no date
        (10, "issue", "9", "1", "2024-02-01"),     # unknown item
        (11, "issue", "2", "3.7", "2024-02-05"),   # NULL stock stays NULL, 3.7 -> 3
        (12, "issue", "3", "4", "2024-02-06"),     # may go negative
        (13, "issue", " 3abc", None, "2024-02-06"),  # id parses as 3, qty missing
    ]
    ch = spark.createDataFrame(rows, "seq long, kind string, item_id string, qty string, date string")
    res = C.stock_changes(t, ch)
    rej = {r.seq: r.reason for r in res.rejects.collect()}
    q = "Valid quantity is required (must be a positive number)"
    assert rej == {4: "Valid item ID is required", 5: q, 6: q, 7: q, 8: q, 9: "Date is required",
                   10: "Item not found", 13: q}
    tab = {r.item_id: (r.quantity, r.date) for r in res.table.collect()}
    assert tab[1] == (10 - 3 + 5 - 0, dt.date(2024, 2, 2))  # date of the last change by seq
    assert tab[2] == (None, dt.date(2024, 2, 5))
    assert tab[3] == (-4, dt.date(2024, 2, 6))
    assert res.accepted.count() + res.rejects.count() == ch.count()


def test_stock_conservation(spark):
    from farmspark.sources import change_feeds as CF
    from farmspark.sources.tables import Tables
    from tests.conftest import SF_SMALL
    t = Tables.from_driver(spark, SF_SMALL)
    ch = CF.stock_moves(t)
    res = C.stock_changes(t, ch)
    before = t.inventory.agg(F.sum("quantity")).first()[0]
    after = res.table.agg(F.sum("quantity")).first()[0]
    acc = res.accepted
    delta = acc.agg(F.sum(F.when(F.col("kind") == "issue", -F.col("_qty")).otherwise(F.col("_qty")))).first()[0]
    null_items = {r.item_id for r in t.inventory.where(F.col("quantity").isNull()).collect()}
    assert not null_items
    assert after == before + (delta or 0)
    assert acc.count() + res.rejects.count() == ch.count()


def test_approval_rules(tables, spark):
    order = (1, 1, "Tiger", 1, Decimal("1.00"), "New", None, None, None, None, dt.datetime(2024, 1, 1), None)
    t = tables(customer_order=[order, (2,) + order[1:]])
    ch = spark.createDataFrame([(1, 1, "approved"), (2, 1, "rejected"), (3, 2, "Approved"), (4, 2, ""),
                                (5, 7, "approved"), (6, 2, None)], "seq long, order_id long, action string")
    res = C.set_approval(t, ch)
    assert {r.seq: r.reason for r in res.rejects.collect()} == {
        3: "Invalid action", 4: "Invalid action", 5: "Order not found", 6: "Invalid action"}
    tab = {r.order_id: r.approved_or_rejected for r in res.table.collect()}
    assert tab == {1: "Rejected", 2: None}  # last writer wins


def test_update_touches_every_row_with_key(tables, spark):
    so = [(10, 1, 1, 1, Decimal("1.00"), "New", None), (10, 2, 1, 1, Decimal("1.00"), "New", None),
          (11, 1, 1, 1, Decimal("1.00"), "New", None)]
    t = tables(supply_orders=so)
    ch = spark.createDataFrame([(1, 10, "Shipped"), (2, 10, "Delivered"), (3, 0, "x"), (4, 99, "Lost")],
                               "seq long, supply_order_id long, status string")
    res = C.set_supply_status(t, ch)
    assert sorted(r.status for r in res.table.collect()) == ["Delivered", "Delivered", "New"]
    assert [r.seq for r in res.rejects.collect()] == [3]
    owned = spark.createDataFrame([(1, 10, 2, "Shipped"), (2, 11, 2, "Shipped")],
                                  "seq long, supply_order_id long, supplier_id long, status string")
    res2 = C.set_supply_status_owned(t, owned)
    assert sorted((r.supplier_id, r.status) for r in res2.table.where("supply_order_id = 10").collect()) == [
        (1, "New"), (2, "Shipped")]
    assert {r.seq: r.reason for r in res2.rejects.collect()} == {
        2: "Order not found or not owned by this supplier"}


def test_insert_ids_are_dense_after_max(tables, spark):
    order = (41, 1, "Tiger", 1, Decimal("1.00"), "New", None, None, None, None, dt.datetime(2024, 1, 1), None)
    t = tables(customer_order=[order])
    ch = spark.createDataFrame(
        [(5, 1, "Tiger", 2, Decimal("3.00"), None, dt.datetime(2024, 1, 2)),
         (3, 1, "King", 2, Decimal("3.00"), "New", dt.datetime(2024, 1, 2)),
         (4, 0, "King", 2, Decimal("3.00"), "", dt.datetime(2024, 1, 2)),     # customer 0 is falsy
         (9, 1, "", 2, Decimal("3.00"), "", dt.datetime(2024, 1, 2)),
         (7, 1, "White", 1, Decimal("3.00"), "", dt.datetime(2024, 1, 2))],
        "seq long, customer_id long, prawn_type string, quantity int, price decimal(12,2), status string, "
        "created_at timestamp_ntz")
    res = C.insert_orders(t, ch)
    got = {r.seq: (r.order_id, ) for r in res.accepted.collect()}
    assert got == {3: (42,), 5: (43,), 7: (44,)}
    st = {r.order_id: r.status for r in res.table.collect()}
    assert st[42] == "New" and st[43] == "Processing" and st[44] == "Processing"


def test_dense_ids_across_buckets(spark):
    from farmspark.plans.ids import dense_ids
    df = spark.range(0, 50).select((F.col("id") * 7 + 3).alias("seq"))
    got = dense_ids(df, F.lit(100), "nid", parts=5).orderBy("seq").collect()
    assert [r.nid for r in got] == list(range(101, 151))
    # clock-like numbers, far apart
    df = spark.range(0, 300).select((F.col("id") * 3_000_000_017 + 5).alias("seq"))
    out = dense_ids(df, F.lit(None).cast("long"), "nid", parts=5)
    assert [r.nid for r in out.orderBy("seq").collect()] == list(range(1, 301))


def test_delete_and_registration_first_writer(tables, spark):
    t = tables(worker=[(1, "A", "a@x", "07001"), (2, "B", "b@x", "07002")],
               customer=[(1, "C", "0000000001", "c@x")])
    dele = spark.createDataFrame([(1, 1), (2, 1), (3, 5)], "seq long, id long")
    res = C.delete_workers(t, dele)
    assert [r.id for r in res.table.collect()] == [2]
    assert {r.seq for r in res.rejects.collect()} == {2, 3}
    sign = spark.createDataFrame([
        (1, "customer", " New ", " n@x ", "1"), (2, "customer", "Dup", "n@x", "2"),
        (3, "customer", "Old", "c@x", "3"), (4, "customer", "", "e@x", "4"),
        (5, "worker", "W", "w@x", "07001"), (6, "worker", "W2", "a@x", "09000"),
        (7, "worker", "W3", "w3@x", "09001"), (8, "worker", "W4", "w3@x", "09002")],
        "seq long, kind string, name string, email string, mobile_no string")
    r = C.register_accounts(t, sign)
    assert {x.seq: x.reason for x in r["customer"].rejects.collect()} == {
        2: "Email already exists", 3: "Email already exists", 4: "All fields are required"}
    new = r["customer"].table.where("customer_id = 2").first()
    assert (new.customer_name, new.email) == ("New", "n@x")  # trimmed
    assert {x.seq: x.reason for x in r["worker"].rejects.collect()} == {
        5: "Mobile number already exists", 6: "Email already registered as a user",
        8: "Email already registered as a user"}
    assert [x.worker_code for x in r["worker"].accepted.collect()] == ["PF3"]


def test_complete_tasks_reasons(tables, spark):
    t = tables(worker=[(1, "A", "a@x", "1"), (2, "B", "b@x", "2")],
               task=[(0, "t", "d", 1, "pending", dt.datetime(2024, 1, 1)),
                     (5, "t", "d", 2, "pending", dt.datetime(2024, 1, 1))])
    ch = spark.createDataFrame([(1, 0, "a@x"), (2, None, "a@x"), (3, 5, "zz@x"), (4, 5, "a@x")],
                               "seq long, task_id long, email string")
    res = C.complete_tasks(t, ch)
    assert {r.seq: r.reason for r in res.rejects.collect()} == {
        2: "Task ID is required", 3: "Worker not found", 4: "Task not found or not assigned to this worker"}
    assert {r.task_id: r.status for r in res.table.collect()} == {0: "completed", 5: "pending"}


def test_touched_rows_are_written_for_the_table_only(tables, spark, monkeypatch):
    """Rejects and notices do not need the new table: nothing is written for it
    until it is asked for."""
    t = tables(worker=[(1, "W", "w@x", "07")], task=[(5, "a", "b", 1, "pending", dt.datetime(2024, 1, 1))])
    ch = spark.createDataFrame([(1, 5, "w@x"), (2, 6, "w@x")], "seq long, task_id long, email string")
    written = []
    monkeypatch.setattr(C, "_small", lambda df, bounded=False: written.append(df.columns) or df)
    res = C.complete_tasks(t, ch)
    assert [r.seq for r in res.rejects.collect()] == [2] and not written
    assert [r.status for r in res.table.collect()] == ["completed"] and len(written) == 1
    gone = C.delete_workers(t, spark.createDataFrame([(1, 1), (2, 1)], "seq long, id long"))
    assert [r.seq for r in gone.rejects.collect()] == [2] and len(written) == 1
    assert gone.table.isEmpty() and len(written) == 2
