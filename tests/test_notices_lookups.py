"""N-* templates, P-15 OR-lookup without nested loops."""

import datetime as dt
from decimal import Decimal

from farmspark.operators import changes as C
from farmspark.operators import lookups as LK
from farmspark.operators import notices as N
from tests.plan_util import explain_text


def test_status_notice_text_and_email_filter(tables, spark):
    o = lambda i, c: (i, c, "Tiger", 1, Decimal("1.00"), "New", None, None, None, None,
                      dt.datetime(2024, 1, 1), None)
    t = tables(customer_order=[o(1, 1), o(2, 2), o(3, 3)],
               customer=[(1, "A", "1", "a@x"), (2, "B", "2", ""), (3, "C", "3", None)])
    ch = spark.createDataFrame([(1, 1, "Shipped"), (2, 2, "Shipped"), (3, 3, "Shipped"), (4, 1, "Done")],
                               "seq long, order_id long, status string")
    acc = C.set_order_status(t, ch).accepted
    rows = sorted(N.order_status_notice(t, acc).collect(), key=lambda r: r.body)
    assert [r.recipient for r in rows] == ["a@x", "a@x"]
    assert rows[0].body == "Your order #1 status has been updated to: Done. Thank you for your business!"
    assert rows[0].subject == "Order Status Update"


def test_welcome_worker_has_no_password_line(tables, spark):
    t = tables(worker=[(4, "A", "a@x", "1")])
    r = C.register_accounts(t, spark.createDataFrame([(1, "worker", "Wanda", "w@x", "9")],
                                                     "seq long, kind string, name string, email string, "
                                                     "mobile_no string"))
    empty = spark.createDataFrame([], "customer_id long, name string, email string")
    body = N.welcome_notice(empty, empty.withColumnRenamed("customer_id", "supplier_id"),
                            r["worker"].accepted).first().body
    assert "User ID: PF5" in body and "Password" not in body


def _accounts(tables):
    return tables(customer=[(1, "ann", "1", "ann@x"), (2, "bob", "2", "ann"), (3, "ann", "3", None)],
                  worker=[(1, "wes", "wes@x", "07")], supplier=[(1, "sue", "sue@x", "1")])


def test_account_lookup_name_or_email(tables, spark):
    t = _accounts(tables)
    h = spark.createDataFrame([("ann",), ("  wes@x ",), ("nobody",), ("sue",)], "handle string")
    got = sorted((r.handle, r.kind, r.id) for r in LK.account_lookup(t, h).collect())
    # 'ann' equals customer 1 and 3 by name and customer 2 by e-mail: each once
    assert got == [("ann", "customer", 1), ("ann", "customer", 2), ("ann", "customer", 3),
                   ("sue", "supplier", 1), ("wes@x", "worker", 1)]


def test_account_lookup_plan_has_no_nested_loop(tables, spark):
    t = _accounts(tables)
    h = spark.createDataFrame([("ann",)], "handle string")
    plan = explain_text(LK.account_lookup(t, h))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_account_lookup_case_insensitive_collation(tables, spark):
    t = _accounts(tables)
    h = spark.createDataFrame([("ANN",), ("Wes@X",)], "handle string")
    assert LK.account_lookup(t, h).count() == 0  # binary by default
    got = sorted((r.handle, r.kind, r.id) for r in LK.account_lookup(t, h, collation="UTF8_LCASE").collect())
    assert got == [("ANN", "customer", 1), ("ANN", "customer", 2), ("ANN", "customer", 3), ("Wes@X", "worker", 1)]
    plan = explain_text(LK.account_lookup(t, h, collation="UTF8_LCASE"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_requests_read_by_several_joins_are_made_once(spark):
    """The messages come from the written requests: neither the events nor the
    owners of the supply orders are gone through again for them."""
    from farmspark.keys import notices_keys as K
    from farmspark.sources.tables import Tables
    t = Tables.from_driver(spark, "/root/testdata/sf0.001")
    for rule in (K.n1, K.n2, K.n4):
        made = rule(t)
        assert not any("events.parquet" in f for f in made.inputFiles()), rule.__name__
        assert made.count() > 0


def test_orders_beyond_the_bound_are_looked_up_once(tables, spark, monkeypatch):
    from farmspark.plans import broadcast as B
    monkeypatch.setattr(B, "KEYS_BROADCAST_BYTES", 0)
    o = lambda i, c: (i, c, "Tiger", 1, Decimal("1.00"), "New", None, None, None, None,
                      dt.datetime(2024, 1, 1), None)
    t = tables(customer_order=[o(1, 1), o(2, 2), o(3, 2)],
               customer=[(1, "A", "1", "a@x"), (2, "B", "2", "b@x"), (2, "B", "2", "c@x"), (3, "C", "3", None)])
    ch = spark.createDataFrame([(1, 1, "Shipped"), (2, 2, "Shipped"), (3, 2, "Done"), (4, 9, "Done")],
                               "seq long, order_id long, status string")
    written = []
    monkeypatch.setattr(N, "materialized", lambda df, name: written.append(name) or B.materialized(df, name))
    res = C.set_order_status(t, ch)
    assert not res.keys_bounded
    rows = N.order_status_notice(t, res.accepted, res.keys_bounded).collect()
    assert sorted((r.ref_id, r.recipient) for r in rows) == [(1, "a@x"), (2, "b@x"), (2, "b@x"), (2, "c@x"), (2, "c@x")]
    assert written == ["orders"]
