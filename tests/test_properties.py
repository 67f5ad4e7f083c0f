"""Property tests: for every change rule, accepted + rejected
= requests, and no request is both; inserts get dense new ids."""

import duckdb
import pytest
from pyspark.sql import functions as F

from farmspark.operators import changes as C
from farmspark.registry import oracle_queries, spark_queries
from farmspark.sources import change_feeds as CF
from farmspark.sources.tables import Tables
from tests.conftest import SF_SMALL

RULES = {
    "insert_orders": (C.insert_orders, CF.orders_form, "order_id"),
    "place_orders": (C.place_orders, CF.app_orders, "order_id"),
    "insert_supply_orders": (C.insert_supply_orders, CF.purchase_form, "supply_order_id"),
    "insert_inventory": (C.insert_inventory, CF.item_form, "item_id"),
    "stock_changes": (C.stock_changes, CF.stock_moves, None),
    "set_approval": (C.set_approval, CF.approvals, None),
    "set_order_status": (C.set_order_status, CF.status_changes, None),
    "set_assigned_by": (C.set_assigned_by, CF.assignments, None),
    "set_supply_status": (C.set_supply_status, CF.supply_status, None),
    "set_supply_status_owned": (C.set_supply_status_owned, CF.supply_status_owned, None),
    "update_workers": (C.update_workers, CF.worker_updates, None),
    "delete_workers": (C.delete_workers, CF.worker_deletes, None),
    "complete_tasks": (C.complete_tasks, CF.task_completions, None),
}


@pytest.fixture(scope="module")
def t(spark):
    return Tables.from_driver(spark, SF_SMALL)


@pytest.mark.parametrize("rule", sorted(RULES))
def test_accepted_plus_rejected_is_input(t, rule):
    apply, feed, new_id = RULES[rule]
    ch = feed(t)
    res = apply(t, ch)
    acc = res.accepted.select("seq")
    rej = res.rejects.select("seq")
    assert acc.count() + rej.count() == ch.count()
    assert acc.join(rej, "seq", "inner").count() == 0
    if new_id:
        base_max = getattr(t, {"order_id": "customer_order", "supply_order_id": "supply_orders",
                               "item_id": "inventory"}[new_id]).agg(F.max(new_id)).first()[0]
        ids = sorted(r[0] for r in res.accepted.select(new_id).collect())
        assert ids == list(range(base_max + 1, base_max + 1 + len(ids)))


def test_registration_partitions_requests(t):
    ch = CF.signups(t)
    res = C.register_accounts(t, ch)
    n = sum(r.accepted.count() + r.rejects.count() for r in res.values())
    assert n == ch.count()


def test_updates_keep_row_count(t):
    for rule in ("set_approval", "set_order_status", "set_supply_status", "update_workers", "complete_tasks"):
        apply, feed, _ = RULES[rule]
        res = apply(t, feed(t))
        base = {"set_approval": t.customer_order, "set_order_status": t.customer_order,
                "set_supply_status": t.supply_orders, "update_workers": t.worker, "complete_tasks": t.task}[rule]
        assert res.table.count() == base.count(), rule


def test_every_event_is_a_delete_request(t):
    ch = CF.worker_deletes(t)
    assert ch.count() == t.raw("events").count()
    res = C.delete_workers(t, ch)
    named = {r.id for r in ch.join(t.worker.select("id"), "id", "left_semi").collect()}
    assert {r.id for r in res.accepted.select("id").collect()} == named
    assert 0 < res.table.count() == t.worker.count() - len(named) < t.worker.count()


def test_every_delete_that_does_nothing_is_rejected(t):
    ch = CF.worker_deletes(t)
    res = C.delete_workers(t, ch)
    n = res.rejects.count()
    assert n == t.raw("events").count() - res.accepted.count()
    # unknown ids and repeats both occur
    unknown = ch.join(t.worker.select("id"), "id", "left_anti").count()
    assert 0 < unknown < n


def test_delete_rejects_cover_all_events_in_code_and_sql(spark, tmp_path):
    """40 requests on 10 workers (0 to 9): 3 workers go, 37 requests are
    rejected, late events as well as early ones."""
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, 'Supplier#' || i AS s_name FROM range(10) r(i)")
    con.execute("CREATE TABLE events AS SELECT i + 1 AS event_id FROM range(40) r(i)")
    for name in ("supplier", "events"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    gone, want = set(), []
    for e in range(1, 41):
        i = e * CF.SPREAD % 11 * 3 + 1
        if i < 10 and i not in gone:
            gone.add(i)
        else:
            want.append((e, "Worker not found"))
    assert len(want) == 37
    assert sorted(con.execute(oracle_queries()["delete_workers_rejects"]).fetchall()) == want
    got = spark_queries()["delete_workers_rejects"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == want
