"""Plan checks: no cartesian / nested-loop join anywhere, no
Python execution node outside the reminder state function, pushed range
filters on stored timestamp columns, partial aggregation before shuffles."""

import pytest

from farmspark.operators import changes as C
from farmspark.operators import metrics as M
from farmspark.operators import reports as RP
from farmspark.plans import jobs
from farmspark.registry import spark_queries
from farmspark.sources.tables import Tables
from tests.conftest import SF_SMALL
from tests.plan_util import explain_text

PY_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
STREAM_KEYS = {"reminder_fire", "reminder_open_state"}  # its result is read back from the stream's sink


@pytest.mark.parametrize("name", sorted(spark_queries()))
def test_no_cartesian_or_python(spark, name):
    plan = explain_text(spark_queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    if name not in STREAM_KEYS:
        assert not any(n in plan for n in PY_NODES), name


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("snap"))
    jobs.write_snapshot(Tables.from_driver(spark, SF_SMALL), root)
    return Tables.from_snapshot(spark, root)


def test_report_range_reaches_scan(snapshot):
    plan = explain_text(RP.sales_report(snapshot, "2000-01-01", "2000-03-31"))
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln and "created_at" in ln]
    assert pushed and "GreaterThanOrEqual(created_at" in pushed[0] and "LessThan(created_at" in pushed[0]
    assert "In(status" in plan or "In(status," in plan
    parts = [ln for ln in plan.splitlines() if "PartitionFilters" in ln and "ym" in ln]
    assert parts and "200001" in parts[0] and "200003" in parts[0]  # month folders pruned


def test_year_filter_reaches_scan(snapshot):
    plan = explain_text(M.qty_monthly(snapshot, 2001))
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln]
    assert any("created_at" in ln for ln in pushed)
    assert "ReadSchema: struct<quantity:int,created_at:timestamp_ntz>" in plan


def test_stock_reduction_is_partial_before_shuffle(spark, snapshot, monkeypatch):
    """The per-item reduction, which is written once, aggregates on the map side."""
    from farmspark.plans import broadcast as B
    from farmspark.sources import change_feeds as CF
    written = []
    whole = B.materialized
    monkeypatch.setattr(B, "materialized", lambda df, *a: written.append(explain_text(df)) or whole(df, *a))
    C.stock_changes(snapshot, CF.stock_moves(Tables.from_driver(spark, SF_SMALL)))
    plans = [p for p in written if "sum(_delta" in p]
    assert plans and all("partial_sum(_delta" in p and p.count("HashAggregate") + p.count("SortAggregate") >= 2 for p in plans)


def test_hot_key_third_of_rows(spark, tables):
    """One item receives a third of all stock changes: the result stays
    exact and whole (no rows dropped, no cap)."""
    import datetime as dt
    t = tables(inventory=[(1, "a", "prawns", 0, 1, dt.date(2024, 1, 1)),
                          (2, "b", "prawns", 0, 1, dt.date(2024, 1, 1))])
    n = 30_000
    ch = (spark.range(n).selectExpr("id AS seq", "'receive' AS kind",
                                    "CASE WHEN id % 3 = 0 THEN '1' ELSE '2' END AS item_id",
                                    "'1' AS qty", "'2024-02-01' AS date"))
    res = C.stock_changes(t, ch)
    got = {r.item_id: r.quantity for r in res.table.collect()}
    assert got == {1: n // 3, 2: n - n // 3}
