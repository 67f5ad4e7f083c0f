"""Snapshot jobs (checkpointed batch), SNK-1 / SNK-2 / SNK-5 sinks."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from farmspark.operators import changes as C
from farmspark.operators import reports as RP
from farmspark.plans import jobs
from farmspark.plans import snapshots as S
from farmspark.plans.sinks import outbox, write_report, write_rows
from farmspark.sources import change_feeds as CF
from farmspark.sources.tables import Tables
from farmspark.streaming.sensor_ingest import start_ingest
from tests.conftest import SF_SMALL


def _snapshot(spark, root):
    t = Tables.from_driver(spark, SF_SMALL)
    jobs.write_snapshot(t, root)
    return t


def test_apply_batch_matches_in_memory(spark, tmp_path):
    snap, out, ob = str(tmp_path / "snap"), str(tmp_path / "out"), str(tmp_path / "outbox")
    t = _snapshot(spark, snap)
    ch_path = str(tmp_path / "changes")
    CF.status_changes(t).write.parquet(ch_path)
    paths = jobs.apply_batch(spark, snap, ch_path, "set_order_status", out, ob)
    new = Tables.from_snapshot(spark, out).customer_order
    mem = C.set_order_status(Tables.from_snapshot(spark, snap), spark.read.parquet(ch_path))
    assert new.exceptAll(mem.table).count() == 0 and mem.table.exceptAll(new).count() == 0
    rej = spark.read.parquet(paths["rejects"])
    assert rej.count() + mem.accepted.count() == spark.read.parquet(ch_path).count()
    msgs = spark.read.parquet(ob)
    assert msgs.count() > 0 and msgs.select("kind").distinct().collect()[0].kind == "order_status"


def test_register_batch_writes_all_kinds(spark, tmp_path):
    snap, out = str(tmp_path / "snap"), str(tmp_path / "out")
    t = _snapshot(spark, snap)
    ch_path = str(tmp_path / "signups")
    CF.signups(t).write.parquet(ch_path)
    paths = jobs.register_batch(spark, snap, ch_path, out, str(tmp_path / "ob"))
    for name in ("customer", "supplier", "worker", "users"):
        assert os.path.exists(paths[name])
    new = Tables.from_snapshot(spark, out)
    assert new.customer.count() == t.customer.count() + spark.read.parquet(paths["customer"]).count()


def test_batches_chain_and_leave_other_months_alone(spark, tmp_path):
    root, ob = str(tmp_path / "snap"), str(tmp_path / "outbox")
    t = _snapshot(spark, root)
    before = S.latest(spark, root)[1]["customer_order"]
    one = t.customer_order.where("created_at is not null").orderBy("order_id").first()
    month = one.created_at.year * 100 + one.created_at.month
    spark.createDataFrame([(1, one.order_id, "Moved")], "seq long, order_id long, status string").write.parquet(
        str(tmp_path / "b1"))
    jobs.apply_batch(spark, root, str(tmp_path / "b1"), "set_order_status", root, ob)
    version, parts = S.latest(spark, root)
    assert version == 2 and set(parts) == set(S.latest(spark, root)[1])
    old, new = parts["customer_order"]
    assert old["path"] == before[0]["path"] and new["months"] == [month] and old["gone"] == [month]
    assert old["months"] == [m for m in before[0]["months"] if m != month]
    # an order placed on the new version; customers and messages come with it
    CF.app_orders(t).limit(40).write.parquet(str(tmp_path / "b2"))
    for _ in range(2):  # a retried batch: one version, one part, its messages once
        paths = jobs.apply_batch(spark, root, str(tmp_path / "b2"), "place_orders", root, ob)
        placed = spark.read.parquet(paths["table"]).count()
        msgs = spark.read.parquet(ob).where("kind = 'new_order'").count()
        assert placed == msgs > 0 and S.latest(spark, root)[0] == 3
    after = Tables.from_snapshot(spark, root)
    assert after.customer_order.count() == t.customer_order.count() + placed
    assert after.customer_order.where(F.col("order_id") == one.order_id).first().status == "Moved"
    # readings streamed in are seen by the dated report beside the stored ones
    src = tmp_path / "docs"
    src.mkdir()
    (src / "a.json").write_text('{"waterLevelInside": 3.5, "waterTemp": 21, "tds": 40}\nnull\n5\n{"x"\n')
    for _ in range(2):  # a restart finds nothing new
        start_ingest(spark, str(src), root, str(tmp_path / "ck")).awaitTermination()
    now = Tables.from_snapshot(spark, root)
    assert now.sensors_data.count() == t.sensors_data.count() + 1
    assert spark.read.parquet(root + "/_rejects/sensor_ingest").count() == 3
    day = now.sensors_data.agg(F.max("Updated_at")).first()[0].strftime("%Y-%m-%d")
    assert RP.rows(RP.water_report(now, day, day)).count() == 1
    whole = RP.rows(RP.water_report(now, "1990-01-01", day)).count()
    assert whole == t.sensors_data.where("Updated_at is not null").count() + 1
    # the months of all parts in one again
    jobs.compact(spark, root, "customer_order")
    again = Tables.from_snapshot(spark, root).customer_order
    assert again.exceptAll(after.customer_order).count() == 0 and again.count() == after.customer_order.count()


def test_a_version_is_published_once(spark, tmp_path):
    root = str(tmp_path / "snap")
    empty = S.Manifest()
    S.commit(spark, root, empty, [])
    with pytest.raises(S.Conflict):
        S.commit(spark, root, empty, [], rebase=False)
    assert S.commit(spark, root, empty, []).version == 2 and S.versions(spark, root) == [1, 2]


def test_plain_folders_are_adopted(spark, tmp_path):
    plain, out = str(tmp_path / "plain"), str(tmp_path / "out")
    t = Tables.from_driver(spark, SF_SMALL)
    t.inventory.write.parquet(plain + "/inventory")
    t.worker.write.parquet(plain + "/worker")
    CF.stock_moves(t).write.parquet(str(tmp_path / "moves"))
    jobs.apply_batch(spark, plain, str(tmp_path / "moves"), "stock_changes", out)
    new = Tables.from_snapshot(spark, out)
    assert new.worker.count() == t.worker.count() and new.inventory.count() == t.inventory.count()


def test_running_totals_beyond_the_column_fail_their_request(spark, tables):
    t = tables(inventory=[(1, "a", "x", 2_000_000_000, None, None), (2, "b", "x", 5, None, None),
                          (3, "c", "x", None, None, None)])
    moves = [(1, "receive", "1", "100000000"), (2, "receive", "1", "100000000"), (3, "issue", "1", "50000000"),
             (4, "receive", "2", "2147483647"), (5, "receive", "2", "7"), (6, "receive", "3", "2147483647")]
    ch = spark.createDataFrame([(*m, "2024-01-01") for m in moves], "seq long, kind string, item_id string, qty string, date string")
    res = C.stock_changes(t, ch)
    assert {r.seq: r.reason for r in res.rejects.collect()} == dict.fromkeys((2, 4), C.STOCK_FAILED)
    assert {r.item_id: r.quantity for r in res.table.collect()} == {1: 2_050_000_000, 2: 12, 3: None}


def test_report_files_in_order(spark, tmp_path):
    t = Tables.from_driver(spark, SF_SMALL)
    out = str(tmp_path / "sales")
    write_report(RP.sales_report(t), out)
    rows = []
    for f in sorted(glob.glob(os.path.join(out, "part-*.csv"))):
        with open(f) as fh:
            rows += list(csv.DictReader(fh))
    assert list(rows[0].keys()) == ["Order ID", "Customer", "Date", "Status", "Amount", "Quantity"]
    ids = [int(r["Order ID"]) for r in rows]
    created = {r.order_id: r.created_at for r in t.customer_order.select("order_id", "created_at").collect()}
    stamps = [created[i] for i in ids]
    dated = [x for x in stamps if x is not None]
    assert stamps == dated + [None] * (len(stamps) - len(dated))  # without a time: last
    stamps = dated
    assert stamps == sorted(stamps, reverse=True) and len(ids) == RP.rows(RP.sales_report(t)).count()


def test_write_rows_and_outbox(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x@y", "s", "b")], "kind string, ref_id int, recipient string, "
                                                             "subject string, body string")
    ob = outbox(df, df)
    assert [f.dataType.simpleString() for f in ob.schema.fields] == ["string", "bigint", "string", "string",
                                                                     "string"]
    write_rows(ob, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2


def test_materialized_batch_is_checkpointed(spark):
    t = Tables.from_driver(spark, SF_SMALL)
    seen = []
    with C.materialized_batches(lambda df: seen.append(1) or df.checkpoint(eager=True)):
        res = C.stock_changes(t, CF.stock_moves(t))
    assert seen and res.table.count() == t.inventory.count()
    assert res.table.where(F.col("quantity").isNull()).count() == 0
