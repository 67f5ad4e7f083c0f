"""Versioned snapshots: batches applied once, concurrent publication, parts with
keys, ids looked up by statistics, compaction and expiry."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from farmspark.operators import changes as C
from farmspark.plans import broadcast as B
from farmspark.plans import jobs
from farmspark.plans import snapshots as S
from farmspark.sources import change_feeds as CF
from farmspark.sources.tables import Tables
from farmspark.streaming.sensor_ingest import start_ingest
from tests.conftest import SF_SMALL

SEEN = "seq long, order_id long, status string"


@pytest.fixture()
def root(spark, tmp_path):
    path = str(tmp_path / "snap")
    jobs.write_snapshot(Tables.from_driver(spark, SF_SMALL), path)
    return path


def rows(df):
    return sorted(map(str, df.collect()))


def write(df, path):
    df.write.parquet(str(path))
    return str(path)


# ------------------------------------------------------------- applied once

def test_a_batch_is_applied_once_whatever_its_path(spark, root, tmp_path):
    t = Tables.from_driver(spark, SF_SMALL)
    one = write(CF.stock_moves(t), tmp_path / "day1" / "batch-1")
    again = write(CF.stock_moves(t).repartition(7), tmp_path / "day2" / "batch-9")
    other = write(CF.stock_moves(t).where("seq % 2 = 0"), tmp_path / "day2" / "batch-1")
    first = jobs.apply_batch(spark, root, one, "stock_changes", root)
    state = rows(Tables.from_snapshot(spark, root).inventory)
    for path in (one, again):
        assert jobs.apply_batch(spark, root, path, "stock_changes", root) == first
    assert S.latest(spark, root)[0] == 2 and rows(Tables.from_snapshot(spark, root).inventory) == state
    # another batch under the same folder name leaves the first one's rejects alone
    n = spark.read.parquet(first["rejects"]).count()
    second = jobs.apply_batch(spark, root, other, "stock_changes", root)
    assert second["rejects"] != first["rejects"] and spark.read.parquet(first["rejects"]).count() == n > 0
    assert S.latest(spark, root)[0] == 3 and rows(Tables.from_snapshot(spark, root).inventory) != state


def test_digest_tells_batches_apart(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "x")], "seq long, a string, b string")
    assert jobs.batch_digest(a, "r") == jobs.batch_digest(a.repartition(3), "r")
    others = [a.where("seq = 1"), a.unionAll(a), a.select("seq", F.col("b").alias("a"), F.col("a").alias("b")), a.drop("b")]
    assert len({jobs.batch_digest(x, "r") for x in [a, *others]} | {jobs.batch_digest(a, "other")}) == 6


def test_a_stream_with_a_new_checkpoint_adds_to_what_is_stored(spark, root, tmp_path):
    before = Tables.from_snapshot(spark, root).sensors_data.count()
    src, ck = tmp_path / "docs", tmp_path / "ck"
    src.mkdir()
    (src / "a.json").write_text('{"tds": 1}\n{"tds": 2}\n{"tds": 3}\n')
    start_ingest(spark, str(src), root, str(ck)).awaitTermination()
    start_ingest(spark, str(src), root, str(ck)).awaitTermination()
    assert Tables.from_snapshot(spark, root).sensors_data.count() == before + 3
    other = tmp_path / "docs2"
    other.mkdir()
    (other / "b.json").write_text('{"tds": 4}\n')
    start_ingest(spark, str(other), root, str(tmp_path / "ck2")).awaitTermination()
    # a repeated micro-batch of the same stream is not added again
    stream = max(S.manifest(spark, root).streams.items(), key=lambda s: s[1])
    jobs.append_rows(Tables.from_snapshot(spark, root).sensors_data.limit(5), root, "sensors_data", stream)
    assert Tables.from_snapshot(spark, root).sensors_data.count() == before + 4


# ------------------------------------------------- concurrent publication

class Meanwhile:
    """Runs a job between the writing and the publication of another one."""

    def __init__(self, monkeypatch, job):
        self.job, self.runs = job, 0
        put = S._put

        def late(spark, root, m):
            if self.runs == 0:
                self.runs = 1
                self.job()
            return put(spark, root, m)
        monkeypatch.setattr(S, "_put", late)


def test_ingest_and_orders_interleave(spark, root, tmp_path, monkeypatch):
    t = Tables.from_driver(spark, SF_SMALL)
    orders = write(CF.app_orders(t).limit(40), tmp_path / "orders")
    reading = t.sensors_data.limit(3)
    n_orders, n_readings = t.customer_order.count(), t.sensors_data.count()
    Meanwhile(monkeypatch, lambda: jobs.append_rows(reading, root, "sensors_data", ("q", 0)))
    jobs.apply_batch(spark, root, orders, "place_orders", root, retries=0)
    now = Tables.from_snapshot(spark, root)
    assert now.sensors_data.count() == n_readings + 3 and now.customer_order.count() > n_orders
    assert S.latest(spark, root)[0] == 3
    # and the other way round, with an append to the same table
    Meanwhile(monkeypatch, lambda: jobs.append_rows(reading, root, "sensors_data", ("other", 0)))
    jobs.append_rows(reading, root, "sensors_data", ("q", 1))
    assert Tables.from_snapshot(spark, root).sensors_data.count() == n_readings + 9


def test_new_ids_conflict_and_are_handed_out_again(spark, root, tmp_path, monkeypatch):
    t = Tables.from_driver(spark, SF_SMALL)
    a = write(CF.app_orders(t).limit(30), tmp_path / "a")
    b = write(CF.orders_form(t).limit(30), tmp_path / "b")
    Meanwhile(monkeypatch, lambda: jobs.apply_batch(spark, root, b, "insert_orders", root))
    with pytest.raises(S.Conflict):
        jobs.apply_batch(spark, root, a, "place_orders", root, retries=0)
    one = Tables.from_snapshot(spark, root).customer_order.count()
    Meanwhile(monkeypatch, lambda: jobs.apply_batch(spark, root, write(CF.orders_form(t).limit(7), tmp_path / "c"),
                                                    "insert_orders", root))
    jobs.apply_batch(spark, root, a, "place_orders", root)
    orders = Tables.from_snapshot(spark, root).customer_order
    assert orders.count() > one and orders.groupBy("order_id").count().where("count > 1").count() == 0


def months(t):
    found = t.customer_order.where("created_at is not null").orderBy("created_at").select("order_id", "created_at").collect()
    return found[0], found[-1]


def test_months_commute_and_the_same_month_conflicts(spark, root, tmp_path, monkeypatch):
    first, last = months(Tables.from_driver(spark, SF_SMALL))
    a, b, c = (write(spark.createDataFrame([(1, i, s)], SEEN), tmp_path / s) for i, s in
               ((first.order_id, "A"), (last.order_id, "B"), (first.order_id, "C")))
    Meanwhile(monkeypatch, lambda: jobs.apply_batch(spark, root, b, "set_order_status", root))
    jobs.apply_batch(spark, root, a, "set_order_status", root, retries=0)

    def status():
        o = Tables.from_snapshot(spark, root).customer_order
        return {r.order_id: r.status for r in o.where(o.order_id.isin(first.order_id, last.order_id)).collect()}
    assert status() == {first.order_id: "A", last.order_id: "B"}
    d = write(spark.createDataFrame([(2, first.order_id, "D")], SEEN), tmp_path / "D")
    Meanwhile(monkeypatch, lambda: jobs.apply_batch(spark, root, c, "set_order_status", root))
    with pytest.raises(S.Conflict):
        jobs.apply_batch(spark, root, d, "set_order_status", root, retries=0)
    assert status()[first.order_id] == "C"
    jobs.apply_batch(spark, root, d, "set_order_status", root)
    assert status()[first.order_id] == "D"


def test_workers_commute_by_id_with_compaction_in_between(spark, root, tmp_path, monkeypatch):
    ids = [r.id for r in Tables.from_snapshot(spark, root).worker.orderBy("id").limit(3).collect()]
    names = "seq long, id long, name string, email string, mobile_no string"

    def edit(k, name):
        return write(spark.createDataFrame([(1, ids[k], name, f"{name}@x", "1")], names), tmp_path / name)
    one, two, same = edit(0, "one"), edit(1, "two"), edit(1, "same")

    def other():
        jobs.apply_batch(spark, root, two, "update_workers", root)
        S.compact(spark, root, "worker", everything=True)
    Meanwhile(monkeypatch, other)
    jobs.apply_batch(spark, root, one, "update_workers", root, retries=0)
    w = Tables.from_snapshot(spark, root).worker
    got = {r.id: r.name for r in w.where(w.id.isin(ids)).collect()}
    assert got[ids[0]] == "one" and got[ids[1]] == "two" and w.count() == w.select("id").distinct().count()
    Meanwhile(monkeypatch, lambda: jobs.apply_batch(spark, root, edit(1, "winner"), "update_workers", root))
    with pytest.raises(S.Conflict):
        jobs.apply_batch(spark, root, same, "update_workers", root, retries=0)


# --------------------------------------------------------- parts with keys

@pytest.mark.parametrize("bound", [0, B.UPDATE_BROADCAST_BYTES])
def test_keyed_parts_equal_rewritten_tables(spark, root, tmp_path, monkeypatch, bound):
    t = Tables.from_driver(spark, SF_SMALL)
    monkeypatch.setattr(B, "UPDATE_BROADCAST_BYTES", bound)
    steps = [("stock_changes", CF.stock_moves(t, ("issue",)), "inventory", C.stock_changes),
             ("update_workers", CF.worker_updates(t).limit(50), "worker", C.update_workers),
             ("insert_inventory", CF.item_form(t), "inventory", C.insert_inventory),
             ("delete_workers", CF.worker_deletes(t).limit(20), "worker", C.delete_workers),
             ("stock_changes", CF.stock_moves(t, ("receive",)), "inventory", C.stock_changes),
             ("complete_tasks", CF.task_completions(t), "task", C.complete_tasks)]
    plain = t
    for i, (rule, changes, name, apply) in enumerate(steps):
        path = write(changes, tmp_path / f"c{i}")
        jobs.apply_batch(spark, root, path, rule, root)
        res = apply(plain, spark.read.parquet(path))
        plain = plain.with_table(name, res.table.checkpoint())
        assert rows(getattr(Tables.from_snapshot(spark, root), name)) == rows(getattr(plain, name)), rule
    for name in ("inventory", "worker", "task"):
        S.compact(spark, root, name, everything=True)
        parts = S.latest(spark, root)[1][name]
        assert len(parts) == 1 and not parts[0].get("keys")
        assert rows(getattr(Tables.from_snapshot(spark, root), name)) == rows(getattr(plain, name))


def test_one_row_is_one_small_part(spark, root, tmp_path):
    worker = Tables.from_snapshot(spark, root).worker
    twice = worker.unionAll(worker.limit(1))  # rows that share an id change together
    jobs.write_table(twice, root, "worker")
    one = worker.limit(1).first()
    path = write(spark.createDataFrame([(1, one.id, "New", "n@x", "1")], "seq long, id long, name string, email string, mobile_no string"),
                 tmp_path / "one")
    out = jobs.apply_batch(spark, root, path, "update_workers", root)
    parts = S.latest(spark, root)[1]["worker"]
    assert len(parts) == 2 and spark.read.parquet(out["table"]).count() == 2
    now = Tables.from_snapshot(spark, root).worker
    assert now.count() == twice.count() and now.where(f"id = {one.id} and name = 'New'").count() == 2
    gone = write(spark.createDataFrame([(1, one.id)], "seq long, id long"), tmp_path / "gone")
    out = jobs.apply_batch(spark, root, gone, "delete_workers", root)
    assert spark.read.schema(S.table_schema("worker")).parquet(out["table"]).count() == 0
    assert Tables.from_snapshot(spark, root).worker.count() == twice.count() - 2


# --------------------------------------------------------- ids by statistics

def files_read(df):
    """Files that the scans of a plan without exchanges have opened."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    found = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        found += metric.get().value() if metric.isDefined() else 0
    return found


@pytest.mark.parametrize("kind", ["rising", "random", "skewed"])
def test_ids_are_looked_for_where_they_can_be(spark, tmp_path, kind):
    root = str(tmp_path / kind)
    n = 2400
    order_id = {"rising": F.col("id"), "random": F.pmod(F.xxhash64("id"), F.lit(10 ** 9)),
                "skewed": F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100)}[kind]
    orders = spark.range(n).select(
        order_id.alias("order_id"), F.lit(1).alias("customer_id"),
        F.expr("timestamp_ntz'2020-01-15 00:00:00' + make_interval(0, cast(id div 100 as int))").alias("created_at"))
    full = [F.col(f.name) if f.name in orders.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in S.schemas.BUSINESS["customer_order"].fields]
    jobs.write_table(orders.select(*full), root, "customer_order")
    m = S.manifest(spark, root)
    t = Tables.from_manifest(spark, m)
    everything = files_read(t.customer_order)
    one = orders.where("created_at = timestamp_ntz'2020-06-15 00:00:00'").orderBy(F.desc("order_id")).first().order_id
    for asked in ([one], [-5], [one, None, 10 ** 12]):
        ids = spark.createDataFrame([(x,) for x in asked], "order_id long")
        own = t.with_ids(m, "customer_order", ids).customer_order
        here = own.where(F.col("order_id").isin(*[x for x in asked if x is not None]))
        want = t.customer_order.where(F.col("order_id").isin(*[x for x in asked if x is not None]))
        assert rows(here) == rows(want)
        if asked == [-5]:
            assert own.count() == 0
        elif kind == "rising":
            assert files_read(here) == 1 < everything
        else:
            assert 0 < files_read(here) <= everything
    # the parts have Bloom filters of the ids: a row group without the id is not read
    import pyarrow.parquet as pq
    part = S.latest(spark, root)[1]["customer_order"][0]["path"]
    files = [os.path.join(d, f) for d, _, fs in os.walk(part) for f in fs if f.endswith(".parquet")]
    columns = pq.ParquetFile(files[0]).metadata.row_group(0)
    named = {columns.column(i).path_in_schema: columns.column(i) for i in range(columns.num_columns)}
    assert "order_id" in named


def test_updates_by_id_read_the_months_that_can_hold_it(spark, root, tmp_path, monkeypatch):
    first, _ = months(Tables.from_driver(spark, SF_SMALL))
    asked = []
    read = S.read_table
    monkeypatch.setattr(S, "read_table", lambda s, n, p, m=None: asked.append((n, m)) or read(s, n, p, m))
    path = write(spark.createDataFrame([(1, -77, "Nowhere")], SEEN), tmp_path / "none")
    out = jobs.apply_batch(spark, root, path, "set_order_status", root)
    assert ("customer_order", []) in asked and spark.read.parquet(out["rejects"]).count() == 1 and "table" not in out
    path = write(spark.createDataFrame([(1, first.order_id, "Here")], SEEN), tmp_path / "one")
    jobs.apply_batch(spark, root, path, "set_order_status", root)
    now = Tables.from_snapshot(spark, root).customer_order
    assert now.where(f"order_id = {first.order_id}").first().status == "Here"
    assert now.count() == Tables.from_driver(spark, SF_SMALL).customer_order.count()


# ------------------------------------------------------ compaction, expiry

def test_a_thousand_small_parts_are_merged(spark, tmp_path):
    root = str(tmp_path / "snap")
    t = Tables.from_driver(spark, SF_SMALL)
    jobs.append_rows(t.sensors_data.where("Updated_at is not null").limit(2), root, "sensors_data")
    part = S.latest(spark, root)[1]["sensors_data"][0]
    more = []
    for i in range(1000):
        path = f"{part['path']}x{i:04d}"
        shutil.copytree(part["path"], path)
        more.append({**part, "path": path})
    S.commit(spark, root, S.manifest(spark, root), [S.Edit("sensors_data", more)])
    table = Tables.from_snapshot(spark, root).sensors_data
    assert table.count() == 2002
    # one scan, however many parts there are
    assert table._jdf.queryExecution().executedPlan().collectLeaves().size() == 1
    while S.compact(spark, root, "sensors_data"):
        pass
    parts = S.latest(spark, root)[1]["sensors_data"]
    assert len(parts) < S.FAN_IN and Tables.from_snapshot(spark, root).sensors_data.count() == 2002
    for _ in range(2 * S.FAN_IN):  # appends merge small parts by themselves
        jobs.append_rows(t.sensors_data.where("Updated_at is not null").limit(1), root, "sensors_data")
    assert len(S.latest(spark, root)[1]["sensors_data"]) < 2 * S.FAN_IN
    assert Tables.from_snapshot(spark, root).sensors_data.count() == 2002 + 2 * S.FAN_IN
    assert S.expire(spark, root, keep=1) == 0  # too young
    assert S.expire(spark, root, keep=1, grace_hours=0) >= 1000
    assert Tables.from_snapshot(spark, root).sensors_data.count() == 2002 + 2 * S.FAN_IN
    assert len(S.versions(spark, root)) == 1


def test_newest_parts_are_merged_with_their_keys(spark, root, tmp_path):
    ids = [r.id for r in Tables.from_snapshot(spark, root).worker.orderBy("id").limit(5).collect()]
    names = "seq long, id long, name string, email string, mobile_no string"
    version = S.latest(spark, root)[1]["worker"][0]
    big = {**version, "bytes": S.SMALL_BYTES * S.FAN_IN ** 3}  # the table itself is of a larger class
    m = S.manifest(spark, root)
    S.commit(spark, root, m, [S.Edit("worker", [{**big, "path": big["path"]}], [(version["path"], None)])])
    for i in range(S.FAN_IN):
        path = write(spark.createDataFrame([(i, ids[i % 4], f"n{i}", "e", "1")], names), tmp_path / f"u{i}")
        jobs.apply_batch(spark, root, path, "update_workers", root)
    path = write(spark.createDataFrame([(1, ids[1])], "seq long, id long"), tmp_path / "gone")
    jobs.apply_batch(spark, root, path, "delete_workers", root)
    before = rows(Tables.from_snapshot(spark, root).worker)
    assert S.compact(spark, root, "worker")
    parts = S.latest(spark, root)[1]["worker"]
    assert len(parts) == 2 and parts[1]["keys"] and rows(Tables.from_snapshot(spark, root).worker) == before
    assert ids[1] not in {r.id for r in Tables.from_snapshot(spark, root).worker.collect()}
