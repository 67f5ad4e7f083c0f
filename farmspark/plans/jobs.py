"""Batch jobs: snapshot in → snapshot out.

A change batch is validated once and the validated batch is *checkpointed*
(``DataFrame.checkpoint`` into the shared ``spark.checkpoint.dir``): the
new snapshot, the rejects and the outbox all read it, the lineage is cut,
and a lost executor does not send the job back to the raw request log.

The new version of the snapshot is published in one step when all its parts
are written (:mod:`farmspark.plans.snapshots`), so a reader never sees a table
that is being overwritten (T-21) and the next batch starts from a whole
snapshot.  Inserts write their own rows only, updates of tables laid out by
month only the months they touch, other updates and deletes the rows they touch.

A batch is known by its content.  The version that it makes lists it, so a batch
that is applied again, after a failure or under another path, changes nothing:
no second stock move, no second insert.  Its rejects and messages lie under the
same digest and are written before the version is published.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farmspark.functions.exprs import PARTITIONED
from farmspark.operators import changes as C
from farmspark.operators import notices as N
from farmspark.operators import reports as RP
from farmspark.plans import snapshots as S
from farmspark.plans.sinks import append_outbox, write_report
from farmspark.session import ensure_checkpoint_dir
from farmspark.sources import schemas
from farmspark.sources.tables import Tables


@dataclass(frozen=True)
class Rule:
    apply: Callable[[Tables, DataFrame], C.Applied]
    table: str
    notice: Callable[[Tables, DataFrame], DataFrame] | None = None
    notice_uses_bound: bool = False  # the notice takes the rule's proven key bound
    key: str | None = None  # column of the requests that names the rows they change


RULES: dict[str, Rule] = {
    "insert_orders": Rule(C.insert_orders, "customer_order"),
    "place_orders": Rule(C.place_orders, "customer_order", N.new_order_notice),
    "insert_supply_orders": Rule(C.insert_supply_orders, "supply_orders", N.purchase_order_notice),
    "insert_inventory": Rule(C.insert_inventory, "inventory"),
    "insert_tasks": Rule(C.insert_tasks, "task"),
    "stock_changes": Rule(C.stock_changes, "inventory"),
    "set_approval": Rule(C.set_approval, "customer_order", N.order_approval_notice, True, key="order_id"),
    "set_order_status": Rule(C.set_order_status, "customer_order", N.order_status_notice, True, key="order_id"),
    "set_order_status_worker": Rule(lambda t, ch: C.set_order_status(t, ch, worker_app=True), "customer_order",
                                    lambda t, acc: N.worker_order_notice(acc), key="order_id"),
    "set_assigned_by": Rule(C.set_assigned_by, "customer_order", key="order_id"),
    "set_supply_status": Rule(C.set_supply_status, "supply_orders", key="supply_order_id"),
    "set_supply_status_owned": Rule(C.set_supply_status_owned, "supply_orders", N.supply_status_notice, key="supply_order_id"),
    "update_workers": Rule(C.update_workers, "worker"),
    "delete_workers": Rule(C.delete_workers, "worker"),
    "complete_tasks": Rule(C.complete_tasks, "task", lambda t, acc: N.worker_task_notice(acc)),
}


def batch_digest(changes: DataFrame, rule: str) -> str:
    """What a batch is known by: its rows in any order, and the rule.

    Two sums of row hashes and the count, added up on the map side.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(changes.columns)]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(row, F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    said = changes.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(f"{rule}:{':'.join(map(str, said))}".encode()).hexdigest()[:32]


def _edit(res: C.Applied, base: DataFrame, name: str, root: str, parts: list[dict] | None) -> S.Edit | None:
    """What a rule does to the parts of its table; None for nothing."""
    if parts is None:  # nothing published yet: the whole table is the part
        return S.Edit(name, [S.write_part(res.table, root, name)])
    if res.inserted is not None:
        return S.Edit(name, [S.write_part(res.inserted, root, name, new_ids=True)], new_ids=True)
    if name in PARTITIONED:
        months = S.touched_months(base, res.accepted, res.update_keys)
        if not months:
            return None
        part = S.write_part(res.table.where(S._in_months(months)), root, name)
        return S.Edit(name, [part], S.drops(parts, months))
    key = S.KEYS[name]
    keys = res.touched.where(F.col(key).isNotNull()).distinct()
    if keys.isEmpty():
        return None
    return S.Edit(name, [S.write_part(res.table.join(keys, key, "left_semi"), root, name, keys=keys)])


def _base(spark: SparkSession, snapshot_in: str, out_root: str) -> S.Manifest:
    """The version a job starts from, as if it were one of ``out_root``."""
    m = S.manifest(spark, snapshot_in)
    if out_root.rstrip("/") == snapshot_in.rstrip("/"):
        return m
    tables = dict(m.tables)
    if not m.version:  # plain folders become parts by reference
        for name in schemas.BUSINESS:
            path = os.path.join(snapshot_in, name)
            if S.exists(spark, path):
                tables[name] = [S.adopt(spark, path, name)]
    own = S.manifest(spark, out_root)
    # later than every part it carries
    return S.Manifest(max(own.version, m.version), tables, {**own.batches, **m.batches}, {**own.streams, **m.streams})


def _applied_once(spark: SparkSession, snapshot_in: str, out_root: str, batch: str,
                  attempt: Callable[[S.Manifest], tuple[list[S.Edit], dict[str, str]]], retries: int) -> dict[str, str]:
    """Run ``attempt`` on the newest version until its edits are published; a
    batch that is in a version already is not run."""
    while True:
        base = _base(spark, snapshot_in, out_root)
        if batch in base.batches:
            return base.batches[batch]
        edits, out = attempt(base)
        try:
            same = out_root.rstrip("/") == snapshot_in.rstrip("/")
            return S.commit(spark, out_root, base, edits, batch=(batch, out), rebase=same).batches[batch]
        except S.Conflict:
            if not retries:
                raise
            retries -= 1


def apply_batch(spark: SparkSession, snapshot_in: str, changes_path: str, rule: str, out_root: str,
                outbox_path: str | None = None, retries: int = 3) -> dict[str, str]:
    """Apply one change batch and publish the new version in ``out_root`` (which
    may be ``snapshot_in``); returns the paths written.

    A batch that is in the snapshot already is not applied again.  If another
    job publishes first, this one's changes go on top of it where they commute;
    where not, the batch is applied to the new version, up to ``retries`` times.
    """
    ensure_checkpoint_dir(spark)
    r = RULES[rule]
    changes = spark.read.parquet(changes_path)
    batch = batch_digest(changes, rule)

    def attempt(base: S.Manifest) -> tuple[list[S.Edit], dict[str, str]]:
        t = Tables.from_manifest(spark, base) if base.tables else Tables.from_snapshot(spark, snapshot_in)
        parts = base.tables.get(r.table)
        if parts is not None and r.key and r.table in PARTITIONED:
            # months whose range of ids holds none of the requested ones are not read
            some = S.months_of_ids(parts, changes, r.key)
            if some is not None:
                t = t.with_table(r.table, S.read_table(spark, r.table, parts, some))
        with C.materialized_batches():
            res = r.apply(t, changes)
        out = {"rejects": os.path.join(out_root, "_rejects", rule, f"batch={batch}")}
        res.rejects.write.mode("overwrite").parquet(out["rejects"])
        edit = _edit(res, getattr(t, r.table), r.table, out_root, parts)
        if edit:
            out["table"] = edit.add[-1]["path"]
        if r.notice is not None and outbox_path:
            msgs = r.notice(t, res.accepted, res.keys_bounded) if r.notice_uses_bound else r.notice(t, res.accepted)
            append_outbox(msgs, outbox_path, f"{rule}-{batch}")
            out["outbox"] = outbox_path
        return [edit] if edit else [], out

    return _applied_once(spark, snapshot_in, out_root, batch, attempt, retries)


def register_batch(spark: SparkSession, snapshot_in: str, changes_path: str, out_root: str,
                   outbox_path: str | None = None, retries: int = 3) -> dict[str, str]:
    """C-16 sign-ups of every kind; publishes customer, supplier, worker and
    users, the rejects and the welcome notices.  Applied once, like any batch."""
    ensure_checkpoint_dir(spark)
    changes = spark.read.parquet(changes_path)
    batch = batch_digest(changes, "register_accounts")
    names = {"customer": "customer", "supplier": "supplier", "worker": "worker", "user": "users"}

    def attempt(base: S.Manifest) -> tuple[list[S.Edit], dict[str, str]]:
        t = Tables.from_manifest(spark, base) if base.tables else Tables.from_snapshot(spark, snapshot_in)
        with C.materialized_batches():
            res = C.register_accounts(t, changes)
        out, edits, rejects = {}, [], None
        for kind, table in names.items():
            edits.append(_edit(res[kind], getattr(t, table), table, out_root, base.tables.get(table)))
            out[table] = edits[-1].add[-1]["path"]
            rejects = res[kind].rejects if rejects is None else rejects.unionByName(res[kind].rejects)
        out["rejects"] = os.path.join(out_root, "_rejects", "register_accounts", f"batch={batch}")
        rejects.write.mode("overwrite").parquet(out["rejects"])
        if outbox_path:
            append_outbox(N.welcome_notice(res["customer"].accepted, res["supplier"].accepted,
                                           res["worker"].accepted), outbox_path, f"register_accounts-{batch}")
        return edits, out

    return _applied_once(spark, snapshot_in, out_root, batch, attempt, retries)


REPORTS = {
    "sales": RP.sales_report,
    "purchase": RP.purchase_report,
    "water": RP.water_report,
}


def report(spark: SparkSession, snapshot: str, name: str, out: str, start: str | None = None,
           end: str | None = None, fmt: str = "csv") -> None:
    """SNK-2: write one report (rows in report order, header labels)."""
    t = Tables.from_snapshot(spark, snapshot)
    df = RP.inventory_report(t) if name == "inventory" else REPORTS[name](t, start, end)
    write_report(df, out, fmt=fmt)


def write_table(df: DataFrame, root: str, name: str) -> str:
    """Publish ``df`` as the whole of one table of the snapshot ``root``."""
    spark = df.sparkSession
    base = S.manifest(spark, root)
    part = S.write_part(df, root, name, new_ids=True)
    S.commit(spark, root, base, [S.Edit(name, [part], S.drops(base.tables.get(name, [])), new_ids=True, whole=True)])
    return part["path"]


def append_rows(df: DataFrame, root: str, name: str, stream: tuple[str, int] | None = None) -> None:
    """Add rows without ids of their own to a table of the snapshot ``root``.

    ``stream``: (id of the streaming query, micro-batch); a micro-batch that is
    in the snapshot already is not added again.  Appends commute with whatever
    other jobs publish.  Small parts are merged from time to time.
    """
    spark = df.sparkSession
    base = S.manifest(spark, root)
    if stream and base.streams.get(stream[0], -1) >= stream[1]:
        return
    new = S.write_part(df, root, name)
    now = S.commit(spark, root, base, [S.Edit(name, [new] if new["months"] != [] else [])], stream=stream)
    if S.merge_run(now.tables.get(name, []), name not in PARTITIONED):
        try:
            S.compact(spark, root, name)
        except S.Conflict:
            pass  # another job is merging the same parts


def compact(spark: SparkSession, root: str, name: str, everything: bool = True) -> bool:
    """Merge the parts that many batches have added to a table: all of them, or
    only small ones (:func:`farmspark.plans.snapshots.compact`)."""
    return S.compact(spark, root, name, everything)


def write_snapshot(t: Tables, root: str, names: list[str] | None = None) -> None:
    """Write business tables (e.g. built from the driver data) as one version
    that :meth:`Tables.from_snapshot` reads back with the declared schemas."""
    base = S.manifest(t.spark, root)
    edits = [S.Edit(name, [S.write_part(getattr(t, name), root, name, new_ids=True)],
                    S.drops(base.tables.get(name, [])), new_ids=True, whole=True)
             for name in names or list(schemas.BUSINESS) if name in t._thunks]
    S.commit(t.spark, root, base, edits)


__all__ = ["RULES", "append_rows", "apply_batch", "batch_digest", "compact", "register_batch", "report", "write_snapshot",
           "write_table"]
