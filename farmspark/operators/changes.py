"""Change application (C-1 … C-16): INSERT / UPDATE / DELETE as batch jobs.

One shape for every rule::

    apply_x(tables, changes) -> Applied(table, rejects, accepted)

``changes`` has one row per request with ``seq`` (arrival order).  Each rule
validates in the reference's order and reports the *first* failing reason
(T-18).  Several changes to one key in a batch follow the reference's
per-request effect:

* additive (stock): ``sum`` of deltas, date of the last change;
* last writer (status, approval, …): ``max_by(…, seq)``;
* first writer (registration, delete): ``min(seq)`` wins, later ones are
  rejected as the later request would be.

All per-key reductions are ``groupBy().agg()`` so Spark pre-aggregates on the
map side: a key that holds a third of the changes is one row per task before
the shuffle.  Existence checks write the distinct requested keys once; under the
bound they are broadcast and the base table is only scanned and probed, above
it the found keys are written, too, and joined by a shuffle whose skewed
partitions AQE can split (an aggregate below a join could not be).
UPDATE touches *every* base row with the key (the base is never
de-duplicated, SURVEY §7 (g)).  Plain Parquet has no MERGE, so a new snapshot
is ``base ⟕ reduced changes`` with ``when/otherwise``; the reduced changes
are broadcast when bounded, so the base streams through a hash join.  New
snapshots are built lazily (``Applied.table``) and batch jobs checkpoint the
validated batch once (:func:`materialized_batches`).
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.plans import broadcast as B
from farmspark.plans.graph import components
from farmspark.plans.ids import dense_ids
from farmspark.plans.together import together
from farmspark.sources import schemas
from farmspark.sources.tables import Tables

# The reject reasons of every rule below are the reference's texts.
STOCK_FAILED = "Database error occurred while updating item"
ITEM_ID_PREFIX = r"^\s*([+-]?[0-9]+)"  # JS parseInt: leading integer of the text


class Applied:
    """Result of one rule: ``table`` (new snapshot of the target table, built
    on first use), ``rejects`` (seq, reason) and ``accepted`` (accepted
    changes, with new ids for inserts)."""

    def __init__(self, table: DataFrame | Callable[[], DataFrame], rejects: DataFrame, accepted: DataFrame,
                 keys_bounded: bool = False, inserted: DataFrame | None = None,
                 update_keys: list[str] | None = None, touched: DataFrame | None = None):
        self._table = table
        # an insert only adds these rows; an update or delete only touches rows
        # that share these columns with an accepted change, or (tables without
        # months) whose id is among ``touched``
        self.inserted = inserted
        self.update_keys = update_keys
        self.touched = touched
        self.rejects = rejects
        self.accepted = accepted
        # the distinct keys of the batch were counted within the broadcast
        # bound by the existence check: joins keyed on them need no new count
        self.keys_bounded = keys_bounded

    @property
    def table(self) -> DataFrame:
        if callable(self._table):
            self._table = self._table()
        return self._table


def first_failing(*rules: tuple[Column, str]) -> Column:
    """Reason of the first rule whose condition is true, else NULL."""
    return F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in rules], F.lit(None).cast("string"))


# Hook applied to every validated batch before it is split.  Identity by
# default; batch jobs set it to a reliable ``checkpoint`` (see
# :func:`materialized_batches`) so the snapshot, rejects and outbox share one
# materialisation and the lineage is cut.
_MATERIALIZE: list[Callable[[DataFrame], DataFrame]] = [lambda df: df]


@contextmanager
def materialized_batches(fn: Callable[[DataFrame], DataFrame] | None = None):
    """Within the block, validated batches are materialised with ``fn``
    (default: ``df.checkpoint(eager=True)`` into ``spark.checkpoint.dir``)."""
    _MATERIALIZE.append(fn or (lambda df: df.checkpoint(eager=True)))
    try:
        yield
    finally:
        _MATERIALIZE.pop()


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = _MATERIALIZE[-1](checked)
    rejects = checked.where(F.col("reason").isNotNull()).select("seq", "reason")
    accepted = checked.where(F.col("reason").isNull()).drop("reason")
    return accepted, rejects


def _with_found(changes: DataFrame, table: DataFrame, keys: list[str], flag: str = "_found",
                change_keys: list[str] | None = None) -> tuple[DataFrame, bool]:
    """Left join ``flag`` = "the key of this change exists in ``table``";
    also returns whether the requested key set was within the broadcast
    bound (a per-key reduction of the accepted rows then has that bound too).

    The distinct requested keys are written; when bounded they are broadcast
    and the table is only scanned and probed (no shuffle of the base), and
    the found keys (no more than the requested ones) are broadcast back.
    Beyond the bound: the found keys, written, and a shuffle join."""
    ck = change_keys or keys
    req = changes.select(*[F.col(c).alias(k) for c, k in zip(ck, keys)]).distinct()
    req_b, small = B.bounded_broadcast(req, B.KEYS_BROADCAST_BYTES)
    if small:
        found = F.broadcast(table.select(*keys).join(req_b, keys, "left_semi").distinct())
    else:
        # written first: a plain shuffle on both sides of the join with the
        # requests lets AQE split a key that holds a third of them
        found, _ = B.materialized(table.select(*keys).join(req_b, keys, "left_semi").distinct())
    found = found.select(*[F.col(k).alias(c) for k, c in zip(keys, ck)]).withColumn(flag, F.lit(True))
    out = (changes.join(found, ck, "left")
           .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))
    return out, small


def _last_by_seq(accepted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key, the values of the change with the largest seq."""
    return (accepted.groupBy(*keys)
            .agg(F.max_by(F.struct(*values), F.col("seq")).alias("_v"))
            .select(*keys, *[F.col(f"_v.{v}").alias(f"_new_{v}") for v in values])
            .withColumn("_hit", F.lit(True)))


def _small(reduced: DataFrame, known_bounded: bool = False) -> DataFrame:
    """Per-key reduced changes, broadcast when bounded so the base snapshot
    streams through a hash join instead of being shuffled.  ``known_bounded``:
    the keys are a subset of a key set already counted within the bound."""
    if known_bounded:
        return F.broadcast(reduced)
    return B.bounded_broadcast(reduced, B.UPDATE_BROADCAST_BYTES)[0]


def _update(base: DataFrame, reduced: DataFrame, keys: list[str], values: list[str],
            known_bounded: bool = False) -> DataFrame:
    cols = base.columns
    j = base.join(_small(reduced, known_bounded), keys, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                      if c in values else F.col(c) for c in cols])


def _next_id(table: DataFrame, col: str) -> Column:
    return table.agg(F.max(col)).scalar()


# --------------------------------------------------------------------- inserts

def insert_orders(t: Tables, changes: DataFrame) -> Applied:
    """C-1 web order form: customer_id, prawn_type, quantity, price required
    (JS falsy: NULL, '' or 0); status defaults to 'Processing'."""
    checked = changes.withColumn("reason", first_failing(
        (X.falsy_number("customer_id") | X.blank("prawn_type") | X.falsy_number("quantity")
         | X.falsy_number("price"), "Missing required fields"),
        (X.beyond_int("quantity") | X.beyond_money("price"), "Error adding order")))
    accepted, rejects = _split(checked)
    base = t.customer_order
    accepted = dense_ids(accepted, _next_id(base, "order_id"), "order_id")
    new_rows = accepted.select(
        "order_id", "customer_id", "prawn_type", F.col("quantity").cast("int"),
        F.col("price").cast(schemas.MONEY), X.or_default("status", "Processing").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("approved_or_rejected", "payment_receipt",
                                                          "address", "assigned_by")],
        F.col("created_at").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return Applied(base.unionByName(new_rows, allowMissingColumns=True), rejects, accepted, inserted=new_rows)


def place_orders(t: Tables, changes: DataFrame) -> Applied:
    """C-2 customer app order: fields and receipt required, customer must
    exist; stored as status 'New', approval pending, receipt 'uploads/<f>'."""
    c, _ = _with_found(changes, t.customer, ["customer_id"])
    checked = c.withColumn("reason", first_failing(
        (X.blank("prawn_type") | X.falsy_number("quantity") | X.falsy_number("price") | X.blank("location"),
         "Missing required fields"),
        (X.blank("receipt"), "Payment receipt is required"),
        (~F.col("_found"), "Customer not found"),
        (X.beyond_int("quantity") | X.beyond_money("price"), "Error adding order"))).drop("_found")
    accepted, rejects = _split(checked)
    base = t.customer_order
    accepted = dense_ids(accepted, _next_id(base, "order_id"), "order_id")
    new_rows = accepted.select(
        "order_id", "customer_id", "prawn_type", F.col("quantity").cast("int"),
        F.col("price").cast(schemas.MONEY), F.lit("New").alias("status"),
        F.lit(None).cast("string").alias("approved_or_rejected"),
        F.concat(F.lit("uploads/"), F.col("receipt")).alias("payment_receipt"),
        F.col("location").alias("address"), F.lit(None).cast("string").alias("assigned_by"),
        F.col("created_at").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return Applied(base.unionByName(new_rows, allowMissingColumns=True), rejects, accepted, inserted=new_rows)


def insert_supply_orders(t: Tables, changes: DataFrame) -> Applied:
    """C-3 purchase order: supplier_id, item_id, quantity, price required;
    status is always 'New'."""
    checked = changes.withColumn("reason", first_failing(
        (X.falsy_number("supplier_id") | X.falsy_number("item_id") | X.falsy_number("quantity")
         | X.falsy_number("price"), "Missing required fields"),
        (X.beyond_int("quantity") | X.beyond_money("price"), "Error adding purchase item")))
    accepted, rejects = _split(checked)
    base = t.supply_orders
    accepted = dense_ids(accepted, _next_id(base, "supply_order_id"), "supply_order_id")
    new_rows = accepted.select(
        "supply_order_id", "supplier_id", "item_id", F.col("quantity").cast("int"),
        F.col("price").cast(schemas.MONEY), F.lit("New").alias("status"),
        F.col("order_date").cast("timestamp_ntz"))
    return Applied(base.unionByName(new_rows, allowMissingColumns=True), rejects, accepted, inserted=new_rows)


def insert_inventory(t: Tables, changes: DataFrame) -> Applied:
    """C-4 new stock item: name, type, qty required; qty numeric, truncated, ≥ 0."""
    qty = X.parse_int_text("qty")
    checked = changes.withColumn("reason", first_failing(
        (X.blank("name") | X.blank("type") | X.blank("qty"), "All fields are required"),
        (qty.isNull() | (qty < 0), "Quantity must be a positive number"),
        (X.beyond_int(qty), "Database error occurred while adding item")))
    accepted, rejects = _split(checked)
    base = t.inventory
    accepted = dense_ids(accepted.withColumn("quantity", qty.cast("int")),
                         _next_id(base, "item_id"), "item_id")
    new_rows = accepted.select("item_id", "name", "type", "quantity",
                               F.lit(None).cast("int").alias("threshold"),
                               F.lit(None).cast("date").alias("date"))
    return Applied(base.unionByName(new_rows, allowMissingColumns=True), rejects, accepted, inserted=new_rows)


def insert_tasks(t: Tables, changes: DataFrame) -> Applied:
    """C-5 task assignment: no validation (the reference checks nothing)."""
    base = t.task
    accepted = dense_ids(changes, _next_id(base, "task_id"), "task_id")
    new_rows = accepted.select("task_id", "title", "description", F.col("worker_id").cast("long"),
                               F.lit("pending").alias("status"),
                               F.col("created_date").cast("timestamp_ntz"))
    rejects = changes.where(F.lit(False)).select("seq", F.lit(None).cast("string").alias("reason"))
    return Applied(base.unionByName(new_rows, allowMissingColumns=True), rejects, accepted, inserted=new_rows)


# ---------------------------------------------------------------- stock moves

def stock_changes(t: Tables, changes: DataFrame) -> Applied:
    """C-6 / C-7 issue (quantity −= qty) and receive (quantity += qty).

    ``changes``: seq, kind ('issue' | 'receive'), item_id, qty, date — all as
    request text.  Stock may go negative and a NULL stock stays NULL (T-15);
    the code, not the comments, decides the sign (T-16).
    """
    item = F.nullif(F.regexp_extract("item_id", ITEM_ID_PREFIX, 1), F.lit("")).try_cast("bigint")
    qty = X.parse_int_text("qty")
    c = changes.withColumn("_item", item).withColumn("_qty", qty)
    c, bounded = _with_found(c, t.inventory, ["item_id"], change_keys=["_item"])
    checked = c.withColumn("reason", first_failing(
        (F.col("_item").isNull(), "Valid item ID is required"),
        (X.blank("qty") | F.col("_qty").isNull() | (F.col("_qty") < 0),
         "Valid quantity is required (must be a positive number)"),
        (X.blank("date"), "Date is required"),
        (X.beyond_int("_qty") | F.try_to_date(F.col("date")).isNull(), STOCK_FAILED),
        (~F.col("_found"), "Item not found"))).drop("_found")
    delta = F.when(F.col("kind") == "issue", -F.col("_qty")).otherwise(F.col("_qty")).cast("long")
    base = t.inventory

    def reduce(accepted: DataFrame) -> DataFrame:
        moves = accepted.groupBy(F.col("_item").alias("item_id")).agg(
            F.sum("_delta").alias("_delta"), F.sum(F.abs("_delta")).alias("_moved"),
            F.max_by(F.try_to_date(F.col("date")), F.col("seq")).alias("_date"))
        return B.bounded_broadcast(moves.withColumn("_hit", F.lit(True)), B.UPDATE_BROADCAST_BYTES)[0]

    # only accepted quantities fit a long
    accepted, rejects = _split(checked.withColumn("_delta", F.when(F.col("reason").isNull(), delta)))
    reduced = reduce(accepted)
    risky = _could_overflow(reduced, base)
    if not risky.isEmpty():
        failed = _fail_in_turn(accepted, risky)
        rejects = rejects.unionByName(failed)
        accepted = accepted.join(failed.select("seq"), "seq", "left_anti")
        reduced = reduce(accepted)
    reduced = reduced.drop("_moved")
    j = base.join(reduced, "item_id", "left")
    table = j.select(
        "item_id", "name", "type",
        F.when(F.col("_hit"), (F.col("quantity") + F.col("_delta")).cast("int"))
         .otherwise(F.col("quantity")).alias("quantity"),
        "threshold",
        F.when(F.col("_hit"), F.col("_date")).otherwise(F.col("date")).alias("date"))
    return Applied(table, rejects, accepted.drop("_delta"), touched=reduced.select("item_id"))


def _fails_in_turn(batches):
    """(item, seq, delta) of the moves that leave the INT column, from moves sorted
    by item and seq: a failed move does not count for the ones after it.

    A run of an item's moves whose running totals all stay inside is taken as a
    whole; only other runs are looked at one by one.
    """
    import numpy as np
    import pyarrow as pa
    item = high = low = None
    for batch in batches:
        items, seqs, deltas, highs, lows = (c.to_numpy() for c in batch.columns)
        if not len(items):
            continue
        failed = []
        starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(items)]):
            if items[a] != item:
                item, high, low = items[a], int(highs[a]), int(lows[a])
            total = np.cumsum(deltas[a:b])
            if high + int(total.max()) <= X.INT_MAX and low + int(total.min()) >= -X.INT_MAX - 1:
                high, low = high + int(total[-1]), low + int(total[-1])
                continue
            for at in range(a, b):
                d = int(deltas[at])
                if high + d > X.INT_MAX or low + d < -X.INT_MAX - 1:
                    failed.append(at)
                else:
                    high, low = high + d, low + d
        yield pa.record_batch([pa.array(x[failed]) for x in (items, seqs, deltas)], ["_item", "seq", "_delta"])


def _could_overflow(reduced: DataFrame, inventory: DataFrame) -> DataFrame:
    """Items (with their stock) whose moves could add up beyond the INT column."""
    return (inventory.select("item_id", F.col("quantity").cast("long").alias("_q"))
            .join(reduced.select("item_id", "_moved"), "item_id")
            .where(F.abs("_q") + F.col("_moved") > X.INT_MAX)
            .groupBy(F.col("item_id").alias("_item")).agg(F.max("_q").alias("_high"), F.min("_q").alias("_low")))


#: ranges of an item's moves that are stepped through one after the other before
#: what is left of the item goes to one task
STEPPED_RANGES = 12


def _fail_in_turn(moves: DataFrame, risky: DataFrame) -> DataFrame:
    """(seq, reason) of the moves of risky items that leave the INT column.

    Moves are dealt to ranges of (item, seq), so a hot item is spread over tasks.
    A range has the sum and the extremes of its running total; as long as these
    stay inside, ranges are added up.  The first one of an item that could leave
    the column is stepped through, then the ranges behind it are added up again.
    """
    parts = int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = B.materialized(
        moves.join(risky.select("_item"), "_item").select(F.col("_item").cast("long"), F.col("seq").cast("long"), "_delta")
        .repartitionByRange(parts, "_item", "seq").withColumn("_part", F.spark_partition_id()), "moves")
    total = F.sum("_delta").over(Window.partitionBy("_item", "_part").orderBy("seq"))
    ranges, _ = B.materialized(dealt.withColumn("_total", total).groupBy("_item", "_part").agg(
        F.sum("_delta").alias("_sum"), F.max("_total").alias("_most"), F.min("_total").alias("_least")), "ranges")
    state = risky.select("_item", "_high", "_low", F.lit(-1).alias("_after"))
    failed = None
    for turn in range(STEPPED_RANGES + 1):
        ahead = ranges.join(state, "_item").where(F.col("_part") > F.col("_after"))
        before = F.sum("_sum").over(Window.partitionBy("_item").orderBy("_part")) - F.col("_sum")
        leaves = ((F.col("_high") + F.col("_before") + F.col("_most") > X.INT_MAX)
                  | (F.col("_low") + F.col("_before") + F.col("_least") < -X.INT_MAX - 1))
        # one row per item: the range to step through and the totals before it
        first, _ = B.materialized(ahead.withColumn("_before", before).where(leaves).groupBy("_item").agg(
            F.min_by(F.struct("_part", (F.col("_high") + F.col("_before")).alias("_high"),
                              (F.col("_low") + F.col("_before")).alias("_low"), "_sum"), "_part").alias("_f"))
            .select("_item", "_f.*"), "stepped")
        if first.isEmpty():
            break
        last = turn == STEPPED_RANGES
        own = (F.col("_part") >= F.col("_from")) if last else (F.col("_part") == F.col("_from"))
        step = (dealt.join(first.select("_item", F.col("_part").alias("_from"), "_high", "_low"), "_item").where(own)
                .select("_item", "seq", "_delta", "_high", "_low")
                .repartition("_item").sortWithinPartitions("_item", "seq"))
        found, _ = B.materialized(step.mapInArrow(_fails_in_turn, "_item long, seq long, _delta long"), "failed")
        failed = found if failed is None else failed.unionByName(found)
        if last:
            break
        lost = found.groupBy("_item").agg(F.sum("_delta").alias("_lost"))
        move = F.col("_sum") - F.coalesce("_lost", F.lit(0))
        state, _ = B.materialized(first.join(lost, "_item", "left").select(
            "_item", (F.col("_high") + move).alias("_high"), (F.col("_low") + move).alias("_low"), F.col("_part").alias("_after")), "state")
    if failed is None:
        failed = dealt.where("false")
    return failed.select("seq", F.lit(STOCK_FAILED).alias("reason"))


# ------------------------------------------------------------------- updates

def set_approval(t: Tables, changes: DataFrame) -> Applied:
    """C-8 action must be exactly 'approved' or 'rejected'; stored capitalised."""
    c, bounded = _with_found(changes, t.customer_order, ["order_id"])
    checked = c.withColumn("reason", first_failing(
        (F.col("action").isNull() | ~F.col("action").isin("approved", "rejected"), "Invalid action"),
        (~F.col("_found"), "Order not found"))).drop("_found")
    accepted, rejects = _split(checked)
    accepted = accepted.withColumn("approved_or_rejected", X.cap_first("action"))
    reduced = _last_by_seq(accepted, ["order_id"], ["approved_or_rejected"])
    return Applied(lambda: _update(t.customer_order, reduced, ["order_id"], ["approved_or_rejected"], bounded),
                   rejects, accepted, bounded, update_keys=["order_id"])


def set_order_status(t: Tables, changes: DataFrame, worker_app: bool = False) -> Applied:
    """C-9 web: non-empty status, order must exist.  Worker app: order id and
    status required, no existence check (an unknown id changes nothing)."""
    bounded = False
    if worker_app:
        checked = changes.withColumn("reason", first_failing(
            (X.falsy_number("order_id") | X.blank("status"), "Order ID and status are required")))
    else:
        c, bounded = _with_found(changes, t.customer_order, ["order_id"])
        checked = c.withColumn("reason", first_failing(
            (X.blank("status"), "Status is required"),
            (~F.col("_found"), "Order not found"))).drop("_found")
    accepted, rejects = _split(checked)
    reduced = _last_by_seq(accepted, ["order_id"], ["status"])
    return Applied(lambda: _update(t.customer_order, reduced, ["order_id"], ["status"], bounded), rejects, accepted,
                   bounded, update_keys=["order_id"])


def set_assigned_by(t: Tables, changes: DataFrame) -> Applied:
    """C-10 non-empty assigned_by; order must exist."""
    c, bounded = _with_found(changes, t.customer_order, ["order_id"])
    checked = c.withColumn("reason", first_failing(
        (X.blank("assigned_by"), "Assigned By field is required"),
        (~F.col("_found"), "Order not found"))).drop("_found")
    accepted, rejects = _split(checked)
    reduced = _last_by_seq(accepted, ["order_id"], ["assigned_by"])
    return Applied(lambda: _update(t.customer_order, reduced, ["order_id"], ["assigned_by"], bounded), rejects,
                   accepted, update_keys=["order_id"])


def set_supply_status(t: Tables, changes: DataFrame) -> Applied:
    """C-11 by supply_order_id, no existence check; every row with the key."""
    checked = changes.withColumn("reason", first_failing(
        (X.falsy_number("supply_order_id") | X.blank("status"), "Order ID and status are required")))
    accepted, rejects = _split(checked)
    reduced = _last_by_seq(accepted, ["supply_order_id"], ["status"])
    return Applied(lambda: _update(t.supply_orders, reduced, ["supply_order_id"], ["status"]), rejects, accepted,
                   update_keys=["supply_order_id"])


def set_supply_status_owned(t: Tables, changes: DataFrame) -> Applied:
    """C-12 by (supply_order_id, supplier_id); a non-owner is rejected."""
    keys = ["supply_order_id", "supplier_id"]
    c, bounded = _with_found(changes, t.supply_orders, keys)
    checked = c.withColumn("reason", first_failing(
        (X.falsy_number("supplier_id") | X.falsy_number("supply_order_id") | X.blank("status"),
         "Supplier ID, Order ID, and status are required"),
        (~F.col("_found"), "Order not found or not owned by this supplier"))).drop("_found")
    accepted, rejects = _split(checked)
    reduced = _last_by_seq(accepted, keys, ["status"])
    return Applied(lambda: _update(t.supply_orders, reduced, keys, ["status"], bounded), rejects, accepted, bounded,
                   update_keys=keys)


def update_workers(t: Tables, changes: DataFrame) -> Applied:
    """C-13 name, email and mobile_no all required; worker must exist."""
    c, bounded = _with_found(changes, t.worker, ["id"])
    checked = c.withColumn("reason", first_failing(
        (X.blank("name") | X.blank("email") | X.blank("mobile_no"), "Name, email, and mobile_no are required"),
        (~F.col("_found"), "Worker not found"))).drop("_found")
    accepted, rejects = _split(checked)
    vals = ["name", "email", "mobile_no"]
    reduced = _last_by_seq(accepted, ["id"], vals)
    return Applied(lambda: _update(t.worker, reduced, ["id"], vals, bounded), rejects, accepted, touched=reduced.select("id"))


def delete_workers(t: Tables, changes: DataFrame) -> Applied:
    """C-14 delete by id.  An unknown id is rejected; so is a repeated delete
    of the same id later in the batch (the row is already gone)."""
    c, bounded = _with_found(changes, t.worker, ["id"])
    first = changes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("seq").alias("_first"))
    c = c.join(B.bounded_broadcast(first, B.KEYS_BROADCAST_BYTES)[0], "id", "left")
    checked = c.withColumn("reason", first_failing(
        (~F.col("_found") | (F.col("seq") != F.col("_first")), "Worker not found"))).drop("_found", "_first")
    accepted, rejects = _split(checked)
    gone = accepted.select("id").distinct()
    return Applied(lambda: t.worker.join(_small(gone, bounded), "id", "left_anti"), rejects, accepted, touched=gone)


def complete_tasks(t: Tables, changes: DataFrame) -> Applied:
    """C-15 status = 'completed' by (task_id, worker of the e-mail).  Task id
    0 is allowed; an unknown worker and a foreign task give different reasons."""
    # the reference takes the first worker row of the e-mail; min(id) is the
    # deterministic choice
    asked = B.restrict_to_keys(t.worker.select("email", "id"), changes, ["email"])
    w = asked.groupBy("email").agg(F.min("id").alias("worker_id"))
    c = changes.join(B.bounded_broadcast(w, B.KEYS_BROADCAST_BYTES)[0], "email", "left")
    c, bounded = _with_found(c, t.task, ["task_id", "worker_id"])
    checked = c.withColumn("reason", first_failing(
        (F.col("task_id").isNull(), "Task ID is required"),
        (F.col("worker_id").isNull(), "Worker not found"),
        (~F.col("_found"), "Task not found or not assigned to this worker"))).drop("_found")
    accepted, rejects = _split(checked)
    hits = accepted.select("task_id", "worker_id").distinct().withColumn("_hit", F.lit(True))

    def table() -> DataFrame:
        j = t.task.join(_small(hits, bounded), ["task_id", "worker_id"], "left")
        return j.select(*[F.when(F.col("_hit"), F.lit("completed")).otherwise(F.col("status")).alias("status")
                          if c == "status" else F.col(c) for c in t.task.columns])

    return Applied(table, rejects, accepted, touched=accepted.select("task_id"))


# -------------------------------------------------------------- registration

def _first_writer(c: DataFrame, key: str, ok: Column) -> DataFrame:
    """Adds ``_first``: min seq among the changes with this key that pass
    ``ok`` (earlier checks); a later change with the key is a duplicate."""
    first = c.where(ok & F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias(f"_first_{key}"))
    return c.join(B.bounded_broadcast(first, B.KEYS_BROADCAST_BYTES)[0], key, "left")


#: requests of one component that are settled in one task, and the rounds before
#: components are looked for
COMPONENT_ROWS, FIRST_ROUNDS = 50_000, 3


def _settle_in_order(table):
    """The requests of one component that are accepted one after the other by seq."""
    rows = table.sort_by("seq")
    taken: tuple[set, set] = (set(), set())
    won = []
    for i, own in enumerate(zip(rows.column("mobile_no").to_pylist(), rows.column("email").to_pylist())):
        if not any(v in t for v, t in zip(own, taken)):
            won.append(i)
            for v, t in zip(own, taken):
                if v is not None:
                    t.add(v)
    return rows.take(won).select(["seq", "mobile_no"])


def _settle_workers(w: DataFrame) -> DataFrame:
    """Accepted worker sign-ups (seq, mobile_no), one after the other by seq.

    A request is accepted if neither its mobile number nor its e-mail belongs to
    a request accepted before it.  A few rounds settle what does not hang on long
    chains.  What is left falls into components, linked by the first request of
    each mobile number and e-mail, and every component is settled in order by
    one task.  Only components beyond COMPONENT_ROWS go by rounds to the end.
    ``w``: open requests (seq, mobile_no, email).
    """
    done, opened = _settle_by_rounds(w, FIRST_ROUNDS)
    return done if opened.isEmpty() else done.unionByName(_settle_components(opened))


def _settle_components(opened: DataFrame) -> DataFrame:
    """The accepted of the open requests, component by component."""
    links = None
    for key in ("mobile_no", "email"):
        first = opened.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
        # written, so that a key that a third of them share can be split in the join
        first, _ = B.materialized(first.where("_n > 1").select(F.col(key), "_first"), "first")
        own = opened.join(first, key).select("seq", "_first")
        links = own if links is None else links.unionByName(own)
    of, _ = B.materialized(components(links), "components")
    grouped = opened.join(of.withColumnRenamed("node", "seq"), "seq", "left")
    alone = grouped.where(F.col("root").isNull()).select("seq", "mobile_no")
    sizes = of.groupBy("root").agg(F.count("*").alias("_n"))
    sized, _ = B.materialized(grouped.join(sizes, "root"), "sized")
    small = (sized.where(F.col("_n") <= COMPONENT_ROWS).select("root", "seq", "mobile_no", "email")
             .groupBy("root").applyInArrow(_settle_in_order, "seq long, mobile_no string"))
    large, _ = _settle_by_rounds(sized.where(F.col("_n") > COMPONENT_ROWS))
    return B.materialized(alone.unionByName(small).unionByName(large), "settled")[0]


def _settle_by_rounds(w: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, open) after ``most`` rounds: each accepts every open request that
    is the earliest open one for both its keys, and drops those it makes
    duplicates of."""
    opened, _ = B.materialized(w.select("seq", "mobile_no", "email"), "open")
    done, rounds = opened.where("false"), 0
    while rounds != most and not opened.isEmpty():
        rounds += 1
        mine = opened
        for key in ("mobile_no", "email"):
            first = (opened.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("_first"))
                     .select(F.col(key), "_first"))
            mine = (mine.join(first, key, "left")
                    .where(F.col(key).isNull() | (F.col("seq") == F.col("_first"))).drop("_first"))
        won, _ = B.materialized(mine.select("seq", "mobile_no", "email"), "won")
        done = done.unionByName(won)
        opened = opened.join(won.select("seq"), "seq", "left_anti")
        for key in ("mobile_no", "email"):
            opened = opened.join(won.where(F.col(key).isNotNull()).select(key), key, "left_anti")
        opened, _ = B.materialized(opened.select("seq", "mobile_no", "email"), "open")
    return done.select("seq", "mobile_no"), opened


ACCOUNT_KINDS = ("customer", "supplier", "user", "worker")


def register_accounts(t: Tables, changes: DataFrame, kinds: tuple[str, ...] = ACCOUNT_KINDS) -> dict[str, Applied]:
    """C-16 sign-ups of customers, suppliers, workers and users; only the
    ``kinds`` asked for are built.

    Inputs are trimmed (T-23: everywhere, a documented deviation for
    workers).  An e-mail (for workers the mobile number, then the e-mail)
    already stored, or taken by an earlier accepted change of the batch, is
    rejected.  Worker ids are shown as ``PF<id>``.  ``changes``: seq, kind,
    name, email, mobile_no.
    """
    c = changes.select("seq", "kind", F.trim("name").alias("name"), F.trim("email").alias("email"),
                       F.trim("mobile_no").alias("mobile_no"))

    def by_email(kind: str, table: DataFrame, id_col: str | None, columns: dict[str, str]) -> Applied:
        k = c.where(F.col("kind") == kind)
        required = ~(X.blank("name") | X.blank("email") | X.blank("mobile_no"))
        k, _ = _with_found(k, table, ["email"])
        k = _first_writer(k, "email", required & ~F.col("_found"))
        checked = k.withColumn("reason", first_failing(
            (~required, "All fields are required"),
            (F.col("_found") | (F.col("seq") != F.col("_first_email")), "Email already exists"))
        ).drop("_found", "_first_email")
        accepted, rejects = _split(checked)
        if id_col:
            accepted = dense_ids(accepted, _next_id(table, id_col), id_col)
        new_rows = accepted.select(*[F.col(v).alias(n) for n, v in columns.items()])
        return Applied(table.unionByName(new_rows), rejects, accepted, inserted=new_rows)

    def workers() -> Applied:
        w = c.where(F.col("kind") == "worker")
        w, _ = _with_found(w, t.worker, ["mobile_no"], flag="_mob")
        w, _ = _with_found(w, t.worker, ["email"], flag="_mail")
        w = _MATERIALIZE[-1](w)
        won = _settle_workers(w.where(~F.col("_mob") & ~F.col("_mail")))
        # accepted mobile numbers are distinct: one row per key
        taken = won.where("mobile_no is not null").select("mobile_no", F.col("seq").alias("_by"))
        w = (w.join(taken, "mobile_no", "left")
             .join(won.select("seq", F.lit(True).alias("_won")), "seq", "left"))
        checked = w.withColumn("reason", first_failing(
            (F.col("_mob") | (F.col("_by") < F.col("seq")), "Mobile number already exists"),
            (F.col("_won").isNull(), "Email already registered as a user"))).drop("_mob", "_mail", "_by", "_won")
        accepted, rejects = _split(checked)
        accepted = dense_ids(accepted, _next_id(t.worker, "id"), "id")
        accepted = accepted.withColumn("worker_code", F.concat(F.lit("PF"), F.col("id").cast("string")))
        new_rows = accepted.select("id", "name", "email", "mobile_no")
        return Applied(t.worker.unionByName(new_rows), rejects, accepted, inserted=new_rows)

    build = {
        "customer": lambda: by_email("customer", t.customer, "customer_id", {
            "customer_id": "customer_id", "customer_name": "name", "mobile_no": "mobile_no", "email": "email"}),
        "supplier": lambda: by_email("supplier", t.supplier, "supplier_id", {
            "supplier_id": "supplier_id", "name": "name", "email": "email", "mobile_no": "mobile_no"}),
        # users: serviceId is the name field of the feed
        "user": lambda: by_email("user", t.users, None, {"serviceId": "name", "email": "email", "phone": "mobile_no"}),
        "worker": workers,
    }
    return dict(zip(kinds, together(t.spark, *[build[kind] for kind in kinds])))
