"""Versioned table snapshots.

A snapshot root holds data parts, written once and never changed, and
``_versions/<n>.json`` manifests.  A manifest names the parts every table consists
of, the request batches that are in it and, per stream, its last micro-batch.

* A part of a table laid out by month lists its live months; an update writes
  the touched months again and takes them from the older parts.
* A part of any other table may have *keys* beside its rows: it replaces all
  older rows with these keys (an update of one row is a part of one row, a
  delete a part without rows).  Readers drop replaced rows in one join with the
  last part of every key.
* Parts carry the range of their ids per month, so rows of given ids are looked
  for in the months that can hold them, and Parquet Bloom filters of the ids.

A version is published by one step that fails if another job was first
(:func:`commit`).  Then the newest manifest is read, and where the changes of
both jobs commute they are published on top of it: changes commute if they touch
different months or keys, and only one of them hands out new ids of a table.

All paths go through Spark's file system, none through the driver's own disk.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farmspark.functions.exprs import PART_COL, PARTITIONED, ym_of
from farmspark.plans import broadcast as B
from farmspark.sources import schemas

VERSIONS = "_versions"
#: id column of the tables that are looked up or changed by it
KEYS = {"customer_order": "order_id", "supply_orders": "supply_order_id", "inventory": "item_id", "worker": "id",
        "task": "task_id"}
#: file systems whose rename fails if the target is there
RENAMES = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: parts of one size class that are merged, and the smallest class's bytes
FAN_IN, SMALL_BYTES = 8, 1 << 20


class Conflict(RuntimeError):
    """Another job has published changes that do not commute with these."""


@dataclass
class Manifest:
    version: int = 0
    tables: dict[str, list[dict]] = field(default_factory=dict)
    #: digest of a request batch -> what its job returned
    batches: dict[str, dict] = field(default_factory=dict)
    #: id of a streaming query -> its last micro-batch
    streams: dict[str, int] = field(default_factory=dict)


@dataclass
class Edit:
    """One table's change: parts added, and (path, months) taken away (months
    None: the whole part).  ``new_ids``: the rows added have ids that were
    handed out from the table as it was; ``whole``: they are the whole table."""
    table: str
    add: list[dict] = field(default_factory=list)
    drop: list[tuple[str, list[int | None] | None]] = field(default_factory=list)
    new_ids: bool = False
    whole: bool = False


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _join(root: str, *names: str) -> str:
    return "/".join([root.rstrip("/"), *names])


# ------------------------------------------------------------------ manifests

def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, _join(root, VERSIONS))
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The newest manifest (or that of ``version``); an empty one if there is none."""
    numbers = versions(spark, root) if version is None else [version]
    if not numbers:
        return Manifest()
    n = numbers[-1]
    text = spark.read.text(_join(root, VERSIONS, f"{n:08d}.json"), wholetext=True).first()[0]
    said = json.loads(text)
    return Manifest(n, said["tables"], said.get("batches", {}), said.get("streams", {}))


def latest(spark: SparkSession, root: str) -> tuple[int, dict[str, list[dict]]]:
    """(version, parts of each table) of the newest manifest; (0, {}) without one."""
    m = manifest(spark, root)
    return m.version, m.tables


def _put(spark: SparkSession, root: str, m: Manifest) -> bool:
    """Publish ``m`` as its version, in one step; False if that version is there."""
    text = bytearray(json.dumps({"tables": m.tables, "batches": m.batches, "streams": m.streams}), "utf-8")
    fs, folder = _fs(spark, _join(root, VERSIONS))
    fs.mkdirs(folder)
    _, final = _fs(spark, _join(root, VERSIONS, f"{m.version:08d}.json"))
    if fs.exists(final):
        return False
    if fs.getUri().getScheme() not in RENAMES:
        return _create(fs, final, text)
    _, draft = _fs(spark, _join(root, VERSIONS, f"draft-{uuid.uuid4().hex}"))
    out = fs.create(draft, False)
    out.write(text)
    out.close()
    if not fs.exists(final) and fs.rename(draft, final):
        return True
    fs.delete(draft, False)
    return False


def _create(fs, final, text: bytearray) -> bool:
    """An object store has no rename: it has to create the object only if there
    is none.  A store that cannot is refused (``must`` fails there)."""
    out = fs.createFile(final).overwrite(False).must("fs.option.create.conditional.overwrite", True).build()
    try:
        out.write(text)
        out.close()
    except Exception as e:  # the store's own error for an object that is there
        if fs.exists(final):
            return False
        raise e
    return True


def commit(spark: SparkSession, root: str, base: Manifest, edits: list[Edit], batch: tuple[str, dict] | None = None,
           stream: tuple[str, int] | None = None, rebase: bool = True) -> Manifest:
    """Publish ``edits``, made for the version ``base``, as the next version.

    If other jobs have published meanwhile, the edits are applied to the newest
    version where they commute with theirs; else, or without ``rebase``, a
    :class:`Conflict`.  A batch or micro-batch that is in the newest version
    already is not applied again.
    """
    now = base
    while True:
        if batch and batch[0] in now.batches or stream and now.streams.get(stream[0], -1) >= stream[1]:
            return now
        tables = dict(now.tables)
        for e in edits:
            tables[e.table] = _applied(spark, e, base.tables.get(e.table, []), now.tables.get(e.table, []), now.version + 1)
        new = Manifest(now.version + 1, tables, {**now.batches, **(dict([batch]) if batch else {})},
                       {**now.streams, **(dict([stream]) if stream else {})})
        if _put(spark, root, new):
            return new
        if not rebase:
            raise Conflict(f"version {new.version} of {root} was published by another job; apply the batch to it")
        now = manifest(spark, root)


def _applied(spark: SparkSession, e: Edit, base: list[dict], now: list[dict], version: int) -> list[dict]:
    """The parts of a table with the edit, given those it was made for and the newest.

    A part's ``order`` is the version that it came with (a merged part has that
    of the newest part it holds): later parts replace rows of earlier ones.
    """
    known = {p["path"]: p for p in base}
    added = [p for p in now if p["path"] not in known]
    if e.whole and added:
        raise Conflict(f"{e.table}: another job has changed the table; apply the batch again")
    if e.new_ids and any(p.get("new_ids") for p in added):
        raise Conflict(f"{e.table}: another job has handed out new ids; apply the batch again")
    keyed = [p for p in e.add if p.get("keys")]
    for p in keyed:
        if any(o.get("keys") and _share_keys(spark, p, o) for o in added):
            raise Conflict(f"{e.table}: another job has changed the same rows; apply the batch again")
    parts = {p["path"]: p for p in now}
    for path, months in e.drop:
        p = parts.get(path)
        if p is None or (p["months"] != known[path]["months"] if months is None else not set(months) <= set(p["months"])):
            raise Conflict(f"{e.table}: another job has written the same months; apply the batch again")
        left = [] if months is None else [m for m in p["months"] if m not in months]
        if left:
            parts[path] = {**p, "months": left, "gone": p.get("gone", []) + list(months)}
        else:
            del parts[path]
    return sorted([*parts.values(), *({**p, "order": p.get("order", version)} for p in e.add)], key=lambda p: p.get("order", 0))


def _folder(part: dict) -> str:
    """Name of a part's folder below its table's; empty for a plain table folder."""
    name = part["path"].rsplit("/", 1)[-1]
    return name if name.startswith("part=") else ""


def _share_keys(spark: SparkSession, a: dict, b: dict) -> bool:
    left, right = (spark.read.parquet(p["keys"]) for p in (a, b))
    return not left.join(right, left.columns, "left_semi").isEmpty()


# ---------------------------------------------------------------------- parts

def table_schema(name: str) -> T.StructType:
    schema = schemas.BUSINESS[name]
    if name in PARTITIONED:
        # the month partition column rides along so date filters can prune
        return T.StructType(schema.fields + [T.StructField(PART_COL, T.IntegerType(), True)])
    return schema


def _in_months(months: list[int | None]) -> Column:
    some = F.coalesce(F.col(PART_COL).isin([m for m in months if m is not None]), F.lit(False))
    return some | F.col(PART_COL).isNull() if None in months else some


def _scans(spark: SparkSession, name: str, parts: list[dict]) -> list[DataFrame]:
    """The rows of the parts with their ``part``: one scan for all parts of a root."""
    schema = table_schema(name)
    frames, roots = [], {}
    for p in parts:
        if _folder(p):
            roots.setdefault(p["path"].rsplit("/", 1)[0], []).append(p)
        else:  # a plain folder
            df = spark.read.schema(schema).parquet(p["path"])
            frames.append((df.where(_in_months(p["months"])) if name in PARTITIONED else df).withColumn("part", F.lit("")))
    for root, own in roots.items():
        df = (spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())]))
              .option("basePath", root).parquet(*[p["path"] for p in own]))
        for p in own:
            if p.get("gone"):
                df = df.where((F.col("part") != _folder(p)[5:]) | ~_in_months(p["gone"]))
        frames.append(df.select(*schema.fieldNames(), "part"))
    return frames


def read_table(spark: SparkSession, name: str, parts: list[dict], months: list[int | None] | None = None) -> DataFrame:
    """The rows of a table; ``months``: of these months only."""
    schema = table_schema(name)
    if months is not None:
        parts = [p for p in parts if set(p["months"]) & set(months)]
    frames = _scans(spark, name, [p for p in parts if p["months"] is None or p["months"]])
    if not frames:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, frames)
    if months is not None:
        rows = rows.where(_in_months(months))
    return _latest_rows(spark, rows, name, parts).select(*schema.fieldNames())


def _latest_rows(spark: SparkSession, rows: DataFrame, name: str, parts: list[dict]) -> DataFrame:
    """``rows`` (with ``part``) without those whose key a later part has replaced.

    The last part of every key is an aggregate over the keys of the changes
    only; it is broadcast if their files are small, else the join is a shuffle.
    """
    keyed = [p for p in parts if p.get("keys")]
    if not keyed:
        return rows
    key_type = schemas.BUSINESS[name][KEYS[name]].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("part", T.StringType())])
    keys = None
    for root in sorted({p["keys"].rsplit("/", 1)[0] for p in keyed}):
        own = [p["keys"] for p in keyed if p["keys"].rsplit("/", 1)[0] == root]
        df = spark.read.schema(schema).option("basePath", root).parquet(*own)
        keys = df if keys is None else keys.unionByName(df)
    orders = F.create_map(*[F.lit(v) for p in parts for v in (_folder(p)[5:], p.get("order", 0)) if _folder(p)])

    def order(part: Column) -> Column:
        return F.coalesce(orders[part], F.lit(0))

    last = keys.groupBy("key").agg(F.max(order(F.col("part"))).alias("_last"))
    if sum(p["key_bytes"] for p in keyed) <= B.UPDATE_BROADCAST_BYTES:
        last = F.broadcast(last)
    return (rows.join(last, F.col(KEYS[name]) == F.col("key"), "left")
            .where(F.col("_last").isNull() | (order(F.col("part")) >= F.col("_last"))).drop("_last", "key"))


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def write_part(df: DataFrame, root: str, name: str, new_ids: bool = False, keys: DataFrame | None = None) -> dict:
    """Write rows of one table as a new part of ``root``.

    Month folders are clustered first, large months over several tasks.
    ``keys`` (one column): the part replaces all older rows with these keys.
    """
    spark = df.sparkSession
    fields = schemas.BUSINESS[name].fields
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
    folder = f"part={uuid.uuid4().hex}"
    path = _join(root, "data", name, folder)
    if name in PARTITIONED:
        out = out.withColumn(PART_COL, ym_of(PARTITIONED[name])).hint("rebalance", PART_COL)
    w = out.write
    if name in KEYS:
        w = w.option(f"parquet.bloom.filter.enabled#{KEYS[name]}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (w.partitionBy(PART_COL) if name in PARTITIONED else w).parquet(path)
    part = adopt(spark, path, name) | {"bytes": _bytes(spark, path), "new_ids": new_ids}
    if keys is not None:
        part["keys"] = _join(root, "keys", name, folder)
        keys.select(F.col(keys.columns[0]).alias("key")).distinct().write.parquet(part["keys"])
        part["key_bytes"] = _bytes(spark, part["keys"])
    return part


def adopt(spark: SparkSession, path: str, name: str) -> dict:
    """The part that a written table folder is: its months and their ids."""
    if name not in PARTITIONED:
        return {"path": path, "months": None}
    rows = spark.read.schema(table_schema(name)).parquet(path)
    key = KEYS.get(name)
    ends = [F.min(key), F.max(key)] if key else [F.lit(None), F.lit(None)]
    # one row per month
    found = sorted(([*r] for r in rows.groupBy(PART_COL).agg(*ends).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return {"path": path, "months": [r[0] for r in found], "ids": [r for r in found if r[1] is not None]}


def months_of_ids(parts: list[dict], requested: DataFrame, key: str) -> list[int | None] | None:
    """Months whose range of ids holds a requested id; None: all of them.

    One aggregate over the requests, one condition per month; no base row is read.
    """
    if any("ids" not in p for p in parts):
        return None
    ends: dict[int | None, list[tuple[int, int]]] = {}
    for p in parts:
        for month, low, high in p["ids"]:
            if month in p["months"]:
                ends.setdefault(month, []).append((low, high))
    if not ends:
        return []
    order = list(ends)
    hits = [F.max(reduce(lambda a, b: a | b, [F.col(key).between(*r) for r in ends[m]])).alias(f"m{i}")
            for i, m in enumerate(order)]
    row = requested.agg(*hits).first()
    return [m for i, m in enumerate(order) if row[i]]


def touched_months(base: DataFrame, accepted: DataFrame, keys: list[str]) -> list[int | None]:
    """Months of the rows of ``base`` that share ``keys`` with an accepted change."""
    hit = base.join(accepted.select(*keys).distinct(), keys, "left_semi")
    return [r[0] for r in hit.select(PART_COL).distinct().collect()]


def drops(parts: list[dict], months: list[int | None] | None = None) -> list[tuple[str, list[int | None] | None]]:
    """What an edit takes from ``parts`` to write ``months`` (None: everything) again."""
    if months is None:
        return [(p["path"], None) for p in parts]
    own = [(p["path"], [m for m in p["months"] if m in months]) for p in parts]
    return [(path, m) for path, m in own if m]


# ----------------------------------------------------------------- compaction

def _size_class(part: dict) -> int:
    size, c = part.get("bytes"), 0
    if size is None:  # a plain folder of unknown size stays as it is
        return 1 << 30
    while size > SMALL_BYTES * FAN_IN ** c:
        c += 1
    return c


def merge_run(parts: list[dict], ordered: bool) -> list[dict]:
    """The parts to merge next: FAN_IN or more of a size class and smaller ones.

    Parts with keys only mean something in their order, so of an ``ordered``
    table the newest parts in a row are taken.
    """
    for c in sorted({_size_class(p) for p in parts}):
        if c == 1 << 30:
            break
        run = [p for p in parts if _size_class(p) <= c]
        if ordered:
            n = 0
            while n < len(parts) and _size_class(parts[-1 - n]) <= c:
                n += 1
            run = parts[len(parts) - n:]
        if len(run) >= FAN_IN:
            return run
    return []


def compact(spark: SparkSession, root: str, name: str, everything: bool = False) -> bool:
    """Merge small parts of a table, size class by size class; whether there
    were any.  ``everything``: all parts become one.

    What it merges stays in older versions until :func:`expire`; changes that
    other jobs publish meanwhile commute with it.
    """
    m = manifest(spark, root)
    parts = m.tables.get(name, [])
    ordered = name not in PARTITIONED
    run = parts if everything else merge_run(parts, ordered)
    if not run or len(run) == 1 and not run[0].get("keys") and not run[0].get("gone"):
        return False
    rows = read_table(spark, name, run)
    keyed = [p for p in run if p.get("keys")]
    keys = None
    if keyed and len(run) < len(parts):
        # older parts outside the run still hold rows that these keys replace
        keys = reduce(DataFrame.unionByName, [spark.read.parquet(p["keys"]) for p in keyed])
    part = write_part(rows, root, name, any(p.get("new_ids") for p in run), keys)
    # whatever is published meanwhile is later
    part["order"] = max(p.get("order", 0) for p in run)
    commit(spark, root, m, [Edit(name, [part], drops(run))])
    return True


def expire(spark: SparkSession, root: str, keep: int = 10, grace_hours: float = 24.0) -> int:
    """Delete versions but the newest ``keep``, and data of this root that no kept
    version names; returns the number of folders deleted.

    Folders younger than ``grace_hours`` stay: a running job may be about to
    publish them.  Other roots that carry parts of this one by reference must
    not outlive its kept versions.
    """
    numbers = versions(spark, root)
    for n in numbers[:-keep]:
        fs, p = _fs(spark, _join(root, VERSIONS, f"{n:08d}.json"))
        fs.delete(p, False)
    live = set()
    for n in numbers[-keep:]:
        for parts in manifest(spark, root, n).tables.values():
            live |= {p["path"].rsplit("/", 1)[-1] for p in parts}
    gone, limit = 0, (time.time() - grace_hours * 3600) * 1000
    for kind in ("data", "keys"):
        fs, top = _fs(spark, _join(root, kind))
        for table in fs.listStatus(top) if fs.exists(top) else []:
            for s in fs.listStatus(table.getPath()):
                if s.getPath().getName() not in live and s.getModificationTime() <= limit:
                    fs.delete(s.getPath(), True)
                    gone += 1
    return gone
