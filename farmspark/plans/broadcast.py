"""Broadcast only behind a size check, in bytes.

Dimension tables read from Parquet need no help: Catalyst knows their size
and ``spark.sql.autoBroadcastJoinThreshold`` (plus AQE's runtime threshold)
already decides, falling back to a sort-merge join.  Catalyst cannot see that
an *aggregate* is small before it has shuffled the other side as well, so a
reduced frame (key sets, per-key changes) is written once into the shared
folder: its size in bytes is then known, the join reads it instead of
computing it again, and a lost executor does not either.  Up to the bound it
is broadcast and the base table is only scanned and probed; beyond it the
ordinary shuffle join is used, with plain shuffles on both sides, so AQE can
split a skewed key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.session import scratch_path

# Parquet bytes up to which request key sets and a batch's reduced changes are
# broadcast: a few times that in an executor's memory.  0 never broadcasts.
KEYS_BROADCAST_BYTES = 16 << 20
UPDATE_BROADCAST_BYTES = 32 << 20


def materialized(df: DataFrame, name: str = "keys") -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read again, and its bytes."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return spark.read.schema(df.schema).parquet(path), size


def bounded_broadcast(df: DataFrame, max_bytes: int) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` if the materialised ``df`` has at most
    ``max_bytes`` bytes, else ``(df, False)``."""
    kept, size = materialized(df)
    return (F.broadcast(kept), True) if size <= max_bytes else (kept, False)


def small_keys_flag(keys: DataFrame, cols: list[str], max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Distinct ``cols`` of ``keys``, broadcast-hinted within the bound; the flag
    tells whether it held.  The distinct is a partial aggregate, so a key
    repeated by a third of the requests is one row per task."""
    return bounded_broadcast(keys.select(*cols).distinct(), KEYS_BROADCAST_BYTES if max_bytes is None else max_bytes)


def small_keys(keys: DataFrame, cols: list[str], max_bytes: int | None = None) -> DataFrame:
    return small_keys_flag(keys, cols, max_bytes)[0]


def restrict_to_keys(big: DataFrame, keys: DataFrame, cols: list[str], max_bytes: int | None = None) -> DataFrame:
    """``big LEFT SEMI JOIN distinct(keys)``.  For a bounded key set the big
    table is only scanned and probed (no shuffle of it); beyond the bound
    it is a shuffle semi-join."""
    return big.join(small_keys(keys, cols, max_bytes), cols, "left_semi")
