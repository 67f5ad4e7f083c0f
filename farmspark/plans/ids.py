"""Dense new ids for inserted rows (MySQL auto-increment, ``insertId``).

``id = max(existing id) + rank of the accepted change by seq``.  A single
``row_number() over (order by seq)`` would sort the whole batch in one task,
so the rank is computed in two passes instead (the zipWithIndex idea, with
DataFrame operators): changes are dealt to range partitions of seq and written
once, the partitions are counted and prefix-summed (one row per partition), and
the rank inside a partition is a window partitioned by it.  Range bounds follow
the values that are there, so sparse or clock-like sequence numbers make no
difference.  ``monotonically_increasing_id`` is not dense and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farmspark.plans.broadcast import materialized


def dense_ids(df: DataFrame, base: Column, out: str, seq: str = "seq", parts: int | None = None) -> DataFrame:
    """Add ``out = base + rank(seq)`` (1-based, dense) to ``df``.

    ``base`` is a scalar column, typically ``table.agg(max(id)).scalar()``.
    ``seq`` must be unique within ``df``.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = materialized(df.repartitionByRange(parts, seq).withColumn("_part", F.spark_partition_id()), "ids")
    # one row per range partition
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    ranked = dealt.withColumn("_rk", F.row_number().over(Window.partitionBy("_part").orderBy(seq)))
    return (ranked.join(offsets, "_part", "inner")
            .withColumn(out, (F.coalesce(base, F.lit(0)) + F.col("_off") + F.col("_rk")).cast("long"))
            .drop("_part", "_rk", "_off"))
