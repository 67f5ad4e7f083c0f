"""Sinks: SNK-1 rows as JSON, SNK-2 report files, SNK-5 outbox.

All writes are distributed (one file per task); nothing passes through the
driver.  Snapshots are written to a new folder and only then published
(T-21 / overwrite-while-reading), see :mod:`farmspark.plans.jobs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farmspark.operators.reports import sort_report
from farmspark.plans.broadcast import materialized
from farmspark.sources import schemas


def write_rows(df: DataFrame, path: str, mode: str = "overwrite", order: list[Column] | None = None) -> None:
    """SNK-1 ``res.json(rows)``: JSON lines, one file per partition.

    ``order``: the rows' order; range partitions are sorted and written as files
    whose names carry it (:func:`read_ordered` gives it back)."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """SNK-2 report data (the PDF layout is not built).

    The global ORDER BY of the reference becomes a range-partitioned sort, so
    part files are in report order and no single task holds the report.
    """
    w = sort_report(df).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """The rows that :func:`write_rows` or :func:`write_report` wrote, with their
    ``position`` from 1.

    Files are in order of their names, splits of a file of their offset, and rows
    of a split come as they stand; splits are numbered one by one and shifted by
    the sizes of those before them, so no task sees all rows.
    """
    read = spark.read.schema(schema).option("header", True).format(fmt).load(path)
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    dealt, _ = materialized(read.select("*", *place, F.monotonically_increasing_id().alias("_row")), "ordered")
    # one row per split of a file
    sizes = dealt.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", "_block", (F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row"))
    return (dealt.withColumn("_own", own).join(before, ["_file", "_block"])
            .select((F.col("_before") + F.col("_own")).cast("long").alias("position"), *[F.col(f"`{c}`") for c in schema.fieldNames()]))


def outbox(*frames: DataFrame) -> DataFrame:
    """SNK-5 union of message frames in the outbox schema."""
    cols = [f.name for f in schemas.OUTBOX.fields]
    out = None
    for f in frames:
        f = f.select(*[F.col(c).cast(schemas.OUTBOX[c].dataType) for c in cols])
        out = f if out is None else out.unionByName(f)
    return out


def append_outbox(df: DataFrame, path: str, batch: str) -> None:
    """Add the messages of one batch to the outbox (delivery is not built).

    Messages live under ``batch=<id>``; writing a batch again replaces its own
    folder, so a retried job sends nothing twice."""
    df.write.mode("overwrite").partitionBy("kind").parquet(f"{path.rstrip('/')}/batch={batch}")
