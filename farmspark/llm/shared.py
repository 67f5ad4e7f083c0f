"""Helpers the operators share: reading tables, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farmspark.session import ensure_checkpoint_dir

#: white space of the contracts, as a Java / DuckDB / Python pattern
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage: what follows neither recomputes ``df`` nor depends on
    the executors that made it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_text(text_col: str = "text"):
    return F.coalesce(F.col(text_col), F.lit(""))


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (a null id falls in fold 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, from ``name``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def same(df: DataFrame) -> list:
    """The columns of ``df`` as they are, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def row_key(id_col: str, text_col: str = "text"):
    """Id and a hash of the text: what tells the rows of a table apart."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
                       F.xxhash64(doc_text(text_col)).cast("string"))


def stay(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_key` is in ``keys`` (column
    ``row_key``), one of each key, with their columns as they were."""
    key, n = fresh(docs, "_key"), fresh(docs, "_n")
    marked = docs.withColumn(key, row_key(id_col, text_col))
    # repeated rows share a key, and the join has brought them together
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return (marked.join(keys.select(F.col("row_key").alias(key)), key, "left_semi")
            .withColumn(n, first).where(F.col(n) == 1).select(*same(docs)))
