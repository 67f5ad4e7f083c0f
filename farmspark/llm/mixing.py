"""Mixing sources to target weights by whole repetitions and Bernoulli copies.

Tokens (words) are summed per source, targets follow from the weights, and a
document of a source with rate r = target / tokens is emitted floor(r) times
plus once more with probability r - floor(r), decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farmspark.llm.shared import WORD, doc_text, fresh, same, saved, shuffle_partitions

#: no source is repeated more often than this
MAX_RATE = 3
#: weights by rank of the source, repeating
WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame, text_col: str = "text"):
    return F.regexp_count(doc_text(text_col), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame, column: str = "source") -> DataFrame:
    """``sources`` plus ``rank`` from 0 by code point, null last.

    Range partitions are numbered one by one and shifted by the sizes of those
    before them, so no task sees all sources.
    """
    spark = sources.sparkSession
    order = [F.col(column).isNull(), F.col(column)]
    dealt = saved(sources.repartitionByRange(shuffle_partitions(spark), *order)
                  .withColumn("part", F.spark_partition_id()), "sources")
    # one row per range partition
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(before, "part").select(*sources.columns, (F.col("own") + F.col("before")).alias("rank"))


def targets(sources: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size).

    The sources share the sum of all sizes by weight; a target stops at
    ``max_rate`` times its source's size and the excess is shared again among
    the others, until none is above.  Sources without words get 0.

    A growing share fills the sources up in order of limit over weight.  What
    stands before a source in that order is full when the source is next, so
    running sums give the share of that moment; the first one that leaves its
    source at or below its limit holds.  The sums are taken per range partition
    and shifted by the partitions before, whatever the number of sources.
    """
    spark = sources.sparkSession
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    fill = [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    dealt = saved(ranked(sources).select("source", "source_size", w.cast("long").alias("weight"),
                                         (F.col("source_size") * max_rate).alias("most"))
                  .repartitionByRange(shuffle_partitions(spark), *fill).withColumn("part", F.spark_partition_id()), "weights")
    # one row per range partition; sums of whole numbers, the same whatever the order of the rows
    parts = dealt.groupBy("part").agg(*[F.sum(c).alias(f"{c}_sum") for c in ("source_size", "most", "weight")])
    so_far, all_parts = Window.orderBy("part"), Window.partitionBy()
    parts = parts.select("part", F.sum("source_size_sum").over(all_parts).alias("total"),
                         (F.sum("most_sum").over(so_far) - F.col("most_sum")).alias("full_before"),
                         (F.sum("weight_sum").over(all_parts) - F.sum("weight_sum").over(so_far)
                          + F.col("weight_sum")).alias("open_from"))
    earlier = Window.partitionBy("part").orderBy(*fill).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.col("full_before") - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    open_weight = F.col("open_from") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    shares = dealt.join(parts, "part").withColumn("share", left / open_weight)
    holds = shares.where(F.col("weight") * F.col("share") <= F.col("most"))
    share = holds.agg(F.min_by("share", F.struct(*fill)).alias("share")).first().share
    # no source is below its limit where max_rate is less than 1
    share = F.lit(float("inf") if share is None else share)
    target = F.least(F.col("weight") * share, F.col("most").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return dealt.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def chance(id_col, seed: int):
    """A number in [0, 1) from the MD5 of seed and id (null id: its own text)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, seed: int = 0, weights=WEIGHTS, max_rate: int = MAX_RATE,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, rate, copies.

    Null text has size 0; a null source is a source of its own, last in order.
    Rows that repeat an id are decided alike.  Reruns agree.
    """
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), sized(docs, text_col).alias("size"),
                             F.col(source_col).cast("string").alias("source")), "sizes")
    aims = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate), "targets")
    aims = aims.withColumnRenamed("source", "of")
    whole = F.floor("rate")
    copies = (whole + (chance("doc_id", seed) < F.col("rate") - whole).cast("long")).alias("copies")
    return (rows.join(aims, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "size", "source", "source_size", "target", "rate", copies))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, max_rate: int = MAX_RATE,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say.

    Nulls count as in :func:`mix_counts`; a repeated row is copied as often as
    its twin, an empty table stays empty.
    """
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), sized(docs, text_col).alias("size"))
    aims = saved(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate), "targets")
    of, rate, copies, copy = (fresh(docs, c) for c in ("_of", "_rate", "_copies", "_copy"))
    aims = aims.select(F.col("source").alias(of), F.col("rate").alias(rate))
    whole = F.floor(rate)
    number = (whole + (chance(id_col, seed) < F.col(rate) - whole).cast("long")).cast("int")
    return (docs.join(aims, F.col(source_col).cast("string").eqNullSafe(F.col(of))).withColumn(copies, number)
            .where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
            .select(*same(docs)))
