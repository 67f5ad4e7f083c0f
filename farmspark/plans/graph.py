"""Connected components of a table of links, by rounds in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.plans.broadcast import materialized


def _to_roots(up: DataFrame) -> DataFrame:
    """(hi, lo) pointers, each to a smaller node, followed to their ends: the
    way halves with every join."""
    while True:
        then = up.select(F.col("hi").alias("lo"), F.col("lo").alias("_then"))
        moved, _ = materialized(up.join(then, "lo", "left").select("hi", F.coalesce("_then", "lo").alias("lo"),
                                                                   F.col("_then").isNotNull().alias("_moved")), "pointers")
        up = moved.select("hi", "lo")
        if moved.where("_moved").isEmpty():
            return up


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of one integer type):
    the smallest node that it is connected to, itself for a root.

    A round points every node at its smallest neighbour, follows the pointers to
    their roots and keeps the links that still join two roots: in every
    component that is not done at least half of the roots go.
    """
    a, b = (F.col(c) for c in links.columns)
    left, _ = materialized(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "links")
    label = None
    while not left.isEmpty():
        up = _to_roots(left.groupBy("hi").agg(F.min("lo").alias("lo")))
        if label is None:
            label = up
        else:  # roots of the rounds before may have a root now
            then = up.select(F.col("hi").alias("lo"), F.col("lo").alias("_then"))
            label, _ = materialized(label.join(then, "lo", "left").select("hi", F.coalesce("_then", "lo").alias("lo"))
                                    .unionByName(up), "labels")
        high = up.select("hi", F.col("lo").alias("_a"))
        low = up.select(F.col("hi").alias("lo"), F.col("lo").alias("_b"))
        left, _ = materialized(left.join(high, "hi").join(low, "lo", "left").select("_a", F.coalesce("_b", "lo").alias("_b"))
                               .where("_a <> _b").select(F.greatest("_a", "_b").alias("hi"), F.least("_a", "_b").alias("lo"))
                               .distinct(), "links")
    if label is None:
        label = left
    roots = label.select(F.col("lo").alias("hi"), "lo").distinct()
    return label.unionByName(roots).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
