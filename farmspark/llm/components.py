"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.shared import saved

_FLUSH = 400_000


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.parent[hi] = lo
            self.parent.setdefault(lo, lo)

    def stars(self) -> tuple[list[int], list[int]]:
        """(node, root) of every node that is not its own root."""
        pairs = [(x, self.root(x)) for x in list(self.parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return [x for x, _ in pairs], [r for _, r in pairs]


def _local_forest(batches):
    import pyarrow as pa

    def out(forest):
        hi, lo = forest.stars()
        return pa.record_batch([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(a, b)
        if len(forest.parent) >= _FLUSH:
            yield out(forest)
            forest = Forest()
    yield out(forest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns).

    ``component`` is the smallest node of the connected component; nodes
    without an edge are absent.  Each round points every node at its smallest
    neighbour, follows the pointers to their roots and keeps the edges that
    still join two roots, so the number of roots at least halves in every
    component that is not done.  Tables go through the shared folder.
    """
    a, b = edges.columns
    edges = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long"), F.col(b).cast("long"))
    left = saved(edges.mapInArrow(_local_forest, "hi long, lo long"), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        to_root = saved(left.groupBy("hi").agg(F.min("lo").alias("lo")), "parents")
        while True:
            up = to_root.select(F.col("hi").alias("lo"), F.col("lo").alias("upper"))
            to_root = saved(to_root.join(up, "lo", "left").select(
                "hi", F.coalesce("upper", "lo").alias("lo"), F.col("upper").isNotNull().alias("moved")), "parents")
            if to_root.where("moved").isEmpty():
                break
            to_root = to_root.drop("moved")
        to_root = to_root.drop("moved")
        rounds.append(to_root)
        hi = to_root.select("hi", F.col("lo").alias("a"))
        lo = to_root.select(F.col("hi").alias("lo"), F.col("lo").alias("b"))
        left = saved(left.join(hi, "hi").join(lo, "lo", "left")
                     .select("a", F.coalesce("b", "lo").alias("b")).where("a != b")
                     .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    done = rounds.pop()
    while rounds:
        later = done.select(F.col("hi").alias("lo"), F.col("lo").alias("final"))
        done = saved(rounds.pop().join(later, "lo", "left").select("hi", F.coalesce("final", "lo").alias("lo"))
                     .unionByName(done), "labels")
    roots = done.select(F.col("lo").alias("hi"), "lo").distinct()
    return done.unionByName(roots).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
