"""Hard negatives for anchors, selected slot by slot.

An anchor's positives are its best rows of the same label.  A positive with
score p asks for the best rows of other labels within [share * p, p].  The
windows of an anchor overlap, so the positives' upper limits p1 > p2 > ... split
the scores into disjoint slots (p2, p1], (p3, p2], ...; a row falls into one
slot.  Every task keeps the best k of each slot (a combiner: nothing else is
shuffled), a slot's bests are those of all tasks, and the window of p_i is
answered from the slots i, i+1, ... in descending order: the best k of that
suffix, down to the lower limit.

Scores are integer inner products, computed as blocked matrix products that are
exact: in float32 or double where no partial sum can leave the exact range, in
Python integers elsewhere.  Anchors come in blocks of a bounded size; each is
broadcast and meets every row in one scan of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farmspark.llm.shared import saved
from farmspark.llm.vectors import finite, matrix
from farmspark.plans.ids import dense_ids

#: anchors of one block and bytes of their vectors, the bound of what is broadcast
BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 8 << 20
#: cells of one score matrix
TILE_CELLS = 1 << 19
_LONG = (-(1 << 63), (1 << 63) - 1)


def reach(x: np.ndarray) -> float:
    """An upper bound of the length of the rows."""
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())) * 1.001 if x.size else 0.0


def inner(rows: np.ndarray, anchors: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; ``bound``: no partial sum is larger.  Beyond the
    range of a long its nearest value stands."""
    if bound < 1 << 24:
        return (rows.astype(np.float32) @ anchors.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    exact = rows.astype(object) @ anchors.astype(object).T
    return np.array([min(max(v, _LONG[0]), _LONG[1]) for v in exact.ravel()], np.int64).reshape(exact.shape)


class Best:
    """The best ``k`` rows of each group: highest score, then smallest id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        #: score of the group's k-th row so far: what is below it is out
        self.floor = np.full(groups, _LONG[0], np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        #: rows held before those that can no longer be returned are dropped
        self.most = max(1 << 14, 2 * groups * k)

    def push(self, group, score, who, row) -> None:
        self.parts.append((group, score, who, row))
        self.held += len(group)
        if self.held >= self.most:
            self._prune()

    def _prune(self) -> None:
        group, score, who, row = (np.concatenate(x) for x in zip(*self.parts))
        # descending scores: ~score is -score - 1 and cannot overflow
        order = np.lexsort((row, who, ~score, group))
        group, score, who, row = group[order], score[order], who[order], row[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        keep = place < self.k
        full = place == self.k - 1
        self.floor[group[full]] = score[full]
        self.parts = [(group[keep], score[keep], who[keep], row[keep])]
        self.held = int(keep.sum())

    def rows(self) -> tuple[np.ndarray, ...]:
        if self.parts:
            self._prune()
            return self.parts[0]
        return tuple(np.empty(0, np.int64) for _ in range(4))


def _tiles(n_rows: int, n_anchors: int) -> Iterator[tuple[slice, slice]]:
    wide = max(1, min(n_anchors, 1024))
    tall = max(1, TILE_CELLS // wide)
    for i in range(0, n_rows, tall):
        for j in range(0, n_anchors, wide):
            yield slice(i, i + tall), slice(j, j + wide)


def _top(score: np.ndarray, mask: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """``mask`` without cells that are below their column's floor or its own k-th best."""
    if len(score) > 4 * k and (floor == _LONG[0]).any():
        kth = np.partition(np.where(mask, score, _LONG[0]), len(score) - k, axis=0)[len(score) - k]
        floor = np.maximum(floor, kth)
    return mask & (score >= floor)


def _positives(block, k: int):
    """(anchor, -1, score, id, row) of the best rows of the anchor's own label."""
    def mine(batches):
        a = block.value
        best = Best(len(a["row"]), k)
        of = {v: np.flatnonzero(a["label"] == v) for v in np.unique(a["label"])}
        for batch in batches:
            if not batch.num_rows:
                continue
            who, row, label = (batch.column(c).to_numpy() for c in ("id", "row", "label"))
            x = matrix(batch.column("x"), a["x"].shape[1])
            for v in np.unique(label):
                if v not in of:
                    continue
                at, to = np.flatnonzero(label == v), of[v]
                for i, j in _tiles(len(at), len(to)):
                    r, c = at[i], to[j]
                    score = inner(x[r], a["x"][c], reach(x[r]) * a["reach"])
                    other = row[r][:, None] != a["row"][c][None, :]
                    n, m = np.nonzero(_top(score, other, k, best.floor[c]))
                    best.push(c[m], score[n, m], who[r][n], row[r][n])
        yield _answers(a, *best.rows(), np.ones(1, np.int64))
    return mine


def _negatives(block, k: int, share: tuple[int, int]):
    """(anchor, slot, score, id, row) of the best rows of other labels per slot."""
    part, whole = share

    def mine(batches):
        a = block.value
        limits = a["limits"]  # descending, filled with the smallest of the row
        slots = limits.shape[1]
        best = Best(len(a["row"]) * slots, k)
        # Python integers: a hundredfold score may leave the range of a long
        least = np.array([[-(-part * int(p) // whole) if p >= 0 else _LONG[1] for p in row] for row in limits], np.int64)
        lowest = least.min(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            who, row, label = (batch.column(c).to_numpy() for c in ("id", "row", "label"))
            x = matrix(batch.column("x"), a["x"].shape[1])
            for i, j in _tiles(len(who), len(a["row"])):
                score = inner(x[i], a["x"][j], reach(x[i]) * a["reach"])
                n, m = np.nonzero((score <= limits[j, 0]) & (score >= lowest[j]) & (label[i][:, None] != a["label"][j][None, :]))
                value, c = score[n, m], m + j.start
                # the slot whose limit is the smallest that is not below the score
                slot = (limits[c] >= value[:, None]).sum(axis=1) - 1
                # of equal limits that fill a row up the first stands for all
                slot = a["first"][c, slot]
                group = c * slots + slot
                keep = (value >= least[c, slot]) & (value >= best.floor[group])
                best.push(group[keep], value[keep], who[i][n[keep]], row[i][n[keep]])
        yield _answers(a, *best.rows(), np.int64(slots).reshape(1))
    return mine


def _answers(a, group, score, who, row, slots):
    import pyarrow as pa
    return pa.record_batch([pa.array(a["row"][group // slots[0]]), pa.array((group % slots[0]).astype(np.int32)),
                            pa.array(score), pa.array(who), pa.array(row)], ["anchor", "slot", "score", "id", "row"])


_FOUND = "anchor long, slot int, score long, id long, row long"


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every (anchor, slot) over all tasks, with ``place``."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _blocks(anchors: DataFrame, dim: int, most: int) -> Iterator[dict]:
    """The anchors as arrays, one block of at most BLOCK_BYTES of vectors at a time."""
    each = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))
    for b in range(-(-most // each)):
        part = anchors.where((F.col("nr") > b * each) & (F.col("nr") <= (b + 1) * each)).orderBy("nr").toArrow()
        if not part.num_rows:
            continue
        out = {c: part.column(c).to_numpy() for c in ("row", "label")}
        out["x"] = matrix(part.column("x").combine_chunks(), dim)
        out["reach"] = reach(out["x"])
        if "limits" in part.column_names:
            lists = part.column("limits").to_pylist()
            width = max(map(len, lists))
            out["limits"] = np.array([v + v[-1:] * (width - len(v)) for v in lists], np.int64)
            place = np.broadcast_to(np.arange(width), out["limits"].shape)
            out["first"] = np.minimum(place, np.array([len(v) - 1 for v in lists])[:, None])
        yield out


def _scan(rows: DataFrame, anchors: DataFrame, dim: int, most: int, search, name: str) -> DataFrame:
    """``search(block)`` over all rows for every anchor block, written block by block."""
    spark = rows.sparkSession
    found = None
    for arrays in _blocks(anchors, dim, most):
        block = spark.sparkContext.broadcast(arrays)
        part = saved(rows.mapInArrow(search(block), _FOUND), name)
        block.destroy()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _FOUND) if found is None else found


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 5,
         share: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """One row per anchor, positive and chosen negative: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score.

    Entries become floor(scale * entry).  ``is_anchor`` is a condition on the
    columns of ``vectors``.  Positives are the first ``n_positives`` other rows
    of the anchor's label, negatives of a positive the first ``n_negatives`` rows
    of another label with share * positive <= negative <= positive; higher
    scores come first, ties by smaller id.  Rows whose id, label or vector is
    null or that hold a null or non-finite entry take no part.  Repeated rows
    are rows of their own.  Vectors of different length compare as if filled up
    with zeros; inner products beyond a long count as its nearest value.  Empty
    tables, and anchors without positives, give no rows.
    """
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    rows = saved(vectors.where(finite(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
                 .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.col(label_col).cast("long").alias("label"), x.alias("x"),
                         F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "vectors")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    table = rows.select("row", "id", "label", "x")

    anchors = saved(dense_ids(rows.where("is_anchor").select("row", "id", "label", "x"), F.lit(0), "nr", "row"), "anchors")
    most = anchors.agg(F.max("nr")).first()[0] or 0
    near = _scan(table, anchors, dim, most, lambda b: _positives(b, n_positives), "positives")
    positives = saved(_best_of(near, n_positives)
                      .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("limit"), "place"), "positives")

    # at most n_positives limits an anchor: the upper ends of its slots, descending
    limits = positives.groupBy("anchor").agg(F.reverse(F.array_sort(F.collect_set("limit"))).alias("limits"))
    asking = saved(anchors.join(limits.withColumnRenamed("anchor", "row"), "row"), "limits")
    found = _scan(table, asking, dim, most, lambda b: _negatives(b, n_negatives, share), "negatives")
    # at most n_positives * n_negatives rows an anchor, best first
    slots = (_best_of(found, n_negatives).groupBy("anchor")
             .agg(F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("best")))

    part, whole = share
    wide = "decimal(38,0)"
    suffix = F.slice(F.filter("best", lambda n: n["slot"] >= F.col("own")), 1, n_negatives)
    within = F.filter(suffix, lambda n: n["score"].cast(wide) * whole >= F.col("limit").cast(wide) * part)
    own = F.array_position("limits", F.col("limit")) - 1
    return (positives.join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "limits"), "anchor")
            .join(slots, "anchor").withColumn("own", own)
            .select("anchor_id", "positive_id", F.col("limit").alias("positive_score"), F.posexplode(within).alias("at", "n"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score")))
