"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

On the unit sphere cosine >= c means a Euclidean distance of at most
sqrt(2 - 2c).  A table hashes a normalised vector by k quantised Gaussian
projections, floor((a . v + b) / width); two vectors at distance d agree in one
of them with probability p(d).  k grows with the logarithm of the number of
vectors, so buckets of unrelated vectors keep their size, and the number of
tables follows from the recall wanted for pairs right at the threshold.

Equal vectors are one class.  Within a bucket every two classes are compared in
double precision; a pair counts in the first table in which it meets, so links
are counted once and no pair is ever emitted: a group gives the number of links
of each class and a forest of its links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farmspark.llm.blocks import GROUP, chunk_pairs, whole_groups
from farmspark.llm.components import components
from farmspark.llm.rolling import _mix
from farmspark.llm.shared import saved
from farmspark.llm.simhash import label

#: quantisation step of a projection, in units of the unit sphere's radius
WIDTH = 1.5
#: unrelated vectors that may share a bucket, and recall at the threshold
BUCKET = 64
RECALL = 0.97
#: classes of one bucket that are compared as one group
GROUP_ROWS = 2048
_TILE = 1024


def agree(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors at ``distance`` in one cell."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float) -> tuple[int, int]:
    """(projections of a table, tables) for ``n`` vectors."""
    near, far = agree(max(math.sqrt(2 - 2 * threshold), 1e-3)), agree(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 2) / BUCKET) / -math.log(far))) if n > BUCKET else 2
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near ** k)))


class Tables:
    """The hash tables for vectors of one dimension; the same in every task."""

    def __init__(self, k: int, tables: int, seed: int):
        self.k, self.tables, self.seed = k, tables, seed
        self.made: dict[int, tuple] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit key per row and table."""
        dim = unit.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            self.made[dim] = (rng.standard_normal((dim, self.k * self.tables)),
                              rng.uniform(0, WIDTH, self.k * self.tables))
        a, b = self.made[dim]
        # row by row the same arithmetic, whatever else is in the batch
        cells = np.floor((np.einsum("ij,jk->ik", unit, a) + b) / WIDTH).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(unit), self.tables, self.k)
        # mixed before the first cell: small cells would cancel small table numbers
        out = np.broadcast_to(_mix(np.arange(self.tables, dtype=np.uint64) + np.uint64(dim << 20)), cells.shape[:2])
        for i in range(self.k):
            out = _mix(out ^ cells[:, :, i])
        return out


def _unit(data: list[bytes]) -> np.ndarray:
    """Unit vectors (double) of equal dimension."""
    rows = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    # scaled first, so that neither huge nor tiny components overflow the sum of squares
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _classes(batches):
    import pyarrow as pa
    for batch in batches:
        digests, data = [], []
        for v in batch.column(1).to_pylist():
            row = None
            if v and None not in v:
                a = np.asarray(v, "<f8") + 0.0
                if np.isfinite(a).all() and a.any():
                    row = a.tobytes()
            digests.append(row and hashlib.blake2b(row, digest_size=16).digest())
            data.append(row)
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(data, pa.binary())],
                              ["vec_id", "digest", "data"])


def _by_dimension(data: list[bytes]):
    size = np.fromiter(map(len, data), np.int64, len(data))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, _unit([data[i] for i in at])


def _hash(tables: Tables):
    def hashed(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, unit in _by_dimension(batch.column("data").to_pylist()):
                keys = tables.keys(unit)
                who = np.repeat(at, keys.shape[1])
                rows = batch.take(pa.array(who))
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)),
                                       pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(at))),
                                       rows.column("cls"), rows.column("n"), rows.column("data")],
                                      ["bucket", "hash_table", "cls", "n", "data"])
    return hashed


def _link(tables: Tables, threshold: float):
    """Per group: (a, b, links): edges of a forest with null links, and (class,
    null, links) with the number of vectors the class links to."""
    def tiles(n):
        for i in range(0, n, _TILE):
            for j in range(i, n, _TILE):
                yield slice(i, i + _TILE), slice(j, j + _TILE)

    def link(batches):
        import pyarrow as pa
        for rows, bounds in whole_groups(batches, 20_000):
            cls, n = rows.column("cls").to_numpy(), rows.column("n").to_numpy()
            own, other = rows.column("own").to_numpy(), rows.column("chunk_b").to_numpy()
            mine, which = rows.column("chunk_a").to_numpy(), rows.column("hash_table").to_numpy()
            data = rows.column("data").to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data))
            edges_a, edges_b, who, count = [], [], [], []
            for g in range(len(bounds) - 1):
                at = np.arange(bounds[g], bounds[g + 1])
                at = at[size[at] == size[at[0]]]  # a key holds the dimension
                if len(at) < 2:
                    continue
                unit = _unit([data[i] for i in at])
                keys = None
                t, cut = which[at[0]], mine[at[0]] != other[at[0]]
                linked = np.zeros(len(at), np.int64)
                pairs = []
                for a, b in tiles(len(at)):
                    near = unit[a] @ unit[b].T >= threshold
                    if a == b:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    i, j = i + a.start, j + b.start
                    if cut:  # pairs within a chunk belong to that chunk's own group
                        across = own[at[i]] != own[at[j]]
                        i, j = i[across], j[across]
                    if t and len(i):  # met in an earlier table?
                        if keys is None:
                            keys = tables.keys(unit)[:, :t]
                        first = np.concatenate([~(keys[i[s:s + 50_000]] == keys[j[s:s + 50_000]]).any(axis=1)
                                                for s in range(0, len(i), 50_000)])
                        i, j = i[first], j[first]
                    np.add.at(linked, i, n[at[j]])
                    np.add.at(linked, j, n[at[i]])
                    if len(i):
                        pairs.append((i, j))
                if pairs:
                    lab = label(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(at))
                    tie = lab != np.arange(len(at))
                    edges_a.append(cls[at[tie]])
                    edges_b.append(cls[at[lab[tie]]])
                    who.append(cls[at[linked > 0]])
                    count.append(linked[linked > 0])
            if who:
                a, b, w, c = (np.concatenate(x) for x in (edges_a, edges_b, who, count))
                yield pa.record_batch([pa.array(np.concatenate([a, w])),
                                       pa.array(b.tolist() + [None] * len(w), pa.int64()),
                                       pa.array([None] * len(a) + c.tolist(), pa.int64())], ["a", "b", "links"])
    return link


def near_dedup_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 17, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly, component_id is the smallest
    id reachable.  Null, empty and zero vectors and those with a null or
    non-finite component link with nothing, nor do vectors of different
    dimensions.  Equal vectors always link; a pair of different vectors links
    only if its cosine in double precision is at least ``threshold`` and one of
    the tables shows it.  Empty tables give no rows.
    """
    kind = vectors.schema[vector_col].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{vector_col} must be an array of numbers, not {kind.simpleString()}")
    rows = saved(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
                 .mapInArrow(_classes, "vec_id long, digest binary, data binary"), "vectors")
    classes = saved(rows.where("digest is not null").groupBy("digest")
                    .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("data").alias("data"))
                    .withColumn("cls", F.monotonically_increasing_id()), "classes")
    k, count = parameters(classes.count(), threshold)
    tables = Tables(k, count, seed)
    at = classes.select("cls", "n", "data").mapInArrow(
        _hash(tables), "bucket long, hash_table int, cls long, n long, data binary")
    sizes = saved(at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    dealt = chunk_pairs(at.withColumnRenamed("n", "members"), sizes, "cls", GROUP_ROWS)
    found = saved(dealt.select(*GROUP, "own", "hash_table", "cls", F.col("members").alias("n"), "data")
                  .mapInArrow(_link(tables, threshold), "a long, b long, links long"), "links")
    joined = components(found.where("b is not null").select("a", "b"))
    direct = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    each = saved(classes.select("digest", "cls", "first_id", "n").join(direct, "cls", "left")
                 .join(joined.withColumnRenamed("node", "cls"), "cls", "left")
                 .withColumn("root", F.coalesce("component", "cls"))
                 .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1), "linked")
    smallest = each.groupBy("root").agg(F.min("first_id").alias("smallest"))
    of = saved(each.join(smallest, "root").select("digest", "links", "smallest"), "labels")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return (rows.select("vec_id", "digest").join(of, "digest", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
