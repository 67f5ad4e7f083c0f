"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum of its rows' centred scatter matrix up to
date by rank-one updates (:mod:`farmspark.llm.spectrum`); spectra are combined,
a few at a time, by one rank-one update per eigenpair and one for the distance
of their centres.  A Rayleigh-Ritz refinement over all rows then removes what
rounding has left: the rows, centred exactly, are projected on the basis, the
projected scatter is summed over the partitions and its eigenvectors turn the
basis; it is repeated until the projected scatter is diagonal.

Only spectra and projected scatters (dim x dim numbers) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.shared import saved
from farmspark.llm.spectrum import Spectrum, centred
from farmspark.llm.vectors import finite, matrix

#: rows of one orthogonal reduction, and spectra combined by one task
BLOCK = 4096
FAN_IN = 8
#: largest correlation between components that the refinement leaves, and its rounds
DIAGONAL = 1e-11
ROUNDS = 3
#: entries beyond this are taken as this: a long holds them
LARGEST = 4e18

_SPECTRUM = "slot long, n long, sums array<string>, d binary, q binary"
_SCATTER = "slot long, t binary"


def _blocks(batches, dim: int) -> Iterator[np.ndarray]:
    """Rows of integers in blocks, whatever the size of the Arrow batches."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        x = matrix(batch.column("x"), dim)
        for i in range(0, len(x), BLOCK):
            held.append(x[i:i + BLOCK])
            rows += len(held[-1])
            if rows >= BLOCK:
                yield np.concatenate(held)
                held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _slot() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def _spectra(dim: int):
    def own(batches):
        import pyarrow as pa
        spectrum = Spectrum(dim)
        for x in _blocks(batches, dim):
            spectrum.add(x)
        if spectrum.n:
            yield pa.RecordBatch.from_pylist([{"slot": _slot(), **spectrum.dump()}])
    return own


def _combined(table):
    import pyarrow as pa
    rows = table.sort_by("slot").to_pylist()
    first = Spectrum.load(*(rows[0][c] for c in ("n", "sums", "d", "q")))
    for r in rows[1:]:
        first.merge(Spectrum.load(*(r[c] for c in ("n", "sums", "d", "q"))))
    return pa.Table.from_pylist([{"slot": rows[0]["slot"] // FAN_IN, **first.dump()}])


def _summed(table):
    import pyarrow as pa
    rows = table.sort_by("slot").to_pylist()
    total = sum(np.frombuffer(r["t"]) for r in rows)
    return pa.Table.from_pylist([{"slot": rows[0]["slot"] // FAN_IN, "t": total.tobytes()}])


def _tree(parts: DataFrame, combine, schema: str) -> DataFrame:
    """The rows of all slots combined into one, FAN_IN at a time."""
    most = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while most > 1:
        # the new slot is the group's number, so a level is dealt like the one before
        parts = parts.groupBy(F.expr(f"slot div {FAN_IN}")).applyInArrow(combine, schema)
        most = -(-most // FAN_IN)
    return parts


def _unpacked(told: dict) -> tuple[np.ndarray, int, np.ndarray]:
    return told["axes"], told["n"], np.array([int(v) for v in told["sums"]], object)


def _projected(told: dict):
    """Scatter of the partition's centred rows in the basis, as one row."""
    def scatter(batches):
        import pyarrow as pa
        q, n, sums = _unpacked(told)
        total, any_rows = np.zeros((q.shape[1], q.shape[1])), False
        for x in _blocks(batches, len(q)):
            y = (centred(x, n, sums) / n).astype(np.float64) @ q
            total += y.T @ y
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_pylist([{"slot": _slot(), "t": total.tobytes()}])
    return scatter


def _rows_out(told: dict):
    def whitened(batches):
        import pyarrow as pa
        q, n, sums = _unpacked(told)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                c = centred(matrix(part.column("x"), len(q)), n, sums)
                most = max(int(c.max(initial=0)), -int(c.min(initial=0)))
                if most * most * max(c.shape[1], 1) < 1 << 62:
                    deviation = (c * c).sum(axis=1).tolist()
                else:
                    deviation = (c.astype(object) ** 2).sum(axis=1).tolist()
                y = (c / n).astype(np.float64) @ q
                ends = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32) if y.size else np.zeros(len(y) + 1, np.int32)
                yield pa.record_batch([part.column("vec_id"), pa.array([str(int(v)) for v in deviation], pa.string()),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))],
                                      ["vec_id", "deviation", "whitened"])
    return whitened


class Whitening:
    """A fitted whitening: ``n``, ``sums``, ``values`` (falling), ``axes`` (unit
    columns) and the trace of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, axes: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.axes, self.trace = n, sums, values, axes, trace

    def told(self, axes: np.ndarray) -> dict:
        """What a task needs to project centred rows on ``axes``."""
        return {"n": self.n, "sums": [str(v) for v in self.sums], "axes": axes}

    @property
    def scaled(self) -> np.ndarray:
        """The axes on which rows have variance one."""
        return self.axes / np.sqrt(self.values)


def integers(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
             vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id and x = floor(scale * entry) + offset of the rows that count, the
    longest x); shorter x are filled up with ``offset``."""
    def entry(v):
        return F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + offset
    rows = saved(vectors.where(finite(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, entry).alias("x")), "integers")
    least, dim = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != dim:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), dim - F.size("x"))))
    return rows, dim or 0


def _scatter(rows: DataFrame, told: dict) -> np.ndarray:
    """Mean outer product of the centred rows, projected on ``told['axes']``."""
    size = told["axes"].shape[1]
    parts = saved(rows.mapInArrow(_projected(told), _SCATTER), "scatter")
    t = np.frombuffer(_tree(parts, _summed, _SCATTER).first()["t"]).reshape(size, size) / told["n"]
    return (t + t.T) / 2


def fit(rows: DataFrame, dim: int, components: int = 32) -> Whitening:
    """The whitening of ``rows`` (of :func:`integers`, at least one row)."""
    spectra = saved(rows.mapInArrow(_spectra(dim), _SPECTRUM), "spectra")
    got = _tree(spectra, _combined, _SPECTRUM).first()
    start = Spectrum.load(got["n"], got["sums"], bytes(got["d"]), bytes(got["q"]))
    whole = Whitening(start.n, start.sums, start.d, start.q, 0.0)
    q = np.linalg.qr(start.q)[0]
    for turn in range(ROUNDS + 1):
        t = _scatter(rows, whole.told(q))
        value = np.diag(t)
        # what no row varies in is no component
        real = value > dim * np.finfo(np.float64).eps * value.max()
        size = np.sqrt(np.where(real, value, 1.0))
        apart = np.abs(t / size[:, None] / size)[np.ix_(real, real)]
        np.fill_diagonal(apart, 0)
        if turn == ROUNDS or turn and apart.max(initial=0) <= DIAGONAL:
            break
        q = np.linalg.qr(q @ np.linalg.eigh(t)[1])[0]
    order = np.argsort(-value, kind="stable")
    order = order[real[order]][:components]
    axes = q[:, order]
    if len(order):  # the sign is free: the entry of largest size is positive
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(start.n, start.sums, value[order], axes, float(value.sum()))


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n, deviation, whitened (array<double>, one per
    component by falling eigenvalue), explained (array<double>), identity_error.

    Entries become floor(scale * entry) + offset.  ``deviation`` is the exact sum
    of (n * x - sums)^2, as a decimal (null beyond 38 digits).  Null vectors and
    those with a null or non-finite entry are left out; vectors shorter than the
    longest count as if filled up with zeros.  Components without variance are
    left out, so a table of equal vectors has empty arrays.  Repeated rows and
    null ids count like any other row, other columns are ignored, an empty table
    gives no rows.  ``identity_error`` is measured on the whitened rows.
    """
    rows, dim = integers(vectors, scale, offset, id_col, vector_col)
    if not dim:
        return rows.select("vec_id", F.expr("count(*) over ()").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                           F.expr("cast(array() as array<double>)").alias("whitened"),
                           F.expr("cast(array() as array<double>)").alias("explained"), F.lit(0.0).alias("identity_error"))
    found = fit(rows, dim, components)
    error = 0.0
    if len(found.values):
        error = float(np.abs(_scatter(rows, found.told(found.scaled)) - np.eye(len(found.values))).max())
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values]).cast("array<double>")
    return (rows.mapInArrow(_rows_out(found.told(found.scaled)), "vec_id long, deviation string, whitened array<double>")
            .select("vec_id", F.lit(found.n).cast("long").alias("n"), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"),
                    "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")))
