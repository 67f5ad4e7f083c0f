"""The spectrum of a scatter matrix, kept up to date by rank-one updates.

A :class:`Spectrum` holds the number of rows, their exact sums and the
eigenvalues and eigenvectors of the centred scatter matrix of rows of integers.
``scatter + rho u u'`` has, in the basis of the eigenvectors and with z = Q'u,
the eigenvalues that solve the secular equation

    1 + rho * sum(z_i^2 / (d_i - mu)) = 0,

one between every two neighbours of the old ones.  Before it is solved, entries
that the update cannot move at working precision are deflated: those with a
negligible z, and one of two equal eigenvalues after a rotation that brings its
z to zero.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
#: a bracket halved so often ends below the smallest number
_TURNS = 4 * 1100


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - mu)) = 0`` for ascending, distinct ``d`` and
    positive ``z2``: (index of the nearer pole, distance from it).

    A root is searched as a distance from its nearer pole, by Newton steps within
    a bracket that halves at least every fourth turn, for all roots at once; so
    its digits are right however close to the pole it lies.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    at = np.arange(n)
    middle = (upper - d) / 2
    with np.errstate(all="ignore"):
        above = 1 + (z2 / (d - d[:, None] - middle[:, None])).sum(axis=1)
    # a function that is still negative half way has its root in the upper half
    far = (above < 0) & (at < n - 1)
    pole = np.where(far, at + 1, at)
    low = np.where(far, -middle, 0.0)
    high = np.where(far, 0.0, middle)
    last = above[-1] < 0
    if last:
        low[-1], high[-1] = middle[-1], upper[-1] - d[-1]
    shift = d - d[pole][:, None]
    at_now = low + (high - low) / 2
    open_ = np.ones(n, bool)
    for turn in range(_TURNS):
        with np.errstate(all="ignore"):
            term = z2 / (shift - at_now[:, None])
            value = 1 + term.sum(axis=1)
            # Newton on step * value, which has no pole at the nearer pole
            slope = value + at_now * (term * term / z2).sum(axis=1)
            new = at_now - at_now * value / slope
        low, high = np.where(value < 0, at_now, low), np.where(value < 0, high, at_now)
        half = low + (high - low) / 2
        new = np.where((new > low) & (new < high) & (turn % 4 != 3), new, half)
        # a bracket without a number inside is done as well
        sure = np.abs(value) <= 4 * _EPS * (1 + np.abs(term).sum(axis=1))
        open_ &= ~sure & (np.abs(new - at_now) > 2 * _EPS * np.abs(new)) & (half != low) & (half != high)
        if not open_.any():
            break
        at_now = np.where(open_, new, at_now)
    return pole, at_now


def rank_one(d: np.ndarray, q: np.ndarray, u: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q' + rho u u'``, rho > 0."""
    z = q.T @ u
    length = np.sqrt(z @ z)
    if not length or not rho:
        return d, q
    z, rho = z / length, rho * length * length
    tiny = 8 * _EPS * max(np.abs(d).max(), rho)
    moved = rho * np.abs(z) > tiny
    q = q.copy()
    d, z = d.copy(), np.where(moved, z, 0.0)
    live = np.flatnonzero(moved)
    # equal eigenvalues: a rotation gives the whole of z to one of them
    if len(live) > 1:
        near = np.diff(d[live]) * np.abs(z[live][1:] * z[live][:-1]) <= tiny * (z[live][1:] ** 2 + z[live][:-1] ** 2)
    for i, j in zip(live[:-1], live[1:]) if len(live) > 1 and near.any() else ():
        r = np.hypot(z[i], z[j])
        c, s = z[j] / r, z[i] / r
        if (d[j] - d[i]) * abs(c * s) <= tiny:
            q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
            d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
            z[i], z[j] = 0.0, r
    live = np.flatnonzero(z)
    if len(live):
        old = d[live]
        pole, step = secular_roots(old, rho * z[live] ** 2)
        # old poles minus new eigenvalues, without cancellation
        gap = (old - old[pole][:, None]) - step[:, None]
        # the z for which the computed roots are exact keeps the vectors orthogonal
        between = np.abs(old[:, None] - old)
        np.fill_diagonal(between, 1.0)
        fitted = np.exp(0.5 * (np.log(np.abs(gap)).sum(axis=0) - np.log(between).sum(axis=0)))
        vectors = np.copysign(fitted, z[live]) / gap
        vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        q[:, live] = q[:, live] @ vectors.T
        d[live] = old[pole] + step
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Number, exact sums and centred spectrum of rows of integers."""

    def __init__(self, dim: int):
        self.n = 0
        self.sums = np.zeros(dim, object)
        self.d = np.zeros(dim)
        self.q = np.eye(dim)

    def _shift(self, n: int, sums: np.ndarray) -> None:
        """The rank-one update by which the centres of two sets of rows differ."""
        if self.n and n:
            # exact integers up to the last division
            apart = (self.sums * n - sums * self.n) / (self.n * n)
            self.d, self.q = rank_one(self.d, self.q, apart.astype(np.float64), self.n * n / (self.n + n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, x: np.ndarray) -> None:
        """Take in rows of integers, centred on their own mean.

        More rows than dimensions go through an orthogonal reduction first: the
        rows of the triangle have the same scatter, and they are the updates.
        """
        if not len(x):
            return
        sums = _sum(x)
        own = (x - x[0]).astype(np.float64) if _safe(x) else (x.astype(object) - x[0].astype(object)).astype(np.float64)
        own -= own.mean(axis=0)
        if len(own) > own.shape[1]:
            own = np.linalg.qr(own, mode="r")
        for u in own:
            self.d, self.q = rank_one(self.d, self.q, u, 1.0)
        self._shift(len(x), sums)

    def merge(self, other: "Spectrum") -> None:
        """Take in the rows of another spectrum, one rank-one update per eigenpair."""
        for value, u in zip(other.d, other.q.T):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, u, float(value))
        self._shift(other.n, other.sums)

    def dump(self) -> dict:
        return {"n": self.n, "sums": [str(v) for v in self.sums], "d": self.d.tobytes(), "q": self.q.tobytes()}

    @staticmethod
    def load(n: int, sums: list[str], d: bytes, q: bytes) -> "Spectrum":
        out = Spectrum(len(sums))
        out.n, out.sums = n, np.array([int(v) for v in sums], object)
        out.d, out.q = np.frombuffer(d).copy(), np.frombuffer(q).reshape(len(sums), len(sums)).copy()
        return out


def _safe(x: np.ndarray) -> bool:
    """Whether differences of the entries stay within a long."""
    return int(x.max(initial=0)) - int(x.min(initial=0)) < 1 << 62


def _sum(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most * len(x) < 1 << 62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums`` in exact integers (Python's where a long is too short)."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if 2 * n * most < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums
