import math

import numpy as np
import pytest

from farmspark.llm import queries, whitening
from farmspark.llm.shared import table
from farmspark.llm.spectrum import Spectrum, centred, rank_one, secular_roots
from tests.conftest import SF_ORACLE, SF_SMALL


def spectrum_error(a, d, q):
    scale = max(np.abs(a).max(), 1e-300)
    return max(np.abs(np.sort(d) - np.linalg.eigvalsh(a)).max() / scale, np.abs(q.T @ q - np.eye(len(q))).max(),
               np.abs((q * d) @ q.T - a).max() / scale)


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 40):
        d = np.sort(rng.uniform(0, 5, n)) + np.arange(n) * 1e-9
        z2 = 10.0 ** rng.uniform(-25, 2, n)
        pole, step = secular_roots(d, z2)
        root = d[pole] + step
        assert (root >= d).all() and (root[:-1] <= d[1:]).all()
        exact = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(z2, z2)))
        assert np.allclose(root, exact, rtol=1e-12, atol=1e-12 * max(exact.max(), 1))


@pytest.mark.parametrize("dim", [1, 2, 7, 40])
def test_rank_one_updates_follow_the_matrix(dim):
    rng = np.random.default_rng(dim)
    d, q, a = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
    for k in range(150):
        u = rng.standard_normal(dim) * 10 ** rng.uniform(-5, 3)
        if k % 5 == 0:
            u = np.round(u)
        if k % 7 == 0:  # deflates: an axis, a vector seen before, nothing at all
            u = (np.eye(dim)[k % dim], q[:, k % dim], np.zeros(dim))[k // 7 % 3]
        d, q = rank_one(d, q, u, 2.0)
        a += 2.0 * np.outer(u, u)
        assert (np.diff(d) >= 0).all()
    assert spectrum_error(a, d, q) < 1e-11


def test_equal_eigenvalues_deflate():
    d, q = rank_one(np.array([1.0, 1.0, 1.0, 3.0]), np.eye(4), np.array([1.0, 2.0, 3.0, 0.0]), 1.0)
    assert np.allclose(d, [1, 1, 3, 15]) and spectrum_error(np.diag([1, 1, 1, 3.0]) + np.outer([1, 2, 3, 0], [1, 2, 3, 0]), d, q) < 1e-13


def test_spectra_add_and_merge():
    rng = np.random.default_rng(3)
    x = rng.integers(-30, 30, (3000, 12)) + 1_000_000
    x[:, 4] = x[:, 3]
    x[100:900] = x[100]
    a = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    whole, parts = Spectrum(12), Spectrum(12)
    for i in range(0, 3000, 700):
        whole.add(x[i:i + 700])
    for cut in (x[:1], x[1:1], x[1:50], x[50:]):
        one = Spectrum(12)
        one.add(cut)
        parts.merge(Spectrum.load(**one.dump()))
    for s in (whole, parts):
        assert s.n == 3000 and (s.sums == x.sum(axis=0)).all() and spectrum_error(a, s.d, s.q) < 1e-11


def test_centring_is_exact():
    x = np.array([[1 << 50, -3], [5, 1 << 50]], np.int64)
    for factor in (1, 1 << 20):
        got = centred(x, 2 * factor, np.array([(1 << 50) + 5, (1 << 50) - 3], object) * factor)
        exp = [[2 * factor * int(v) - factor * s for v, s in zip(r, [(1 << 50) + 5, (1 << 50) - 3])] for r in x]
        assert [[int(v) for v in r] for r in got] == exp


def brute(vectors, scale=64, offset=1_000_000, components=32):
    """(n, deviations, whitened, explained) of finite vectors, in plain numbers."""
    x = [[math.floor(float(np.float32(c)) * scale) + offset for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    c = [[n * r[j] - sums[j] for j in range(dim)] for r in x]
    y = np.array([[v / n for v in r] for r in c])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, [sum(k * k for k in r) for r in c], y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def check(rows, vectors):
    n, deviation, exp, share = brute(vectors)
    rows = sorted(rows, key=lambda r: r.vec_id)
    got = np.array([r.whitened for r in rows])
    assert [int(r.deviation) for r in rows] == deviation and {r.n for r in rows} == {n}
    sign = np.sign((got * exp).sum(axis=0))
    assert np.abs(got * sign - exp).max() < 1e-8
    assert np.allclose(rows[0].explained, share, rtol=1e-10) and rows[0].identity_error < 1e-10
    assert np.abs(got.T @ got / n - np.eye(got.shape[1])).max() < 1e-9


def test_whitening_of_the_table(spark):
    rows = table(spark, SF_ORACLE, "embeddings").orderBy("vec_id").collect()
    got = whitening.whiten(table(spark, SF_ORACLE, "embeddings").repartition(11)).collect()
    check(got, [r.embedding for r in rows])


def test_query_rows(spark):
    rows = queries.op13_whitening(spark, SF_SMALL)
    n = table(spark, SF_SMALL, "embeddings").count()
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                 "explained": "double", "identity_error": "double"}
    got = rows.groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(k, n) for k in range(1, 33)}


SCHEMA = "vec_id long, embedding array<float>, x string, n int, whitened string, slot int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "a", None, "b", 1) for i, v in vectors], SCHEMA).repartition(4)


def test_more_partitions_than_a_group_of_spectra(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((200, 5)) @ rng.standard_normal((5, 5))).astype(np.float32).tolist()
    got = whitening.whiten(frame(spark, list(enumerate(v))).repartition(70)).collect()
    check(got, v)


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((50, 3)).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 1.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, -inf, 1.0])]
    good = list(enumerate(v)) + [(50, v[0]), (51, v[0]), (52, [0.5]), (53, [])]
    filled = [r for r in v] + [v[0], v[0], [0.5, 0.0, 0.0], [0.0, 0.0, 0.0]]
    check(whitening.whiten(frame(spark, good + bad)).collect(), filled)
    # a null id is a row like any other
    assert whitening.whiten(frame(spark, good + [(None, v[3])])).where("vec_id is null").count() == 1


def test_tables_without_variance_and_without_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    rows = whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in rows] == [(5, 0, [])] * 5
    assert [r.whitened for r in whitening.whiten(frame(spark, [(1, []), (2, [])])).collect()] == [[], []]
    # one direction only: one component
    line = whitening.whiten(frame(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(9)])).collect()
    assert {len(r.whitened) for r in line} == {1} and math.isclose(sum(r.whitened[0] ** 2 for r in line), 9)


def test_huge_entries_do_not_crash(spark):
    rows = whitening.whiten(frame(spark, [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [1e15, 3.0])])).collect()
    assert len(rows) == 3 and all(len(r.whitened) >= 1 for r in rows)
