import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farmspark.llm import hard_negatives as hn
from farmspark.llm import queries
from farmspark.llm.shared import table
from tests.conftest import SF_ORACLE

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, x int, score double, slot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", None, 1.0, None) for i, v, y in rows], SCHEMA).repartition(5)


def brute(rows, is_anchor, scale=256, k=5):
    """Rows of (id, vector, label), compared one with the other."""
    held = [(i, [math.floor(float(np.float32(c)) * scale) for c in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a in held:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[1], b[1])), b[0], j) for j, b in enumerate(held)))
        same = [(-s, i) for s, i, j in scored if held[j] is not a and held[j][2] == a[2]][:k]
        other = [(-s, i) for s, i, j in scored if held[j][2] != a[2]]
        for p, pid in same:
            window = [(s, i) for s, i in other if 80 * p <= 100 * s <= 100 * p][:k]
            out += [(a[0], pid, n + 1, i, p, s) for n, (s, i) in enumerate(window)]
    return sorted(out)


def mined(df, **more):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hn.mine(df, is_anchor=F.col("vec_id") % 10 == 0, **more).select(*cols).collect())


def anchor(i):
    return i % 10 == 0


def random_rows(n, dim, seed, labels=4, grid=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice(grid) if grid else rng.gauss(0, 0.3) for _ in range(dim)]
        rows.append((i, v, rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rows = random_rows(400, 6, seed)
    assert mined(frame(spark, rows)) == brute(rows, anchor) != []


def test_ties_everywhere(spark):
    # few different scores: equal limits, windows that overlap, thousands of ties
    rows = random_rows(600, 3, 5, labels=3, grid=[0.0, 0.5, 1.0])
    assert mined(frame(spark, rows)) == brute(rows, anchor) != []


def test_combiners_that_drop_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE_CELLS", 64)
    rows = random_rows(300, 3, 7, labels=2, grid=[0.0, 0.25, 0.5, 1.0])
    best = hn.Best(3, 2)
    best.most = 4
    rng = np.random.default_rng(0)
    all_rows = [(int(g), int(s), int(w), n) for n, (g, s, w) in enumerate(zip(
        rng.integers(0, 3, 500), rng.integers(0, 20, 500), rng.integers(0, 9, 500)))]
    for i in range(0, 500, 7):
        best.push(*(np.array(c, np.int64) for c in zip(*all_rows[i:i + 7])))
    exp = [r for g in range(3) for r in sorted((r for r in all_rows if r[0] == g), key=lambda r: (-r[1], r[2], r[3]))[:2]]
    assert [tuple(map(int, r)) for r in zip(*best.rows())] == exp
    assert mined(frame(spark, rows)) == brute(rows, anchor)


def test_anchor_blocks(spark, monkeypatch):
    rows = random_rows(200, 4, 9)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 3)
    assert mined(frame(spark, rows)) == brute(rows, anchor)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 3, 11)
    rows += [(None, [1.0, 1.0, 1.0], 1), (70, None, 1), (80, [1.0, 1.0, 1.0], None), (90, [1.0, None, 1.0], 1), (100, [nan, 1.0, 1.0], 1),
             (110, [inf, 1.0, 1.0], 2), (120, [], 1), (130, [0.0, 0.0, 0.0], 2), (140, [2.0, 2.0], 1), (141, [1.0, 1.0, 1.0, 1.0], 2),
             (150, [-1.0, -1.0, -1.0], 3), (None, None, None)]
    rows += [rows[10], rows[10], rows[20]]  # repeated rows, anchors among them
    assert mined(frame(spark, rows)) == brute(rows, anchor)
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(0, [1.0], 1)])) == []
    # an anchor without positives, and negative scores only
    lonely = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2), (10, [1.0], 9)]
    assert mined(frame(spark, lonely)) == brute(lonely, anchor)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0 ** 22 + i, float(3 * i), -1.0], i % 2) for i in range(40)]
    assert mined(frame(spark, rows)) == brute(rows, anchor) != []
    big = np.array([[1 << 40, 5], [-(1 << 40), 7]], np.int64)
    got = hn.inner(big, big, float("inf"))
    assert got[0].tolist() == [(1 << 63) - 1, -(1 << 63)]
    exact = np.array([[(1 << 30) + 1, 3]], np.int64)
    assert hn.inner(exact, exact, hn.reach(exact) ** 2)[0, 0] == ((1 << 30) + 1) ** 2 + 9


def test_one_label_and_one_vector_for_a_third(spark):
    rows = random_rows(300, 4, 13) + [(1000 + i, [0.5, 0.5, 0.5, 0.5], 1 + i % 2) for i in range(150)]
    assert mined(frame(spark, rows)) == brute(rows, anchor)


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in table(spark, SF_ORACLE, "embeddings").collect()]
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, SF_ORACLE).select(*cols).collect())
    assert got == brute(rows, lambda i: i % 100 == 0) != []
