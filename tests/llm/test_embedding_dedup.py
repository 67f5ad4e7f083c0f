import math

import numpy as np

from farmspark.llm import embedding_dedup as ed
from farmspark.llm.simhash import label


def brute(ids, vectors, threshold):
    """(links, component) by comparing all pairs in double precision."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    linked = np.zeros(n, int)
    i_, j_ = [], []
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in range(n) if ok[i]}
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and (
                    tuple(vectors[i]) == tuple(vectors[j]) or unit[i] @ unit[j] >= threshold):
                linked[[i, j]] += 1
                i_.append(i), j_.append(j)
    lab = label(np.array(i_, int), np.array(j_, int), n) if i_ else np.arange(n)
    best = {}
    for k in range(n):
        if ids[k] is not None:
            best[lab[k]] = min(best.get(lab[k], ids[k]), ids[k])
    return sorted(((ids[k], int(linked[k]), best.get(lab[k])) for k in range(n)), key=str)


def run(frame, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in ed.near_dedup_vectors(frame, **kw).collect()), key=str)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    vectors = [v, v, [2.0, 4.0, 6.0], [-1.0, -2.0, -3.0], None, [], [0.0, 0.0, 0.0], [1.0, None, 3.0], [1.0, nan, 3.0],
               [1.0, inf, 3.0], [1.0, 2.0], [1.0, 2.0, 3.1], [1e-200, 2e-200, 3e-200], [1e200, 2e200, 3e200], v,
               [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 5.0]]
    ids = [9, 3, 11, 4, 5, 6, 7, 8, 10, 12, 13, 14, 15, 16, None, 20, 21, 3]
    frame = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids), ["y"] * len(ids))),
                                  "vec_id long, embedding array<double>, digest string, n string").repartition(3)
    # the norms of the brute force overflow on the huge and tiny vectors; scaled ones are the same directions
    own = [[1.0, 2.0, 3.0] if x in ([1e-200, 2e-200, 3e-200], [1e200, 2e200, 3e200]) else x for x in vectors]
    assert run(frame) == brute(ids, own, 0.95)
    assert run(frame.where("false")) == []


def test_kept_is_the_component(spark):
    frame = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.component_id, r.kept) for r in ed.near_dedup_vectors(frame).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(0)
    n, d = 1500, 64
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, d))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.945, 0.96, n)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in ed.near_dedup_vectors(frame).collect()}
    true = {i for i in range(n) if x[i] @ x[n + i] >= 0.95}
    assert not [i for i in got if got[i] and i % n not in true]  # no pair below the threshold
    assert sum(got[i] for i in true) / len(true) >= 0.9


def test_groups_cut_into_chunks_count_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((4, 16))
    x = np.concatenate([c + rng.standard_normal((60, 16)) * 0.02 for c in centre])
    vectors = [v.tolist() for v in x] + [x[0].tolist()] * 3
    ids = list(range(100, 100 + len(vectors)))
    frame = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>").repartition(4)
    exp = brute(ids, vectors, 0.95)
    for limit in (2048, 16):
        monkeypatch.setattr(ed, "GROUP_ROWS", limit)
        assert run(frame) == exp


def test_whole_table_against_brute_force(spark):
    from farmspark.llm.shared import table
    frame = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    # the table itself holds no link: plant some
    rows += [(10_000 + i, [2 * x + (0.02 if k == i % 64 else 0.0) for k, x in enumerate(v)]) for i, v in rows[::3]]
    # columns that are named like the operator's own
    planted = frame.sparkSession.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                                 "vec_id long, embedding array<double>, n_links int, cls string, component_id int")
    exp = brute([i for i, _ in rows], [v for _, v in rows], 0.95)
    assert run(planted) == exp and sum(r[1] > 0 for r in exp) > 300
