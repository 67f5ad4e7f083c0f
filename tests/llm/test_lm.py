import collections
import math
import zlib

import numpy as np
import pytest

from farmspark.llm import lm
from farmspark.llm.shared import table


def brute(rows):
    docs = [(i, (t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode()) % 7 if i is not None else 0)
            for i, t, *_ in rows]

    def counts(on):
        one, two = collections.Counter(), collections.Counter()
        for _, w, k in docs:
            if on(k):
                one.update(w)
                two.update(zip([None] + w, w))
        return one, two
    kept1, kept2 = counts(lambda k: k not in (2, 3))
    all1, all2 = counts(lambda k: k != 2)
    n, v, kept = sum(all1.values()), len(all1), sum(kept1.values())

    def number(f, x):
        return int(f(np.array([x]))[0])
    cells = collections.Counter()
    for _, w, k in docs:
        for h, x in zip([None] + w, w) if k == 3 else ():
            c = kept1[h]
            cells[(number(lm.context_bucket, c) * lm.BINS + number(lm._bins, kept2[h, x] / max(c, 1))) * lm.BINS
                  + number(lm._bins, kept1[x] / max(kept, 1))] += 1
    order = sorted(cells)
    weights = lm.learn_weights(np.array(order, int), np.array([cells[c] for c in order], float), v)
    out = []
    for i, w, k in docs:
        base = score = known = 0
        for h, x in zip([None] + w, w):
            c = all1[h]
            own = weights[number(lm.context_bucket, c)]
            score += math.log10(own[0] * all2[h, x] / max(c, 1) + own[1] * all1[x] / max(n, 1) + own[2] / (v + 1))
            base += math.log10((all1[x] + 1) / (n + v + 1))
            known += all1[x] > 0
        out.append((i, k == 2, len(w), known, n, base, score))
    return sorted(out, key=str)


def same(got, exp):
    assert [g[:5] for g in got] == [e[:5] for e in exp]
    for g, e in zip(got, exp):
        assert math.isclose(g[5], e[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], e[6], rel_tol=1e-9, abs_tol=1e-9)


def run(docs):
    return sorted(map(tuple, lm.score_documents(docs).collect()), key=str)


def test_table_against_plain_counts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = run(docs)
    same(got, brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # likelier than the base


def test_edge_documents(edge_docs, edge_rows, no_docs):
    short = edge_docs.where("length(text) < 10000 or text is null")
    same(run(short), brute([r for r in edge_rows if len(r[1] or "") < 10_000]))
    assert len(run(edge_docs)) == len(edge_rows)
    assert run(no_docs) == []


def test_only_held_out_documents(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    docs = spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")
    for r in run(docs):
        assert r[1:5] == (True, 4, 0, 0) and r[5] == 0 and r[6] == 0


def test_weights_follow_the_held_out_counts():
    def cell(context, two, one):
        return (context * lm.BINS + two) * lm.BINS + one
    cells = np.array([cell(3, 3, 30), cell(5, 0, 20), cell(7, 0, 0), cell(0, 0, 10)])
    w = lm.learn_weights(cells, np.array([1e5, 1e5, 1e5, 1e5]), types=1000)
    assert w[3, 0] > 0.9 and w[5, 1] > 0.9 and w[7, 2] > 0.9 and w[0, 0] == 0
    assert np.allclose(w.sum(axis=1), 1) and (w[1:] > 0).all()


@pytest.mark.parametrize("n", [1, 2, 7])
def test_no_deleted_slice_still_gives_weights(n):
    w = lm.learn_weights(np.zeros(0, int), np.zeros(0), types=n)
    assert np.allclose(w.sum(axis=1), 1)
