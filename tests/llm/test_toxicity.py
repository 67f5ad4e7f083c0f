import random
import zlib

import numpy as np

from farmspark.llm import toxicity
from farmspark.llm.shared import table


def test_pairs_are_learned_that_no_sum_of_weights_separates():
    rng = random.Random(0)
    filler = [f"w{i}" for i in range(30)]
    texts, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 6) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(int(a and b))
    model = toxicity.fit(texts, labels, {0: 1.0, 1: 1.0})
    score = model.score([b"w1 insult w2", b"w1 group w3", b"w1 insult group", b"w4 w5", b""])
    assert score[2] > 0.9 and max(score[[0, 1, 3, 4]]) < 0.5
    # exclusive or: out of reach of additive weights
    labels = [int((b"insult" in t) != (b"group" in t)) for t in texts]
    score = toxicity.fit(texts, labels, {0: 1.0, 1: 1.0}).score([b"w1 insult w2", b"w1 group w3", b"w1 insult group", b"w4 w5"])
    assert min(score[:2]) > 0.9 and max(score[2:]) < 0.1


def test_pairs_are_learned_among_thousands_of_filler_words():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    filler = ["".join(rng.choices(letters, k=8)) for _ in range(3000)]
    texts, labels = [], []
    for i in range(1600):
        # each word alone is as frequent in both classes
        a, b = i % 4 in (1, 3), i % 4 in (2, 3)
        words = rng.sample(filler, 20) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(int(a != b))
    model = toxicity.fit(texts[:1200], labels[:1200], {0: 1.0, 1: 1.0})
    assert ((model.score(texts[1200:]) >= 0.5) == np.array(labels[1200:])).mean() > 0.95


def test_hundreds_of_insults_are_known():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    insults, filler = (["".join(rng.choices(letters, k=8)) for _ in range(n)] for n in (400, 4000))
    texts = []
    for i in range(3200):
        texts.append(" ".join(rng.sample(filler, 12) + insults[i // 2 % 400:][:i % 2]).encode())
    model = toxicity.fit(texts, [i % 2 for i in range(3200)], {0: 1.0, 1: 1.0})
    bad = model.score([" ".join(rng.sample(filler, 12) + [w]).encode() for w in insults])
    good = model.score([" ".join(rng.sample(filler, 12)).encode() for _ in insults])
    assert (bad >= 0.5).mean() > 0.8 and (good < 0.5).mean() > 0.8


def test_score_is_the_pairwise_formula():
    texts = [b"alpha beta gamma", b"beta Delta delta", b"", b"unknownword", b"alphabet soup alpha", b"gamma " * 50] * 20
    machine = toxicity.fit(texts, [1, 0, 0, 1, 1, 0] * 20, {0: 1.0, 1: 1.0})
    got = machine.score(texts[:6])
    for text, score in zip(texts[:6], got):
        places = sorted({int(p) for p in toxicity.term_places([text])[1]}) if text else []
        rows = [machine.row[p] for p in places if machine.row[p] >= 0]
        z = machine.bias + sum(machine.linear[r] for r in rows)
        for i, a in enumerate(rows):
            for b in rows[i + 1:]:
                z += sum(x * y for x, y in zip(machine.factors[a], machine.factors[b]))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    texts = [f"bad{i % 3} word {i % 50} text".encode() for i in range(300)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(300)], {0: 1.0, 1: 1.0})
    whole = model.score(texts)
    monkeypatch.setattr(toxicity, "SLAB", 100)
    assert np.allclose(model.score(texts), whole, rtol=0, atol=1e-12)


def test_edge_documents(edge_docs, no_docs, labels):
    rows = toxicity.score_toxicity(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.score_toxicity(no_docs, labels).collect() == []
    none = toxicity.score_toxicity(edge_docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    kept = toxicity.drop_toxic(edge_docs, labels)
    assert kept.dtypes == edge_docs.dtypes and kept.exceptAll(edge_docs).count() == 0
    assert toxicity.drop_toxic(edge_docs, labels.where("false")).count() == edge_docs.count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    own = rows.join(table(spark, sf, "labels"), "doc_id").where("held_out").select("predicted", "toxic", "score").toPandas()
    hit = (own.predicted == 1) & (own.toxic == 1)
    assert (own.predicted == own.toxic).mean() > 0.96
    assert hit.sum() / (own.predicted == 1).sum() > 0.9 and hit.sum() / (own.toxic == 1).sum() > 0.8


def test_held_out_labels_are_not_learned_from(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    first = toxicity.score_toxicity(docs, labels).orderBy("doc_id").collect()
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 "
                               "then 1 - toxic else toxic end as toxic")
    assert toxicity.score_toxicity(docs, turned).orderBy("doc_id").collect() == first
