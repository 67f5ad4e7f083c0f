import numpy as np
import pytest

from farmspark.llm import quality
from farmspark.llm.shared import table


def plain(net, text):
    """The network written out for one text, window by window."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    buf, halves = quality.layout([text])
    windows = len(buf) // quality.STEP - 1
    kernel = np.concatenate([p["left"], p["right"]])
    half = np.zeros((halves[0], quality.FILTERS))
    for w in range(windows):
        x = p["embed"][buf[w * quality.STEP:(w + 2) * quality.STEP]].ravel()
        h = w // quality.HALF
        half[h] = np.maximum(half[h], x @ kernel + p["bias"])
    chunk = [np.maximum(half[i], half[i + 1]) if i + 1 < len(half) else half[i] for i in range(len(half))]
    z = np.concatenate([np.mean(chunk, axis=0), np.max(chunk, axis=0)]) @ p["out"] + p["const"][0]
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, rng.integers(1, 900), dtype=np.uint8)) for _ in range(60)]
    texts += [t.upper() + b"!!" for t in texts]
    return quality.fit(texts, [1] * 60 + [0] * 60, {0: 1.0, 1: 1.0}, epochs=6)


TEXTS = [b"", b"a", b"x" * 120, b"y" * 121, b"z" * 256, b"Some TEXT!! of ordinary length. " * 40, "é ß".encode() * 99]


def test_score_equals_the_plain_network(net):
    assert np.allclose(net.score(TEXTS), [plain(net, t) for t in TEXTS], atol=1e-5)


def test_score_covers_the_whole_of_a_long_text(net, monkeypatch):
    long = b"plain words only " * 30_000
    late = long + b"JUNK!! JUNK!! " * 400
    whole = net.score([long, late])
    assert whole[1] != whole[0]
    monkeypatch.setattr(quality, "SLAB", 1 << 14)  # cut into many parts
    assert np.allclose(net.score([long, late] + TEXTS), [*whole, *net.score(TEXTS)], atol=1e-5)


def test_gradients_match_differences(net):
    texts, y = [b"abc defg hijk " * 9, b"ABC!! DEFG" * 30, b"q"], np.array([1, 0, 1], np.float32)
    weight = np.ones(3, np.float32)
    buf, halves = quality.layout(texts)

    def loss():
        s = np.clip(net.score(texts), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    grads = net.gradients(buf, halves, y, weight)
    for name in ("out", "const", "bias", "left", "right", "embed"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old, step = flat[i], 2e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 0.03 * abs(g[i]) + 2e-3, (name, i)


def test_edge_documents(edge_docs, no_docs, labels):
    rows = quality.score_quality(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.score_quality(no_docs, labels).collect() == []
    assert {r.score for r in quality.score_quality(edge_docs, labels.where("false")).collect()} == {1.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    own = rows.join(table(spark, sf, "labels"), "doc_id").where("held_out").select("predicted", "quality").toPandas()
    good, bad = own[own.quality == 1], own[own.quality == 0]
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.75
