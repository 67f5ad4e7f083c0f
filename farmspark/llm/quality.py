"""Quality by a byte-level convolutional network, in numpy.

Every byte has a small learned embedding.  Learned filters of 8 bytes slide in
steps of 4 over the whole document; their responses are max-pooled over chunks
of 256 bytes that begin every 128 bytes, and a document is the mean and the
maximum of its chunks, combined by a logistic output into one probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.labelled import held_out, labelled_sample
from farmspark.llm.rolling import slabs
from farmspark.llm.shared import doc_text
from farmspark.llm.toxicity import with_score

#: rows of each class to learn from, and the longest text among them
PER_CLASS = 600
MAX_BYTES = 1 << 15
DIM, FILTERS = 4, 24
STEP = 4                 # bytes between windows; a window is two steps
HALF = 32                # windows of half a chunk: 128 bytes
SLAB = 1 << 20


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole half chunks (and at
    least one window), and the number of half chunks of each text."""
    unit = STEP * HALF
    halves = np.fromiter(((len(t) + 2 * STEP + unit - 1) // unit for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(t.ljust(h * unit, b"\0") for t, h in zip(texts, halves.tolist())), np.uint8), halves


class ByteCnn:
    def __init__(self, seed: int = 5, constant: float | None = None):
        rng = np.random.default_rng(seed)
        self.constant = constant
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "left": rng.normal(0, 0.35, (STEP * DIM, FILTERS)).astype(np.float32),
            "right": rng.normal(0, 0.35, (STEP * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "const": np.zeros(1, np.float32),
        }

    def _windows(self, buf: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses (half chunk, window, filter), and the embedded steps."""
        p = self.p
        steps = p["embed"][buf].reshape(-1, STEP * DIM)
        each = steps @ np.concatenate([p["left"], p["right"]], axis=1)
        z = each[:, :FILTERS] + p["bias"]
        z[:-1] += each[1:, FILTERS:]
        # a text's last window would reach into the next text
        z[np.cumsum(halves) * HALF - 1] = 0
        return np.maximum(z, 0, out=z).reshape(-1, HALF, FILTERS), steps

    def _pooled(self, half: np.ndarray, halves: np.ndarray):
        """Chunks (two half chunks, the last of a text alone) and text features."""
        first = np.cumsum(halves) - halves
        inner = np.ones(len(half), bool)
        inner[np.cumsum(halves) - 1] = False
        chunk = half.copy()
        at = np.flatnonzero(inner)
        chunk[at] = np.maximum(half[at], half[at + 1])
        mean = np.add.reduceat(chunk, first) / halves[:, None]
        return chunk, inner, first, mean, np.maximum.reduceat(chunk, first)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        if self.constant is not None:
            out[:] = self.constant
            return out
        for a, b in slabs([len(t) + 128 for t in texts], SLAB):
            buf, halves = layout(texts[a:b])
            half = self._halves(buf, halves)
            _, _, _, mean, top = self._pooled(half, halves)
            z = np.concatenate([mean, top], axis=1).astype(np.float64) @ self.p["out"] + self.p["const"][0]
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out

    def _halves(self, buf: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Max-pooled half chunks, some at a time: a very long text stays bounded."""
        unit = STEP * HALF
        most = 4 * SLAB // unit
        if len(buf) <= most * unit:
            return self._windows(buf, halves)[0].max(axis=1)
        ends = np.cumsum(halves)
        out = []
        for a in range(0, len(buf) // unit, most):
            b = min(a + most, len(buf) // unit)
            # one half chunk more, so that the windows at the cut are whole
            more = min(b + 1, len(buf) // unit)
            inside = ends[(ends > a) & (ends <= more)]
            sizes = np.diff(np.concatenate([[a], inside, [more] if not len(inside) or inside[-1] != more else []]))
            z = self._windows(buf[a * unit:more * unit], sizes.astype(np.int64))[0]
            out.append(z[:b - a].max(axis=1))
        return np.concatenate(out)

    def gradients(self, buf, halves, y, weight):
        p = self.p
        z, steps = self._windows(buf, halves)
        place = z.argmax(axis=1)
        half = np.take_along_axis(z, place[:, None], axis=1)[:, 0]
        chunk, inner, first, mean, top = self._pooled(half, halves)
        feat = np.concatenate([mean, top], axis=1)
        logit = feat @ p["out"] + p["const"][0]
        g = (weight * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)).astype(np.float32)
        grads = {"out": feat.T @ g, "const": np.array([g.sum()], np.float32)}
        doc = np.repeat(np.arange(len(halves)), halves)
        d_feat = g[:, None] * p["out"][None, :]
        d_chunk = (d_feat[:, :FILTERS] / halves[:, None])[doc]
        # chunks that share the maximum share its gradient
        peak = chunk == top[doc]
        d_chunk += np.where(peak, (d_feat[:, FILTERS:] / np.add.reduceat(peak, first, dtype=np.int32))[doc], 0)
        # to the half chunk that gave the chunk's maximum
        d_half = d_chunk.copy()
        at = np.flatnonzero(inner)
        later = half[at + 1] > half[at]
        moved = np.where(later, d_chunk[at], 0)
        d_half[at] -= moved
        np.add.at(d_half, at + 1, moved)
        d_half[half <= 0] = 0
        h, f = np.nonzero(d_half)
        d = d_half[h, f][:, None]
        window = h * HALF + place[h, f]
        grads["bias"] = np.bincount(f, d[:, 0], FILTERS).astype(np.float32)
        nxt = np.minimum(window + 1, len(steps) - 1)
        # entries in order of their filter: sums over runs instead of scattered adds
        order = np.argsort(f, kind="stable")
        f, d, window, nxt = f[order], d[order], window[order], nxt[order]
        used, run = np.unique(f, return_index=True)
        for side, at in (("left", window), ("right", nxt)):
            grads[side] = np.zeros_like(p[side])
            if len(f):
                grads[side].T[used] = np.add.reduceat(d * steps[at], run, axis=0)
        rows = buf.reshape(-1, STEP)
        byte = np.concatenate([rows[window], rows[nxt]]).ravel()
        pull = np.concatenate([d * p["left"].T[f], d * p["right"].T[f]]).reshape(-1, DIM)
        embed = np.stack([np.bincount(byte, pull[:, k], 256) for k in range(DIM)], axis=1).astype(np.float32)
        grads["embed"] = embed
        return grads


def fit(texts: list[bytes], labels: list[int], weights: dict[int, float], default: float = 1.0, epochs: int = 20,
        batch: int = 32, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> ByteCnn:
    """Fit by Adam on the weighted log loss; the same input gives the same network.

    With one class only the score is that class, without rows it is ``default``.
    """
    if len(set(labels)) < 2:
        return ByteCnn(seed, float(labels[0]) if labels else default)
    net = ByteCnn(seed)
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    weight = np.array([weights[v] for v in labels], np.float32)
    base = float(np.average(y, weights=weight))
    net.p["const"][0] = np.log(base / (1 - base))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            pick = order[at:at + batch]
            buf, halves = layout([texts[i] for i in pick])
            step += 1
            pace = rate * (1 - step / (total + 1))
            for k, grad in net.gradients(buf, halves, y[pick], weight[pick]).items():
                grad = grad + decay * net.p[k]
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                net.p[k] -= pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text of padding only.  With no
    labelled row of the learning folds every score is 1.
    """
    net = fit(*labelled_sample(docs, labels, "quality", PER_CLASS, MAX_BYTES, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
    return (with_score(rows, net, "score")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
