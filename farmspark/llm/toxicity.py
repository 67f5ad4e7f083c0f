"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: lower-cased runs of letters and digits, and
the beginnings of each, which forms of one word share.  Every term is hashed to
one of 2**18 places.  The machine scores

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the places present that the training sample has as well: the last sum learns pairs of terms, such as an insult
with a group mention, that say more together than their weights add up to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farmspark.llm.labelled import held_out, labelled_sample
from farmspark.llm.rolling import FIRST, NOT_TERM, Words, slabs, slices, sparing, utf8
from farmspark.llm.shared import doc_text, fresh, same

HASH_BITS = 18
#: bytes of the beginnings of a term that are terms themselves
STEMS = (4, 5, 6)
#: rows of each class to learn from, and the longest text among them
PER_CLASS = 2000
MAX_BYTES = 1 << 16
FACTORS = 8
#: documents of a step of the fit, and least number of steps
BATCH = 64
STEPS = 960
SLAB = (1 << 20) - 4096


def term_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every term of every text, repeats included."""
    words = Words(texts, lower=True, breaks=NOT_TERM)
    docs, places = [], []
    for n in (None, *STEMS):
        at = np.arange(len(words)) if n is None else np.flatnonzero(words.ends - words.starts > n)
        ends = words.ends[at] if n is None else words.starts[at] + n
        hashes = FIRST.ranges(words.buf, words.starts[at], ends)
        docs.append(words.doc[at])
        # a stem is another term than the same word
        places.append(((hashes ^ np.uint64(0 if n is None else 0x5BF0_3635 << 24)) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(places)


@dataclass
class FactorizationMachine:
    row: np.ndarray      # place -> row of the weights, -1 for none
    bias: float
    linear: np.ndarray   # one per row
    factors: np.ndarray  # (rows, FACTORS)
    constant: float | None = None  # the score when there was nothing to learn from

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        if self.constant is not None:
            out[:] = self.constant
            return out
        for a, b in slabs([len(t) for t in texts], SLAB):
            doc, place = term_places(texts[a:b])
            row = self.row[place]
            on = row >= 0
            pair = np.unique(doc[on] * len(self.linear) + row[on])
            doc, row = np.divmod(pair, len(self.linear))
            n = b - a
            total = self.bias + np.bincount(doc, self.linear[row], n)
            for f in range(self.factors.shape[1]):
                v = self.factors[row, f]
                total += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
            out[a:b] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return out


def fit(texts: list[bytes], labels: list[int], weights: dict[int, float], default: float = 0.0,
        sparse: float = 0.25, ridge: float = 0.3, pair_ridge: float = 1.0, rare_ridge: float = 6000.0,
        seed: int = 3) -> FactorizationMachine:
    """Fit on the weighted log loss; the same input gives the same machine.

    Every place of the sample has a weight and factors, none is left out before
    the fit.  Steps are AdaGrad's and touch only the places of their documents;
    each place bears its penalties in proportion to its documents there.  A
    weight is penalised by its size times ``sparse`` noise levels of its gradient
    (a root of its documents) and by ``ridge``.  Factors are penalised by their
    squares, as much as the places of the middle document (a longer one pulls no more
    than that, so that no single document makes a pair), and more for rare places.  The weights go first for a fifth of the
    time, the factors then learn from what they leave over.

    Of the penalties tried on all three folds of the training rows of two tables these
    have the least mean log loss; held-out rows take no part.

    With one class only the score is that class, without rows it is ``default``.
    """
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return FactorizationMachine(np.zeros(0, np.int32), 0.0, np.zeros(0), np.zeros((0, FACTORS)),
                                    float(y[0]) if len(y) else default)
    n = len(texts)
    places, sizes = [], []
    for a, b in slabs([len(t) for t in texts], SLAB):
        doc, place = term_places(texts[a:b])
        pair = np.unique((doc << HASH_BITS) + place)
        places.append((pair & (1 << HASH_BITS) - 1).astype(np.int32))
        sizes.append(np.bincount(pair >> HASH_BITS, minlength=b - a))
    size, place = np.concatenate(sizes), np.concatenate(places)
    start = np.cumsum(size) - size
    seen = np.bincount(place, minlength=1 << HASH_BITS)
    used = np.flatnonzero(seen)
    row = np.full(1 << HASH_BITS, -1, np.int32)
    row[used] = np.arange(len(used))
    rows, seen = row[place], seen[used].astype(np.float64)
    weight = np.array([weights[v] for v in labels])
    rng = np.random.default_rng(seed)
    base = float(np.average(y, weights=weight))
    bias, bias_sum = np.log(base / (1 - base)), 1.0
    linear, factors = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))
    # penalties per document of the place
    shrink = sparse * np.sqrt(base * (1 - base) / seen) + ridge / seen
    decay = ridge / seen
    middle = max(1.0, float(np.median(size)))
    pair_decay = (pair_ridge * middle + rare_ridge / seen) / seen
    pull = np.minimum(1, middle / np.maximum(size, 1))
    linear_sum, pair_sum = 10 + (0.1 * seen) ** 2, np.full(len(used), 10.0)
    at_row = np.zeros(len(used), np.int64)
    epochs = max(10, -(-STEPS * BATCH // n))
    for epoch in range(epochs):
        order, pairs, left = rng.permutation(n), epoch >= epochs // 5, 1 - epoch / epochs
        for at in range(0, n, BATCH):
            pick = order[at:at + BATCH]
            r = np.concatenate([rows[start[d]:start[d] + size[d]] for d in pick])
            doc = np.repeat(np.arange(len(pick)), size[pick])
            hit = np.zeros(len(used), bool)
            hit[r] = True
            u = np.flatnonzero(hit)
            at_row[u] = np.arange(len(u))
            own = at_row[r]
            count = np.bincount(own, minlength=len(u))
            z = bias + np.bincount(doc, linear[r], len(pick))
            if pairs:
                v = factors[u]
                summed = np.stack([np.bincount(doc, v[own, f], len(pick)) for f in range(FACTORS)], 1)
                z += 0.5 * ((summed ** 2).sum(1) - np.bincount(doc, (v * v).sum(1)[own], len(pick)))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[pick])
            grad = np.bincount(own, g[doc], len(u))
            linear_sum[u] += grad * grad
            rate = left / np.sqrt(linear_sum[u])
            w = linear[u] - rate * grad
            linear[u] = np.sign(w) * np.maximum(np.abs(w) - rate * shrink[u] * count, 0) / (1 + rate * decay[u] * count)
            if pairs:
                gp = g * pull[pick]
                gs = gp[:, None] * summed
                move = np.stack([np.bincount(own, gs[doc, f], len(u)) for f in range(FACTORS)], 1)
                move -= np.bincount(own, gp[doc], len(u))[:, None] * v
                pair_sum[u] += (move * move).mean(1)
                rate = 0.2 * left / np.sqrt(pair_sum[u])
                factors[u] = (v - rate[:, None] * move) / (1 + rate * pair_decay[u] * count)[:, None]
            bias_sum += g.sum() ** 2
            bias -= left * g.sum() / np.sqrt(bias_sum)
    return FactorizationMachine(row, float(bias), linear, factors)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text") -> FactorizationMachine:
    return fit(*labelled_sample(docs, labels, label, PER_CLASS, MAX_BYTES, id_col, text_col))


def _scored(model, text_at: int, name: str):
    import pyarrow as pa

    def score(batches):
        for batch in (part for whole in batches for part in slices(whole, text_at)):
            own = pa.array(model.score(utf8(batch.column(text_at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, name])
    return score


def with_score(docs: DataFrame, model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text (null: empty) in column ``name``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return docs.mapInArrow(sparing(_scored(model, at, name)), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without known terms.  With no
    labelled row of the learning folds every score is 0.
    """
    model = learn(docs, labels, "toxic", id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
    return (with_score(rows, model, "score")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, columns as they were.

    Null and empty texts score like a text without known terms, repeated rows are
    judged alike and each stays or goes, an empty table stays empty.
    """
    model = learn(docs, labels, "toxic", id_col, text_col)
    name = fresh(docs, "_score")
    return with_score(docs, model, name, text_col).where(F.col(name) < threshold).select(*same(docs))
