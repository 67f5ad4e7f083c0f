"""Language-model scores by deleted interpolation of n-gram estimates.

Unigram and bigram counts come from all training documents.  The probability of
a token w after h is

    l2 * c(h, w) / c(h)  +  l1 * c(w) / N  +  l0 / (V + 1)

with one weight vector (l2, l1, l0) per bucket of the context frequency c(h)
(powers of two; a context never seen has l2 = 0).  The weights are learned by
expectation-maximisation on held-out counts: one slice of the training
documents is deleted from the counts, and the weights are those that make its
tokens likeliest under the counts of the rest.  Scores then use all training
counts.

Counts are summed by key bucket and sent back to the chunks of documents that
asked for them (:mod:`exchange`); only the weights, a histogram of bounded size
and four totals pass through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm import exchange as X
from farmspark.llm.rolling import FIRST, U, Words, _mix, slabs, utf8
from farmspark.llm.shared import crc_fold, doc_text, saved

FOLDS = 7
#: fold that is never learned from, and the training fold deleted for the weights
HELD_OUT, DELETED = 2, 3
SLAB = (1 << 20) - 4096
#: rows of a chunk, as a power of two: its counts are held at once
CHUNK_BITS = 10
#: buckets of the context frequency: 0, 1, 2-3, 4-7, ..., 2**(n-2) and more
CONTEXTS = 24
#: step of the logarithmic histogram of estimates, and its bins
BIN, BINS = 0.2, 256
_END = U(0x6A09E667F3BCC909)
_SENT = "bucket int, chunk long, keys binary, kept binary, deleted binary"
_REPLY = "chunk long, bucket int, kept binary, deleted binary, types long, kept_tokens long, tokens long"
_ROUNDS = 60


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text with its end, and the number
    of tokens of each text."""
    parts, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in slabs([len(t) for t in texts], SLAB):
        words = Words(texts[a:b], lower=True)
        parts.append(np.insert(words.hashes(FIRST), words.first[1:], _END))
        counts.append(words.counts + 1)
    return np.concatenate(parts), np.concatenate(counts)


def _keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unigram keys, bigram keys): the lowest bit tells them apart.

    Texts follow each other, so the token before a text's first is an end.
    """
    before = np.concatenate([[_END], tokens[:-1]]) if len(tokens) else tokens
    two = _mix(before * U(0x9E3779B97F4A7C15) + (tokens << U(7) | tokens >> U(57)))
    return _mix(tokens) & ~U(1), two | U(1)


def _folds(rows, counts: np.ndarray) -> np.ndarray:
    return np.repeat(rows.column("fold").to_numpy(), counts)


def _ask(buckets: int):
    def ask(rows):
        import pyarrow as pa
        tokens, counts = _tokens(utf8(rows.column("text")))
        fold = _folds(rows, counts)
        unique, at = np.unique(np.concatenate(_keys(tokens)), return_inverse=True)
        sums = [np.bincount(at[np.concatenate([on, on])], minlength=len(unique))
                for on in ((fold != HELD_OUT) & (fold != DELETED), fold == DELETED)]
        out = [(b, X.pack(unique[s]), X.pack_counts(sums[0][s]), X.pack_counts(sums[1][s]))
               for b, s in X.by_bucket(unique, buckets)]
        chunk = rows.column("chunk")[0].as_py()
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*((b, chunk, k, x, y) for b, k, x, y in out))) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "chunk", "keys", "kept", "deleted"])
    return ask


def _sum(rows):
    """Total counts of the keys of one bucket, for each chunk that asked; the
    totals of the bucket's unigrams stand in a row without a chunk."""
    import pyarrow as pa
    keys = [X.unpack(d, "<u8") for d in rows.column("keys").to_pylist()]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = []
    for name in ("kept", "deleted"):
        own = np.concatenate([X.unpack_counts(d) for d in rows.column(name).to_pylist()])
        totals.append(np.bincount(at, own, len(unique)).astype("<i8"))
    bucket = rows.column("bucket")[0].as_py()
    one = unique & U(1) == 0
    both = totals[0] + totals[1]
    out = [(None, bucket, None, None, int((both[one] > 0).sum()), int(totals[0][one].sum()), int(both[one].sum()))]
    cuts = np.cumsum([0, *map(len, keys)])
    for i, chunk in enumerate(rows.column("chunk").to_pylist()):
        own = at[cuts[i]:cuts[i + 1]]
        out.append((chunk, bucket, X.pack_counts(totals[0][own]), X.pack_counts(totals[1][own]), None, None, None))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["chunk", "bucket", "kept", "deleted", "types", "kept_tokens", "tokens"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _counts(rows, replies):
    """Per token of a chunk: counts of context, token and pair, in the kept and
    in all training documents; and the number of tokens of each text."""
    tokens, sizes = _tokens(utf8(rows.column("text")))
    unique, at = np.unique(np.concatenate(_keys(tokens)), return_inverse=True)
    # buckets are ranges of the key: the answers in order of bucket match the keys
    order = np.argsort(replies.column("bucket").to_numpy())
    kept, deleted = (np.concatenate([X.unpack_counts(replies.column(name)[i].as_py()) for i in order.tolist()])
                     for name in ("kept", "deleted"))
    n = len(tokens)
    end = np.searchsorted(unique, _mix(np.array([_END])) & ~U(1))

    def three(counts):
        word = counts[at[:n]]
        # the context of a text's first token is an end, which every chunk has
        return np.concatenate([counts[end], word[:-1]]), word, counts[at[n:]]
    return three(kept), three(kept + deleted), sizes


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), CONTEXTS - 1)


def _bins(p: np.ndarray) -> np.ndarray:
    """Bin of a probability on a logarithmic scale; 0 for probability 0."""
    return np.where(p > 0, np.minimum(1 + (-np.log(np.maximum(p, 1e-300)) / BIN).astype(np.int64), BINS - 1), 0)


def _centre(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp(-(bins - 0.5) * BIN), 0.0)


def _observe(kept_tokens: int):
    """Histogram (cell, n) of the deleted documents' tokens over context bucket
    and the binned estimates of the kept counts."""
    def observe(rows, replies):
        import pyarrow as pa
        if not rows.num_rows or not (rows.column("fold").to_numpy() == DELETED).any():
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        (context, word, pair), _, sizes = _counts(rows, replies)
        on = _folds(rows, sizes) == DELETED
        context, word, pair = context[on], word[on], pair[on]
        two = _bins(pair / np.maximum(context, 1))
        one = _bins(word / max(kept_tokens, 1))
        cell, n = np.unique((context_bucket(context) * BINS + two) * BINS + one, return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})
    return observe


def learn_weights(cell: np.ndarray, n: np.ndarray, types: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Weights (l2, l1, l0) of every context bucket by expectation-maximisation.

    A bucket without held-out tokens takes the weights of all of them together.
    One imaginary token per estimate keeps every weight above zero.
    """
    parts = np.stack([_centre(cell // BINS % BINS), _centre(cell % BINS), np.full(len(cell), 1 / (types + 1))], axis=1)
    bucket = cell // (BINS * BINS)

    def fit(parts, n, start):
        weights = start
        for _ in range(rounds):
            share = parts * weights
            share = share / share.sum(axis=1, keepdims=True) * n[:, None]
            weights = share.sum(axis=0) + 1
            weights = weights / weights.sum()
        return weights

    pooled = fit(parts, n, np.full(3, 1 / 3))
    out = np.tile(pooled, (CONTEXTS, 1))
    for b in range(1, CONTEXTS):
        at = bucket == b
        if at.any():
            out[b] = fit(parts[at], n[at], pooled)
    unseen = bucket == 0
    if unseen.any():
        out[0] = fit(parts[unseen] * [0, 1, 1], n[unseen], pooled)
    out[0, 0] = 0
    out[0] /= out[0].sum()
    return out


def _score(tokens: int, types: int, weights: np.ndarray):
    def score(rows, replies):
        import pyarrow as pa
        _, (context, word, pair), sizes = _counts(rows, replies)
        first = np.cumsum(sizes) - sizes
        base = np.log10((word + 1) / (tokens + types + 1))
        own = weights[context_bucket(context)]
        p = own[:, 0] * pair / np.maximum(context, 1) + own[:, 1] * word / max(tokens, 1) + own[:, 2] / (types + 1)
        return pa.table({
            "doc_id": rows.column("doc_id"), "fold": rows.column("fold"), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat(word > 0, first, dtype=np.int64), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(np.log10(p), first))})
    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Null text is empty: its only token is the end.  Rows with a null id belong
    to fold 0.  Without training documents the estimates are uniform over the
    one unknown token.  Empty tables give no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    chunks, drop = X.chunk_table(docs, F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"),
                                 crc_fold(id_col, FOLDS).alias("fold"), bits=CHUNK_BITS)
    # about one distinct unigram or bigram of a chunk per six bytes
    bytes_ = chunks.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = X.bucket_count(spark, bytes_ // 6)
    asked = X.group_arrow(chunks, "chunk", _ask(buckets), _SENT)
    replies = saved(X.group_arrow(asked, "bucket", _sum, _REPLY), "counts")
    total = replies.where("chunk is null").agg(F.sum("types"), F.sum("kept_tokens"), F.sum("tokens")).first()
    types, kept_tokens, tokens = (x or 0 for x in total)
    answers = replies.where("chunk is not null").select("chunk", "bucket", "kept", "deleted")
    # at most CONTEXTS * BINS * BINS cells
    seen = (X.rejoin(chunks, answers, _observe(kept_tokens), "cell long, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas())
    weights = learn_weights(seen["cell"].to_numpy(), seen["n"].to_numpy(dtype=float), types)
    if not tokens:
        weights[:] = (0, 0, 1)
    rows = saved(X.rejoin(chunks, answers, _score(tokens, types, weights),
                          "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"), "scores")
    drop()
    return rows.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                       F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
