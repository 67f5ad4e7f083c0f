"""Exact substring dedup with fixed-block anchors.

A window of n words that occurs twice contains, at its second place, a whole
reference block: blocks are the non-overlapping runs of (n + 1) // 2 words of
every document.  So all blocks are indexed, every rolling window of block length
of every document probes them, and a hit is extended to a maximal exact repeat:
the hit's repeat has n words or more if one of the n-word windows around it
occurs elsewhere as well.  The union of those windows are the words to remove.

Probes, blocks and windows travel as packed arrays of hashes per chunk of
documents (:mod:`exchange`).  A chunk sends each distinct hash once, so a passage
that a third of all documents share reaches its bucket once per chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm import exchange as X
from farmspark.llm.rolling import FIRST, SECOND, U, Words, slabs, utf8
from farmspark.llm.shared import doc_text, saved

WINDOW = 35
SLAB = (1 << 20) - 4096
#: flags below a sent key: seen twice in the chunk, seen as a reference block
_MANY, _BLOCK = 2, 1
_SENT = "bucket int, chunk long, data binary"
_REPLY = "chunk long, bucket int, data binary"


class _Format:
    """How keys of one pass are sent: ``bits`` of the key below its bucket."""

    def __init__(self, bits: int, dtype: str, buckets: int):
        self.bits, self.dtype, self.buckets = bits, dtype, buckets

    def split(self, keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, remaining key): the bucket comes from ``place``."""
        return X.bucket_of(place, self.buckets), keys & U((1 << self.bits) - 1)


def _send(chunk: int, form: _Format, keys, place, block):
    """Rows for the distinct keys of a chunk, with their flags."""
    import pyarrow as pa
    bucket, rest = form.split(keys, place)
    order = np.lexsort((rest, bucket))
    bucket, rest, block = bucket[order], rest[order], block[order]
    new = np.ones(len(rest), bool)
    new[1:] = (rest[1:] != rest[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(rest))) > 1
    anchor = np.logical_or.reduceat(block, first) if len(first) else np.zeros(0, bool)
    bucket, rest = bucket[first], rest[first]
    sent = (rest << U(2) | many.astype(U) * U(_MANY) | anchor.astype(U) * U(_BLOCK)).astype(form.dtype)
    cuts = np.searchsorted(bucket, np.arange(form.buckets + 1))
    rows = [(b, X.pack(sent[cuts[b]:cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()),
                     "chunk": pa.array([chunk] * len(rows), pa.int64()),
                     "data": pa.array([d for _, d in rows], pa.binary())})


def _answer(form: _Format):
    """For each chunk of a bucket, its keys that occur elsewhere, or twice in
    it, and at least once as a reference block."""
    def answer(rows):
        import pyarrow as pa
        sent = [X.unpack(d, form.dtype) for d in rows.column("data").to_pylist()]
        chunk = rows.column("chunk").to_pylist()
        every = np.sort(np.concatenate(sent))
        two = every.dtype.type(2)
        key = every >> two
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        flags = np.bitwise_or.reduceat(every, first)
        count = np.diff(np.append(first, len(key)))
        hit = key[first][((count > 1) | (flags & _MANY > 0)) & (flags & _BLOCK > 0)]
        out = []
        for c, own in zip(chunk, sent):
            own = own >> two
            at = np.minimum(np.searchsorted(hit, own), max(len(hit) - 1, 0))
            own = own[hit[at] == own] if len(hit) else own[:0]
            if len(own):
                out.append((c, X.pack(own)))
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()),
                         "bucket": pa.array([bucket] * len(out), pa.int32()),
                         "data": pa.array([d for _, d in out], pa.binary())})
    return answer


class _Hits:
    """The answers a chunk got, by bucket."""

    def __init__(self, replies, form: _Format):
        self.form = form
        self.keys = {}
        for b, d in zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist()):
            self.keys[b] = X.unpack(d, form.dtype)

    def find(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        bucket, rest = self.form.split(keys, place)
        out = np.zeros(len(keys), bool)
        if not self.keys:
            return out
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.form.buckets + 1))
        for b, hit in self.keys.items():
            at = order[cuts[b]:cuts[b + 1]]
            own = rest[at].astype(hit.dtype)
            out[at] = hit[np.minimum(np.searchsorted(hit, own), len(hit) - 1)] == own
        return out


def _probes(words: Words, size: int):
    """(start, key, is a reference block) of every window of ``size`` words."""
    keys = FIRST.windows(words.hashes(FIRST), size)
    start = np.flatnonzero(words.window_starts(size)[:len(keys)])
    return start, keys[start], words.offset()[start] % size == 0


def _windows(words: Words, size: int):
    """(start, key, place) of every window: two independent hashes."""
    keys = SECOND.windows(words.hashes(SECOND), size)
    start = np.flatnonzero(words.window_starts(size)[:len(keys)])
    return start, keys[start], FIRST.windows(words.hashes(FIRST), size)[start]


def _texts(rows):
    texts = utf8(rows.column("text"))
    for a, b in slabs([len(t) for t in texts], SLAB):
        yield a, texts[a:b]


def _probe(form: _Format, size: int):
    def probe(rows):
        parts = [_probes(Words(t), size)[1:] for _, t in _texts(rows)]
        keys, block = (np.concatenate(x) for x in zip(*parts))
        return _send(rows.column("chunk")[0].as_py(), form, keys, keys, block)
    return probe


def _extend(near: _Format, far: _Format, size: int, window: int):
    """The windows around the hits of a chunk, to be looked for elsewhere."""
    def extend(rows, replies):
        if not rows.num_rows:
            return _send(0, far, np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool))
        hits = _Hits(replies, near)
        keys, place = [np.zeros(0, U)], [np.zeros(0, U)]
        for _, texts in _texts(rows) if hits.keys else ():
            words = Words(texts)
            start, key, _ = _probes(words, size)
            at = start[hits.find(key, key)]
            around = np.zeros(len(words) + 1, np.int64)
            np.add.at(around, np.maximum(at - (window - size), 0), 1)
            np.add.at(around, at + 1, -1)
            around = np.cumsum(around[:-1]) > 0
            start, key, where = _windows(words, window)
            keys.append(key[around[start]])
            place.append(where[around[start]])
        keys, place = np.concatenate(keys), np.concatenate(place)
        return _send(rows.column("chunk")[0].as_py(), far, keys, place, np.ones(len(keys), bool))
    return extend


def _remove(far: _Format, window: int, with_text: bool):
    def remove(rows, replies):
        import pyarrow as pa
        hits = _Hits(replies, far)
        n_words, n_removed, digest, kept_text = [], [], [], []
        for a, texts in _texts(rows):
            words = Words(texts)
            covered = np.zeros(len(words) + 1, np.int64)
            if hits.keys:
                start, key, where = _windows(words, window)
                at = start[hits.find(key, where)]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + window, -1)
            covered = np.cumsum(covered[:-1]) > 0
            gone = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
            for i, text in enumerate(texts):
                own = text.split()
                if gone[i]:
                    own = [w for w, c in zip(own, covered[words.first[i]:words.first[i + 1]].tolist()) if not c]
                kept = b" ".join(own)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
            n_words += words.counts.tolist()
            n_removed += gone.tolist()
        out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_text, pa.string())
        return pa.table(out)
    return remove


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                     with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and,
    ``with_text``, kept_text (the kept words joined by one space).

    Every word covered by a window of ``window`` consecutive words that also
    starts anywhere else, in the same document or another, is removed, at every
    place.  Windows are judged on the input.  Null text has no words; a repeated
    row repeats all its windows.  Window hashes have 62 bits besides the bits of
    their bucket.  Empty tables give no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    size = (window + 1) // 2
    chunks, drop = X.chunk_table(docs, F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
    # at most one window per word, and a word has two bytes or more with its space
    bytes_ = chunks.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = X.bucket_count(spark, bytes_ // 6)
    near, far = _Format(30, "<u4", buckets), _Format(62, "<u8", buckets)

    def answered(sent, form, name):
        return saved(X.group_arrow(sent, "bucket", _answer(form), _REPLY), name)

    hits = answered(X.group_arrow(chunks, "chunk", _probe(near, size), _SENT), near, "hits")
    repeats = answered(X.rejoin(chunks, hits, _extend(near, far, size, window), _SENT), far, "repeats")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    out = saved(X.rejoin(chunks, repeats, _remove(far, window, with_text), schema), "kept")
    drop()
    return out
