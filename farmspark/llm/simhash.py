"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits.  Two fingerprints with at most k differing bits have,
in one of k // 2 + 1 blocks of their bits, at most one differing bit.  Within a
block the anchors are the words of a covering code: a Hamming code on 2**r - 1
bits (perfect, covering radius 1) with the remaining bits free.  Every
fingerprint has a home, the anchor within the covering radius, and is
replicated to every anchor within the covering radius plus one.  Of two
fingerprints with at most one differing bit in the block, each is therefore at
the other's home, and homes are compared with all fingerprints at their anchor.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.blocks import GROUP, chunk_pairs, whole_groups
from farmspark.llm.components import components
from farmspark.llm.rolling import U, _mix, slices, sparing, utf8
from farmspark.llm.shared import doc_text, row_key, saved, stay

BITS = 64
SEED = 42
#: fingerprints of one anchor that are compared as one group
GROUP_ROWS = 4096
_PAIRS = 2_000_000
_SHINGLES = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of a text: majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = words_per_shingle
    if len(words) < n:
        words, n = [b" ".join(words)], 1
    total, ones = len(words) - n + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, _SHINGLES):
        part = words[at:at + _SHINGLES + n - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(n))))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, row_key and fingerprint (long) of every row; null text is empty."""
    def hashed(batches):
        import pyarrow as pa
        for batch in (part for whole in batches for part in slices(whole, 2)):
            own = np.array([fingerprint(t, words_per_shingle) for t in utf8(batch.column(2))], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own.view(np.int64))],
                                  ["doc_id", "row_key", "fingerprint"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                        doc_text(text_col).alias("text"))
            .mapInArrow(sparing(hashed), "doc_id long, row_key string, fingerprint long"))


def block_widths(max_distance: int) -> list[int]:
    """Widths of the blocks of which one holds at most one differing bit."""
    n = max_distance // 2 + 1
    return [BITS // n + (i < BITS % n) for i in range(n)]


def anchors(block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The home of each block value, and all anchors it is replicated to (one
    row each, the home first; a missing anchor repeats the home)."""
    r = (width + 1).bit_length() - 1
    code = (1 << r) - 1
    syndrome = np.zeros(len(block), np.int64)
    for j in range(r):
        mask = U(sum(1 << p - 1 for p in range(1, code + 1) if p >> j & 1))
        syndrome |= (np.bitwise_count(block & mask).astype(np.int64) & 1) << j
    flip = np.where(syndrome > 0, U(1) << (np.maximum(syndrome, 1) - 1).astype(U), U(0))
    home = block ^ flip
    out = [home]
    for free in range(code, width):
        out.append(home ^ (U(1) << U(free)))
    for p in range(1, code + 1):
        q = syndrome ^ p
        at = (syndrome > 0) & (q > p)
        pair = (U(1) << U(p - 1)) | (U(1) << np.maximum(q - 1, 0).astype(U))
        if at.any():
            out.append(np.where(at, block ^ pair, home))
    return home, np.stack(out, axis=1)


def _replicate(max_distance: int):
    widths = block_widths(max_distance)

    def spread(batches):
        import pyarrow as pa
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            shift = 0
            for k, width in enumerate(widths):
                block = (own >> U(shift)) & U((1 << width) - 1)
                shift += width
                home, near = anchors(block, width)
                first = np.zeros(near.shape, bool)
                first[:, 0] = True
                there = (first | (near != home[:, None])).ravel()
                key = _mix(near.ravel()[there] ^ U(k + 1 << 60)).view(np.int64)
                who = np.repeat(own, near.shape[1])[there].view(np.int64)
                yield pa.record_batch([pa.array(key), pa.array(who), pa.array(first.ravel()[there])],
                                      ["bucket", "fingerprint", "home"])

    return spread


def label(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the pairs (i, j)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _compare(max_distance: int):
    def compare(batches):
        import pyarrow as pa
        for rows, bounds in whole_groups(batches):
            own = rows.column("fingerprint").to_numpy().view(np.uint64)
            home = np.flatnonzero(rows.column("home").to_numpy(zero_copy_only=False))
            sizes = np.diff(bounds)
            group = np.repeat(np.arange(len(sizes)), sizes)
            width = sizes[group[home]]
            done = np.cumsum(width)
            cuts = np.unique(np.concatenate([[0], np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, _PAIRS)),
                                             [len(home)]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                h, w = home[a:b], width[a:b]
                left = np.repeat(h, w)
                right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(bounds[group[h]], w)
                gap = np.bitwise_count(own[left] ^ own[right])
                near = (gap <= max_distance) & (gap > 0)
                if not near.any():
                    continue
                nodes, ends = np.unique(np.concatenate([own[left[near]], own[right[near]]]), return_inverse=True)
                half = len(ends) // 2
                lab = label(ends[:half], ends[half:], len(nodes))
                tie = lab != np.arange(len(nodes))
                yield pa.record_batch([pa.array(nodes[tie].view(np.int64)), pa.array(nodes[lab[tie]].view(np.int64))],
                                      ["a", "b"])

    return compare


def links(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect what fingerprints at most ``max_distance`` apart
    connect; ``prints`` holds distinct fingerprints (one long column)."""
    at = prints.mapInArrow(sparing(_replicate(max_distance)), "bucket long, fingerprint long, home boolean")
    sizes = saved(at.groupBy("bucket").agg(F.count("*").alias("n"), F.max("home").alias("any"))
                  .where("n > 1 and any").select("bucket", "n"), "anchors")
    dealt = chunk_pairs(at, sizes, "fingerprint", GROUP_ROWS).select(*GROUP, "fingerprint", "home")
    return dealt.mapInArrow(sparing(_compare(max_distance)), "a long, b long")


def near_dedup_rows(docs: DataFrame, words_per_shingle: int = 3, max_distance: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, fingerprint, component_id, kept.

    Fingerprints at most ``max_distance`` bits apart are linked; component_id is
    the smallest id reachable (null only if every id of the component is).  One
    row of each component is kept: the one with that id, of several such rows
    the first by row_key.  Texts without words have fingerprint zero and link
    like any other.  Empty tables give no rows, other columns are ignored.
    """
    rows = saved(fingerprints(docs, words_per_shingle, id_col, text_col), "fingerprints")
    each = saved(rows.groupBy("fingerprint").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best")), "distinct")
    joined = components(links(each.select("fingerprint"), max_distance))
    root = saved(each.join(joined, each.fingerprint == joined.node, "left")
                 .select("fingerprint", "best", F.coalesce("component", "fingerprint").alias("root")), "roots")
    best = root.groupBy("root").agg(F.min("best").alias("first"))
    of = saved(root.join(best, "root").select("fingerprint", F.col("first.doc_id").alias("component_id"),
                                              F.col("first.row_key").alias("first_key")), "components")
    return (rows.join(of, "fingerprint")
            .select("doc_id", "row_key", "fingerprint", "component_id", (F.col("row_key") == F.col("first_key")).alias("kept")))


def near_dedup(docs: DataFrame, words_per_shingle: int = 3, max_distance: int = 3,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, with its columns as they were."""
    rows = near_dedup_rows(docs, words_per_shingle, max_distance, id_col, text_col)
    return stay(docs, rows.where("kept"), id_col, text_col)
