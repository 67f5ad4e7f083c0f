"""Exact dedup with a sharded cuckoo-filter index.

The digest of a document is the SHA-256 of its text with every run of white
space replaced by one space.  Digests are dealt to shards by other
bits than those the filter reads.  Each shard keeps

* a :class:`CuckooFilter`: 16-bit fingerprints in buckets of four slots, which
  says "surely new" or "maybe known" and supports deletion, and
* the *content*: the digests with their counts in the same buckets, one entry
  beside each fingerprint.  A filter hit is verified against that entry, a "no"
  reads none, and an overfull filter is rebuilt from the entries at twice its
  size.

A map task runs the same index over its own rows before anything is shuffled
(a bounded one: when it is full, half of its digests are sent on and deleted,
by a hand that goes round the buckets), so a text held by a third of all rows
leaves each task a few times, not millions of times.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.rolling import sparing
from farmspark.llm.shared import SPACE, doc_text, row_key, saved, shuffle_partitions, stay

#: keys of one shard, on average
SHARD_KEYS = 200_000
#: live digests of a map task's own index
LOCAL_KEYS = 100_000

_ENTRY = "digest binary, best_null boolean, best_id long, best_row long, n long"


class CuckooFilter:
    """Cuckoo filter over digests (bytes) with its content in the same buckets.

    ``table`` has the 16-bit fingerprints (0: free), ``held`` at the same places
    the entries, lists that begin with their digest.  ``maybe`` reads fingerprints
    only and never denies a live key; ``find`` reads the entry of a fitting
    fingerprint and compares the whole digest, so a "no" touches no content and no
    digest is held twice.  A key must be inserted once.  When an insertion finds no
    place after ``kicks`` moves, the table doubles and is refilled from the
    entries.
    """

    slots = 4
    kicks = 200

    def __init__(self, keys: Iterable[bytes] = (), buckets: int = 256):
        self.buckets = buckets
        self.resizes = self.live = 0
        self._clear()
        for k in keys:
            self.insert(k)

    def _clear(self) -> None:
        n = self.buckets * self.slots
        self.table, self.held = array("H", bytes(2 * n)), [None] * n

    def _place(self, key: bytes) -> tuple[int, int]:
        mark = int.from_bytes(key[8:10], "big") or 1
        return mark, int.from_bytes(key[:8], "big") % self.buckets

    def _other(self, at: int, mark: int) -> int:
        # an involution for any power of two: xor with a hash of the mark
        return at ^ (mark * 0x5BD1E995 & self.buckets - 1)

    def maybe(self, key: bytes) -> bool:
        mark, at = self._place(key)
        t, s = self.table, self.slots
        if mark in t[at * s:at * s + s]:
            return True
        at = self._other(at, mark)
        return mark in t[at * s:at * s + s]

    def _slot(self, key: bytes) -> int:
        """Place of a live key, -1 for others."""
        mark, at = self._place(key)
        t, s = self.table, self.slots
        for first in (at * s, self._other(at, mark) * s):
            if mark in t[first:first + s]:
                for i in range(first, first + s):
                    if t[i] == mark and self.held[i][0] == key:
                        return i
        return -1

    def find(self, key: bytes) -> list | None:
        """The entry of a live key."""
        i = self._slot(key)
        return None if i < 0 else self.held[i]

    def _put(self, mark: int, at: int, entry: list) -> bool:
        t, s = self.table, self.slots
        for i in range(at * s, at * s + s):
            if not t[i]:
                t[i], self.held[i] = mark, entry
                return True
        return False

    def _add(self, entry: list) -> list | None:
        """Place an entry; returns the one that is left without a place."""
        mark, at = self._place(entry[0])
        if self._put(mark, at, entry):
            return None
        at = self._other(at, mark)
        for kick in range(self.kicks):
            if self._put(mark, at, entry):
                return None
            i = at * self.slots + kick % self.slots
            mark, self.table[i] = self.table[i], mark
            entry, self.held[i] = self.held[i], entry
            at = self._other(at, mark)
        return entry

    def insert(self, key: bytes, *values) -> None:
        self.live += 1
        left = self._add([key, *values])
        if left is not None:
            self._resize([left, *self.entries()])

    def _resize(self, entries: list[list]) -> None:
        while True:
            self.buckets *= 2
            self.resizes += 1
            self._clear()
            if all(self._add(e) is None for e in entries):
                return

    def entries(self) -> list[list]:
        """The entries of all live keys."""
        return [e for e in self.held if e is not None]

    def _free(self, i: int) -> list:
        entry, self.held[i], self.table[i] = self.held[i], None, 0
        self.live -= 1
        return entry

    def delete(self, key: bytes) -> list | None:
        """Remove a live key and return its entry; an unknown key is left alone."""
        i = self._slot(key)
        return None if i < 0 else self._free(i)

    def sweep(self, n: int, hand: int = 0) -> tuple[list[list], int]:
        """Remove ``n`` entries from place ``hand`` on, round and round; returns
        them and the place where the next sweep goes on."""
        out = []
        while len(out) < n and self.live:
            hand %= len(self.held)
            if self.held[hand] is not None:
                out.append(self._free(hand))
            hand += 1
        return out, hand


class Shard:
    """The live digests of one shard; an entry is [digest, best, n]."""

    def __init__(self, limit: int | None = None):
        self.filter = CuckooFilter()
        self.limit = limit
        self.hand = 0

    @property
    def content(self) -> list[bytes]:
        return [e[0] for e in self.filter.entries()]

    def insert(self, digest: bytes, best: tuple, n: int):
        """Count ``n`` more documents; returns entries evicted by the limit."""
        known = self.filter.find(digest)
        if known is not None:
            known[1] = min(known[1], best)
            known[2] += n
            return ()
        self.filter.insert(digest, best, n)
        if self.limit is None or self.filter.live <= self.limit:
            return ()
        # the hand comes back to a digest after half a table of others
        out, self.hand = self.filter.sweep(max(1, self.limit // 2), self.hand)
        return out

    def take(self, digest: bytes) -> list | None:
        """Delete a digest and return its entry (None for an unknown one)."""
        return self.filter.delete(digest)

    def rows(self) -> list[list]:
        return self.filter.entries()


def _entries(items):
    import pyarrow as pa
    items = list(items)
    return pa.record_batch([
        pa.array([d for d, _, _ in items], pa.binary()),
        pa.array([b[0] for _, b, _ in items], pa.bool_()),
        pa.array([None if b[0] else b[1] for _, b, _ in items], pa.int64()),
        pa.array([b[2] for _, b, _ in items], pa.int64()),
        pa.array([n for _, _, n in items], pa.int64())], ["digest", "best_null", "best_id", "best_row", "n"])


def _best(null, doc_id, row):
    """Order of the rows of one text: smallest id first, null ids last."""
    return (null, 0 if null else doc_id, row)


def _local(batches):
    index = Shard(LOCAL_KEYS)
    for batch in batches:
        digest, ids, rows = (batch.column(c).to_pylist() for c in ("digest", "doc_id", "row"))
        out = []
        for d, i, r in zip(digest, ids, rows):
            out += index.insert(d, _best(i is None, i, r), 1)
        if out:
            yield _entries(out)
    yield _entries(index.rows())


def _merge(batches):
    """Rows sorted by shard: one index at a time."""
    index, current = Shard(), None
    for batch in batches:
        for shard, d, null, i, r, n in zip(*(batch.column(c).to_pylist() for c in (
                "shard", "digest", "best_null", "best_id", "best_row", "n"))):
            if shard != current:
                yield _entries(index.rows())
                index, current = Shard(), shard
            index.insert(d, _best(null, i, r), n)
    yield _entries(index.rows())


def digest_column(text_col: str = "text"):
    """SHA-256 (binary) of the white-space normalised text; null is empty."""
    return F.unhex(F.sha2(F.regexp_replace(doc_text(text_col), SPACE, " ").cast("binary"), 256))


class DigestIndex:
    """Live digests of a corpus, bucketed by shard, in the shared folder.

    ``content`` has one row per live digest: ``shard, digest`` (binary),
    ``best_null, best_id, best_row`` (the row that stays) and ``n``.
    Every change returns a new index; the old one stays readable.
    """

    def __init__(self, content: DataFrame, shards: int):
        self.content, self.shards = content, shards

    @staticmethod
    def empty(spark, shards: int) -> "DigestIndex":
        return DigestIndex(spark.createDataFrame([], "shard int, " + _ENTRY), shards)

    def _shard(self):
        # other digits than those the filter places a key by
        return F.pmod(F.conv(F.substring(F.hex("digest"), 33, 7), 16, 10).cast("long"),
                      F.lit(self.shards)).cast("int").alias("shard")

    def insert(self, rows: DataFrame) -> "DigestIndex":
        """``rows``: digest (binary), doc_id, row."""
        fresh = rows.mapInArrow(sparing(_local), _ENTRY).select(self._shard(), "*")
        return self._merged(self.content.unionByName(fresh))

    def _merged(self, entries: DataFrame) -> "DigestIndex":
        parts = min(self.shards, 4 * shuffle_partitions(entries.sparkSession))
        dealt = entries.repartition(parts, "shard").sortWithinPartitions("shard")
        merged = dealt.mapInArrow(sparing(_merge), _ENTRY).select(self._shard(), "*")
        return DigestIndex(saved(merged, "digest_index"), self.shards)

    def delete(self, digests: DataFrame) -> "DigestIndex":
        """Without the given digests (column ``digest``); unknown ones are ignored."""
        shards = self.shards

        def drop(left, right):
            import pyarrow as pa
            index = Shard()
            for d, null, i, r, n in zip(*(left.column(c).to_pylist() for c in (
                    "digest", "best_null", "best_id", "best_row", "n"))):
                index.insert(d, _best(null, i, r), n)
            for d in right.column("digest").to_pylist():
                index.take(d)
            return pa.Table.from_batches([_entries(index.rows())])

        gone = digests.where("digest is not null").select("digest").distinct().select(self._shard(), "digest")
        kept = self.content.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(drop, _ENTRY)
        return DigestIndex(saved(kept.select(self._shard(), "*"), "digest_index"), shards)


def shard_count(n: int) -> int:
    return max(1, math.ceil(n / SHARD_KEYS))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, digest (binary), keep_id,
    group_size, kept.

    Of equal texts (null counts as empty) the row with the smallest id stays,
    null ids last; of rows that share text and id exactly one stays.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_column(text_col).alias("digest"),
                             row_key(id_col, text_col).alias("row_key"), F.monotonically_increasing_id().alias("row")),
                 "digests")
    shards = max(shard_count(rows.count()), shuffle_partitions(spark))
    index = DigestIndex.empty(spark, shards).insert(rows)
    content = index.content.select("digest", F.col("best_id").alias("keep_id"), "best_row",
                                   F.col("n").alias("group_size"))
    return (rows.join(content, "digest")
            .select("doc_id", "row_key", "digest", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    return stay(docs, dedup_rows(docs, id_col, text_col).where("kept"), id_col, text_col)
