"""Packing tokenised documents into sequences: bounded-space online best fit.

Documents become runs of token ids (each ended by one separator id), long ones
are cut into full pieces, and every packing task places its pieces, one at a
time, into a fixed number of open bins.  The open bins are kept in one bitset
keyed by free space, so the tightest bin that still fits is one bit operation
away; when all bins are open, the fullest one closes first.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.rolling import slices, sparing, utf8
from farmspark.llm.shared import doc_text, saved
from farmspark.llm.wordpieces import encoder

#: open bins of a packing task
OPEN_BINS = 4096
#: pieces of a packing task, on average
TASK_PIECES = 100_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open bins by free space: ``bits`` has bit f set while a bin with f free
    places is open; ``bins[f]`` are those bins as [sequence, used]."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.open_bins = size, open_bins
        self.bits = 0
        self.bins: dict[int, list[int]] = {}
        self.opened = self.open = 0

    def _push(self, free: int, sequence: int) -> None:
        self.bins.setdefault(free, []).append(sequence)
        self.bits |= 1 << free
        self.open += 1

    def _pop(self, free: int) -> int:
        held = self.bins[free]
        sequence = held.pop()
        if not held:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._pop(free)
        else:
            if self.open >= self.open_bins:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.size, self.opened
            self.opened += 1
        if free > length:
            self._push(free - length, sequence)
        return sequence, self.size - free


def word_path() -> str:
    """The public word-level BPE file (48,894 merges, lower case)."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, separator: int = 0,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every document (null text: empty).

    Columns: doc_id, piece, start, length, ids_crc32 and, ``with_ids``, ids.
    Only documents of more than ``size`` ids are cut.  A repeated row gives its
    pieces again.
    """
    def cut(batches):
        import pyarrow as pa
        text_ids = encoder(tokenizer_path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, bounds = text_ids.ids(utf8(batch.column(1)))
            # every document gets its separator behind it
            bounds = bounds + np.arange(len(bounds))
            own = np.full(bounds[-1], separator, "<u4")
            real = np.ones(len(own), bool)
            real[bounds[1:] - 1] = False
            own[real] = ids
            count = -(-np.diff(bounds) // size)
            first = np.cumsum(count) - count
            doc = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(doc)) - first[doc]
            begin = bounds[doc] + piece * size
            end = np.minimum(begin + size, bounds[doc + 1])
            data = memoryview(own.tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
            arrays = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()),
                      pa.array(end - begin, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1:]), pa.int32()),
                                                       pa.array(own.astype(np.int32))))
                names.append("ids")
            yield pa.record_batch(arrays, names)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
            .mapInArrow(sparing(cut), _PIECES + (", ids array<int>" if with_ids else "")))


def pack_pieces(rows: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """``rows`` (with doc_id, piece, length from 1 to ``size``) plus sequence_id
    and offset.  Pieces are dealt to tasks by hash and arrive longest first;
    each task packs its own bins, so only the bins open at its end are short."""
    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        fit = BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            yield pa.record_batch(
                [*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()),
                 pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    tasks = max(1, math.ceil(rows.count() / TASK_PIECES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return (rows.repartition(tasks, F.xxhash64("doc_id", "piece"))
            .sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(sparing(place), schema))


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = 2048, separator: int = 0,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    An empty table gives no rows; null and empty texts are one piece of the
    separator.  Repeated rows and ids give their pieces again, ties in length go
    by id and piece; other columns, whatever their names, are ignored.
    """
    cut = saved(pieces(docs, tokenizer_path or word_path(), size, separator, id_col, text_col, with_ids), "pieces")
    return pack_pieces(cut, size)
