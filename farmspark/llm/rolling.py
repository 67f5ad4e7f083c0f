"""Words of many texts as numpy arrays, with polynomial hashes of words and of
rolling word windows.

The texts of a batch are laid end to end in one byte buffer.  A hash of any
byte range is the difference of two prefix sums of ``table[byte] * B**i``
(mod 2**64) brought back by ``B**-i``; word windows do the same over word
hashes.  No Python object is made per word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: bytes or words whose prefix sums and powers are held at once
_BLOCK = (1 << 20) - 1
#: bytes of text that an operator takes out of a batch at a time
SLICE = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Poly:
    """One polynomial hash family: byte table, base and its inverse powers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes_of = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
        self.base = int(rng.integers(1 << 40, 1 << 63)) * 8 + 5 & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    @staticmethod
    def _grow(powers: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(powers) < n:
            step = U(pow(base, len(powers), 1 << 64))
            powers = np.concatenate([powers, powers * step])
        return powers

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._grow(self.up, self.base, n)
            self.down = self._grow(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]

    def ranges(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every byte range [start, end); starts and ends ascend."""
        out = np.empty(len(starts), U)
        a = 0
        while a < len(starts):
            low = starts[a]
            b = max(a + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
            out[a:b] = self._ranges(buf[low:ends[b - 1]], starts[a:b] - low, ends[a:b] - low)
            a = b
        return out

    def _ranges(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum(self.bytes_of[buf] * up[:-1], out=total[1:])
        out = (total[ends] - total[starts]) * down[starts]
        return _mix(out + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of every run of ``n`` consecutive entries (across documents)."""
        count = max(0, len(hashes) - n + 1)
        out = np.empty(count, U)
        step = max(1, _BLOCK - n)
        for a in range(0, count, step):
            part = hashes[a:a + step + n - 1]
            up, down = self.powers(len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part * up[:-1], out=total[1:])
            out[a:a + step] = _mix((total[n:] - total[:-n]) * down[:len(part) - n + 1])
        return out


FIRST = Poly(11)
SECOND = Poly(29)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


#: everything but ASCII letters and digits and the bytes of other characters
NOT_TERM = np.ones(256, bool)
NOT_TERM[128:] = False
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


class Words:
    """The white-space separated words of a batch of UTF-8 texts.

    ``starts`` / ``ends``: byte range of each word; ``first``: index of each
    document's first word (one more entry than documents); ``doc``: document
    index of each word.  ``breaks``: which bytes are not part of a word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, breaks: np.ndarray = IS_SPACE):
        self.buf = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        space = breaks[self.buf]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, begin)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, family: Poly = FIRST) -> np.ndarray:
        return family.ranges(self.buf, self.starts, self.ends)

    def window_starts(self, n: int) -> np.ndarray:
        """True at each word where a window of ``n`` words of one document starts."""
        at = np.arange(len(self))
        return at + n <= np.repeat(self.first[1:], self.counts)

    def offset(self) -> np.ndarray:
        """Index of each word within its document."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)


def slabs(sizes: list[int], limit: int):
    """Ranges of consecutive items of at most ``limit`` bytes (one item at least)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def utf8(column) -> list[bytes]:
    """Bytes of an Arrow string column; null is empty."""
    import pyarrow as pa
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch, column: int):
    """Parts of an Arrow batch with at most SLICE bytes of text (one row at least)."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slabs(sizes, SLICE):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return unused memory to the system: a Python worker lives on, and keeps
    its high-water mark beside the workers of later operators."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sparing(f):
    """``f`` over the batches of a partition, giving memory back at its end."""
    def run(batches):
        yield from f(batches)
        give_back()
    return run
