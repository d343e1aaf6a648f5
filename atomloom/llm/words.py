"""Words, lines and their hashes for many texts at once, on their UTF-8 bytes.

A word is a run of bytes outside space and 0x09-0x0D; those are all ASCII, so this is right on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text makes a group of its own.
GROUP_BYTES = 1 << 21
#: Bytes whose hashes are computed at a time.
BLOCK = 1 << 18

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):  # powers wrap
                self.up = np.concatenate([self.up, self.up * (self.up[-1] * BASE)])
                self.down = np.concatenate([self.down, self.down * (self.down[-1] * _INVERSE)])
            assert len(self.up) == 2 * k
        return self.up, self.down


POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, origin + BLOCK, "right")))
        end = int(ends[stop - 1])
        up, down = POWERS.upto(end - origin + 1)
        total = np.zeros(end - origin + 1, dtype=np.uint64)
        np.cumsum((data[origin:end].astype(np.uint64) + np.uint64(1)) * up[: end - origin], out=total[1:])
        s, e = starts[at:stop] - origin, ends[at:stop] - origin
        out[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return out


@dataclass
class Texts:
    """A group of texts: rows lo..hi of a batch, their bytes end to end, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, word_offsets): words of all texts; those of text i are word_offsets[i]:word_offsets[i+1]."""
        inside = IS_WORD[self.data]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        first = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[first] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[last] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def groups(column: pa.Array, lower: bool = False) -> Iterator[Texts]:
    """The texts of an Arrow string column in groups of about GROUP_BYTES; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, "right")) - 1)
        data = raw[offsets[lo] : offsets[hi]]
        yield Texts(lo, hi, LOWER[data] if lower else data, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the place of each run's first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        joined = joined * BASE + hashes[k : n - width + 1 + k]
    ok = np.ones(n - width + 1, dtype=bool)
    for cut in offsets[1:-1]:
        ok[max(0, cut - width + 1) : cut] = False
    place = np.flatnonzero(ok)
    return mix(joined[place] + np.uint64(width)), place
