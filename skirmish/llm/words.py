"""Words of whole Arrow text columns as numpy arrays: places, hashes, hashes of word windows.

The functions run inside ``mapInArrow`` tasks. A column is worked through in blocks of about a
megabyte, so memory depends on the block and on the longest single text, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def separators(kept: str | None = None) -> np.ndarray:
    """Flags of the byte values between words: ASCII space and 09-0D, or all ASCII but ``kept``."""
    flags = np.zeros(256, bool)
    if kept is None:
        flags[[0x20, *range(0x09, 0x0E)]] = True
    else:
        flags[:128] = True
        flags[[ord(c) for c in kept]] = False
    return flags


SPACES = separators()
ALNUM = separators("abcdefghijklmnopqrstuvwxyz0123456789")

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        known = _powers[int(base)] = (out[0], out[1])
    return known[0][:n], known[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of every integer in the half-open ranges, in order."""
    n = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(n)), n)
    ahead = np.cumsum(n) - n
    return owner, np.arange(int(n.sum())) - ahead[owner] + start[owner]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets.astype(np.int64)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets from 0) of consecutive rows of about ``size`` bytes."""
    data, offsets = raw(column)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """All words of the texts ``data[offsets[i]:offsets[i + 1]]``.

    start, end: byte places of each word; row: its text; first: index of each text's first word,
    with the number of all words behind them.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray = SPACES, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        n = len(data)
        inside = ~flags[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self._hash: np.ndarray | None = None
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hash is None:
            up, down = powers(BASE, len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            self._hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        return self._hash

    def replaced(self, hashes: np.ndarray) -> Words:
        """These words under other hashes, for windows over classes of words."""
        self._hash, self._sums = hashes, None
        return self

    def windows(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the word sequence start..stop of each pair."""
        if self._sums is None:
            up, _ = powers(STEP, len(self) + 1)
            self._sums = np.zeros(len(self) + 1, np.uint64)
            np.cumsum(self.hash * up[:-1], out=self._sums[1:])
        _, down = powers(STEP, len(self) + 1)
        return mix((self._sums[stop] - self._sums[start]) * down[start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of all windows of ``k`` words that lie in one text."""
        if len(self) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(self) - k + 1] == self.row[k - 1 :])
        return at, self.windows(at, at + k)

    def joined(self, start: int, stop: int) -> bytes:
        """The words start..stop joined by one space."""
        return b" ".join(self.data[self.start[start] : self.end[stop - 1]].tobytes().split()) if stop > start else b""
