"""Words of Arrow text columns as NumPy arrays, a bounded slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: all of ASCII but letters and digits
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** i modulo 2**64 for i below n at least."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * BASE)])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows: 64-bit hashes, byte spans in ``data``, and the first word of each row (one more at the end)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


def words_of(texts: pa.Array, lower: bool = False, between: np.ndarray = SPACE) -> Words:
    """Words are maximal runs of bytes that are not ``between`` (0x20 and 0x09 to 0x0D); null has none.  lower: A-Z only."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    cut = (offsets - offsets[0]).astype(np.int64)
    if lower:
        data = LOWER[data]
    inside = ~between[data]
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    first[cut[:-1][cut[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[cut[1:][cut[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    if not len(starts):
        return Words(data, np.zeros(0, np.uint64), starts, ends, np.zeros(len(cut), np.int64))
    stops = np.append(starts[1:], len(data))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, stops - starts)
    values = (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers(int(at.max()) + 1)[at]
    values[~inside[starts[0] :]] = 0
    hashes = mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, cut))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text; a longer row comes alone."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            yield b.slice(at, to - at)
            at = to


def spans_of(row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words inside one row each, and the row of each."""
    sizes = np.diff(row)
    n = np.maximum(0, sizes - width + 1)
    rows = np.repeat(np.arange(len(n)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(row[:-1], n)
    return starts, rows


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Scrambled fingerprints of all ``width`` consecutive entries of ``h``, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(width + 1)
    out, done, have, size = np.zeros(n, np.uint64), 0, h, 1
    while True:
        if width & size:
            out = out * p[size] + have[done : done + n]
            done += size
        if size * 2 > width:
            return mix(out)
        have = have[: len(have) - size] * p[size] + have[size:]
        size *= 2
