"""Vectorised text kernels: words and their hashes from the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE_BYTES = np.zeros(256, bool)
WHITE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that one round of a kernel takes, unless a single text or word is longer.
PIECE = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random value per byte; A-Z share those of a-z, so hashes ignore ASCII case.
FOLDED = mix64(np.arange(1, 257, dtype=np.uint64))
FOLDED[65:91] = FOLDED[97:123]
EXACT = mix64(np.arange(1, 257, dtype=np.uint64))
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n-1 modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 4096) - 1, BASE, np.uint64))])
    return _powers[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts back to back, and each text's first byte (one entry more than texts). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width, len(column) + 1, column.offset * width().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, end - start, start) if data is not None and end > start else np.empty(0, np.uint8)
    return raw, offsets - start


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` text bytes each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def spans(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that aren't ``outside``, and the first run of every text (one entry more than texts)."""
    black = ~outside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = black.copy()
    begin[1:] &= ~black[:-1] | edge[1:-1]
    finish = black.copy()
    finish[:-1] &= ~black[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        first, length = starts[at:to], ends[at:to] - starts[at:to]
        total = int(length.sum())
        begins = np.cumsum(length) - length
        inside = np.arange(total) - np.repeat(begins, length)
        values = table[raw[np.repeat(first, length) + inside]] * powers(int(length.max(initial=0)) + 1)[inside]
        out[at:to] = mix64(np.add.reduceat(values, begins) + length.astype(np.uint64)) if total else mix64(length.astype(np.uint64))
        at = to
    return out


def pairs_within(keys: np.ndarray, inside: np.ndarray, second: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (left, right) of the pairs of each stretch of equal ``keys``, some ``most`` at a time.

    Rows are sorted by key, then ``second``. Where ``inside`` holds, every two rows of a
    stretch are a pair; elsewhere those of which just the right one is ``second``.
    """
    rows = len(keys)
    if not rows:
        return
    new = np.ones(rows, bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], rows)
    stretch = np.cumsum(new) - 1
    firsts = np.add.reduceat((~second).astype(np.int64), begins)
    low = np.where(inside, np.arange(rows) + 1, np.where(second, ends[stretch], begins[stretch] + firsts[stretch]))
    count = ends[stretch] - low
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        left = np.repeat(np.arange(at, to), count[at:to])
        if len(left):
            yield left, low[left] + np.arange(len(left)) - (total[left] - total[at])
        at = to


def union(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``labels`` (each row's smallest known fellow) after the rows of each pair became fellows."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]
