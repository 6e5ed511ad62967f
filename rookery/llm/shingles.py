"""Word shingles of whole Arrow columns as 64-bit hashes, with numpy.

Words are runs of bytes that are none of blank, tab, line feed, vertical tab, form
feed and return; A-Z count as a-z. A text with fewer words than a shingle has its
whole sequence as one; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = 20240611
#: Bytes of text that the array steps take at once; a longer text is taken alone.
_SLICE_BYTES = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    by_byte = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    by_byte[65:91] = by_byte[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    odd = draw.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return by_byte, space, odd


_BY_BYTE, _SPACE, _ODD = _tables()
_BASE = _ODD[-1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """A string column cut into parts of bounded size, each with its place: the arrays
    for one part take many times the bytes of its texts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + _SLICE_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, column.slice(start, stop - start)
        start = stop


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a string column without nulls, and the border of each text."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    borders = (offsets - offsets[0]).astype(np.int64)
    inside = np.flatnonzero(~_SPACE[raw])
    if not len(inside):
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    first_byte = np.zeros(len(raw) + 1, bool)
    first_byte[borders] = True
    new = np.empty(len(inside), bool)
    new[0] = True
    new[1:] = (np.diff(inside) > 1) | first_byte[inside[1:]]
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(inside)))
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    place = np.arange(len(inside)) - np.repeat(at, sizes)
    hashes = np.add.reduceat(_BY_BYTE[raw[inside]] * powers[place], at)
    return mix(hashes), np.searchsorted(inside[at], borders)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [found for _, part in slices(column) for found in _part_sets(part, size)]


def _part_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    words, borders = word_hashes(column)
    window = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        window += words[k : len(words) - size + 1 + k] * _ODD[k] if len(window) else window
    window = mix(window)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(window[a : b - size + 1]))
        elif b > a:
            whole = (words[a:b] * _ODD[size : size + b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
