"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20        # texts are hashed in runs of about this size; a longer text is a run of its own
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_EXACT = mix(np.arange(256, dtype=U) * U(0x2545F4914F6CDD1D))
_LOWER = _EXACT.copy()
_LOWER[ord("A"):ord("Z") + 1] = _EXACT[ord("a"):ord("z") + 1]
_BASE = U(0x5851F42D4C957F2D)                                   # odd, hence invertible
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of the rows' words) for runs of rows; null counts as empty.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, A-Z lower-cased if ``lower``.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    values = _LOWER if lower else _EXACT
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, n)
        part = data[ends[first]:ends[last]]
        rows = ends[first:last + 1] - ends[first]
        size = len(part)
        word = ~_SPACE[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = rows[:-1][rows[:-1] < size]
        begins[inner] = word[inner]                              # words end with their text
        stops = np.ones(size, bool)
        if size:
            stops[:-1] = ~word[1:]
            stops[inner[inner > 0] - 1] = True
            stops &= word
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _power(max(1, size))
        sums = np.zeros(size + 1, U)
        np.cumsum(values[part] * up[:size], out=sums[1:])
        hashes = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)) if len(s) else np.empty(0, U)
        yield first, hashes, np.searchsorted(s, rows)
        first = last


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words (of which those over a row's end mean nothing)."""
    if len(hashes) < n:
        return np.empty(0, U)
    out = np.full(len(hashes) - n + 1, U(n), U)
    for k in range(n):
        out = mix(out ^ hashes[k:len(hashes) - n + 1 + k])
    return out
