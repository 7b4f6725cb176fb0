"""Arrays as compressed binary values, and groups of consecutive Arrow rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .word_arrays import U


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps idle Python workers, next to the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # of the C library on Linux
    if trim is not None:
        trim(0)


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (_zstd().compress(planes).to_pybytes() if len(a) else b"")


def unpack(body: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(body[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(_zstd().decompress(body[8:], n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their differences."""
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the table partitions, ranges of equal width, in ascending keys."""
    high = keys >> U(32)
    inner = np.searchsorted(high, (np.arange(1, parts, dtype=U) << U(32)) // U(parts))
    return np.concatenate(([0], inner, [len(keys)]))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys; holds one group (and one batch) at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
