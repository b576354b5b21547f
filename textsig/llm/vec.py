"""Vectorised text primitives over Arrow buffers: words, hashes and n-grams of a whole batch at a time in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc; there large arrays go back to the system at once
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)

_held: list = []


def held(key: object, make: Callable[[], object], drop: Callable[[], None] | None = None) -> object:
    """What make gives, kept for later tasks of this Python worker until something else is asked for under another key; drop: what then lets go of it besides.
    One thing is kept at a time, so that a worker that serves several operators in turn is never as large as all of them together."""
    if not _held or _held[0] != key:
        if _held and _held[2]:
            _held[2]()
        _held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _held.extend((key, make(), drop))
    return _held[1]


U = np.uint64
#: Bytes of a word: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes other than white space.
INK = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | U(1)
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow: dict[str, np.ndarray] = {"r": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["r"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("r", _R), ("inv", _R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[name] = np.cumprod(p, dtype=np.uint64)
    return _pow["r"], _pow["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def spans(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the maximal runs of bytes for which lut holds; no run crosses rows. off starts at 0 of data."""
    flag = lut[data]
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    edge = np.zeros(len(flag) + 1, bool)
    edge[off] = True
    before = np.zeros_like(flag)
    before[1:] = flag[:-1]
    starts = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.zeros_like(flag)
    after[:-1] = flag[1:]
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, of which `hash_between` takes differences."""
    r, _ = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    v = _BYTE[data]
    v *= r[: len(data)]
    np.cumsum(v, out=total[1:])
    return total


def hash_between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, equal for equal bytes wherever they stand."""
    h = total[ends] - total[starts]
    h *= _powers(len(total))[1][starts]
    return mix(h)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hash_between(prefix_sums(data), starts, ends)


def grams(h: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word n-gram. A row of fewer words has one gram, of all its words; an empty one has none."""
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    rows, out = [], []
    for k in range(1, n + 1):
        if k == n:
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        else:
            at = first[count == k]
        if len(at):
            g = np.full(len(at), k, np.uint64)
            for j in range(k):
                g *= _R
                g += h[at + j]
                g ^= g >> U(29)
            rows.append(row[at])
            out.append(mix(g))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, upper 48 bits of the hash), sorted; at most 65,536 rows."""
    key = np.sort((row.astype(np.uint64) << U(48)) | (h >> U(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1)


def chunked(column: pa.Array, most: int = 1 << 20, rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of a string column, a few MB at a time."""
    data, off = strings(column)
    for i, j in spans(off, most):
        for a in range(i, j, rows):
            b = min(j, a + rows)
            yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have at most so many bytes, or one longer row."""
    for batch in batches:
        at = batch.schema.get_field_index(name)
        _, off = strings(batch.column(at))
        for i, j in spans(off, most):
            yield batch.slice(i, j - i)
