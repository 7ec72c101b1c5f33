"""Vectorised text primitives shared by the corpus operators.

Everything works on one Arrow column of strings at a time: the UTF-8 bytes of all
rows form one flat buffer, and numpy finds the words of all rows at once. No row
is looked at by Python code, so a batch costs the same per byte whether it holds
one long text or thousands of short ones.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 17

#: The bytes that separate words (space, and TAB to CR).
SEPARATORS = b" \t\n\x0b\x0c\r"


def byte_table(separators: bytes = SEPARATORS) -> np.ndarray:
    """True for each byte that belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


WORD_BYTES = byte_table()
LETTER_BYTES = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows back to back and the n + 1 row offsets. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(buf: np.ndarray, rows: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of its first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = rows[:-1][rows[:-1] < rows[1:]]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = rows[1:][rows[:-1] < rows[1:]] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_powers = [np.ones(1, U64), np.ones(1, U64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INV)):
            t = np.full(n, p, U64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of every word's bytes, mapped through fold first. Memory is bounded by blocks of words."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        part = buf[a:b] if fold is None else fold[buf[a:b]]
        up, down = _tables(b - a + 1)
        total = np.zeros(b - a + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] ^ (e - s).astype(U64) << U64(56))
        i = j
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; len(h) - k + 1 of them, none if there are fewer values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    done, width, base, out = 0, 1, h, None
    while True:
        if k >> (width.bit_length() - 1) & 1:
            part = base[done : done + n]
            out = part.copy() if out is None else mix(out * U64(0x9FB21C651E98DF25) + part)
            done += width
        if done == k:
            return out
        base = mix(base[: len(base) - width] * U64(0xD6E8FEB86659FD93) + base[width:])
        width *= 2


def batches(it, limit: int = 2 << 20):
    """Record batches cut so that the strings in each hold about limit bytes, or one row."""
    for batch in it:
        n = batch.num_rows
        step = n if batch.nbytes <= limit or n < 2 else max(1, n * limit // batch.nbytes)
        for i in range(0, n, step):
            yield from _cut(batch.slice(i, step), limit)
    trim()


def trim() -> None:
    """Give free memory back to the system: workers stay alive between tasks, and their heaps would stay as large as they ever were."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _cut(batch, limit):
    if batch.nbytes > 2 * limit and batch.num_rows > 1:
        half = batch.num_rows // 2
        yield from _cut(batch.slice(0, half), limit)
        yield from _cut(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch
