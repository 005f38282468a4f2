"""Vectorised text kernels over Arrow string columns (numpy only).

A column is handled as one UTF-8 byte array with document offsets; words,
word hashes and word windows are found for all documents of a slice at once.
All hashes are 64-bit, fixed, and independent of process and platform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _TABLES[name] = have
    return have[:n]


def _byte_values() -> np.ndarray:
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _TABLES["bytes"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with c[e] - c[s] = sum of value(byte i) * base**i over s <= i < e."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * _powers("up", _BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent hash of each byte span [start, end)."""
    down = _powers("down", _INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_class(keep) -> np.ndarray:
    """Boolean table of the bytes for which ``keep(byte)`` holds."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Words of op1 and op6: everything but the six ASCII blanks.
NOT_BLANK = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words of op7: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (length + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Document ranges of at most ``limit`` bytes each (one document at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of all words, and each document's offset among them."""
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries (shorter by size - 1)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k: k + n]
    return mix(out)


def shingle_sets(column: pa.Array, size: int = 5):
    """For each document of the column: its sorted distinct word-shingle hashes.

    ASCII letters are lower-cased; a document with fewer than ``size`` words
    has its whole word sequence as its one shingle, one without words none.
    """
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = LOWER[data[offsets[first]: offsets[last]]]
        local = offsets[first: last + 1] - offsets[first]
        starts, ends, at = words(part, local, NOT_BLANK)
        word = span_hashes(prefix_hashes(part), starts, ends)
        full = windows(word, size)
        for d in range(last - first):
            a, b = at[d], at[d + 1]
            if b - a >= size:
                run = np.sort(full[a: b - size + 1])
                yield run[np.concatenate(([True], run[1:] != run[:-1]))]
            elif b > a:
                yield windows(word[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


SET_SALT = np.uint64(0x5851F42D4C957F2D)


def set_key(shingles: np.ndarray) -> int:
    """Signed 64-bit key of a shingle set."""
    if not len(shingles):
        return 0
    total = mix(shingles ^ SET_SALT).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])
