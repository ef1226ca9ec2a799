"""Words and their hashes of many texts at once, on the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of array work covers (one longer text is a pass of its own).
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[:n], _inverses[:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows of about ``limit`` bytes; nulls
    count as empty. Offsets are relative to the bytes."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end, raw[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
        begin = end


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, ends, bounds)`` of the words (runs of non-blank bytes) of each text; the
    words of text i are ``bounds[i]:bounds[i + 1]``."""
    n = len(raw)
    solid = np.ones(n + 1, bool)
    solid[:n] = (raw != 32) & (raw - np.uint8(9) > 4)
    solid[n] = False
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * q[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)
