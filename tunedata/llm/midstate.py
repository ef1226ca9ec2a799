"""SHA-256 over many short messages at once, with the running states open to copy and resume.

A message here is a run of child digests as hex text: 64 bytes each, one block of SHA-256. A state is
the eight working words after so many whole blocks, ``uint32[8, n]`` for n messages."""

from __future__ import annotations

import numpy as np

WORD = np.uint32


def _root_bits(p: int, degree: int) -> int:
    """The first 32 bits of the fraction of the ``degree``-th root of p, by integers alone."""
    target, lo, hi = p << (32 * degree), 0, p << 32
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid ** degree <= target else (lo, mid - 1)
    return lo & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p ** 0.5) + 1))]
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], WORD)[:, None]
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES], WORD)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> WORD(by)) | (x << WORD(32 - by))


def absorb(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States after one more block each: ``state`` uint32[8, n], ``blocks`` uint8[n, 64], either side
    broadcast from one column."""
    words = np.ascontiguousarray(blocks).view(">u4").astype(WORD).T
    w = [words[i] for i in range(16)]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> WORD(3))) + w[i - 7]
                 + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> WORD(10))))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def _last_block(n_blocks: int) -> np.ndarray:
    block = np.zeros((1, 64), np.uint8)
    block[0, 0] = 0x80
    block[0, 56:] = np.frombuffer((n_blocks * 512).to_bytes(8, "big"), np.uint8)
    return block


def finish(state: np.ndarray, n_blocks: int) -> np.ndarray:
    """Digests uint8[n, 32] of messages of ``n_blocks`` whole blocks whose state this is."""
    return np.ascontiguousarray(absorb(state, _last_block(n_blocks)).T).astype(">u4").view(np.uint8).reshape(-1, 32)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests uint8[n, 32] as hex text uint8[n, 64]: each is one block."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, 0::2] = _HEX[digests >> 4]
    out[:, 1::2] = _HEX[digests & 15]
    return out


def start(n: int) -> np.ndarray:
    """The state before any block, n times."""
    return np.repeat(START, n, axis=1)


def pack(state: np.ndarray) -> bytes:
    """States as 32 bytes each, message by message."""
    return np.ascontiguousarray(state.T).astype(">u4").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").astype(WORD).reshape(-1, 8).T
