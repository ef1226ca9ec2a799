"""Exact spectra of symmetric integer matrices: characteristic polynomial modulo primes, Chinese
remaindering, isolation of real roots in integers, components by inverse iteration in long fixed point."""

from __future__ import annotations

import math

import numpy as np

#: Products of two residues fit a signed 64-bit integer.
PRIME_BITS = 31
#: Bits of the fixed point beyond the size of the matrix.
GUARD_BITS = 192


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest primes below ``top`` (below 2**32: three bases decide)."""
    found, p = [], top - 1 - top % 2
    while len(found) < count:
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        if all(any(pow(a, d << r, p) == p - 1 for r in range(s)) or pow(a, d, p) == 1 for a in (2, 7, 61)):
            found.append(p)
        p -= 2
    return found


def coefficient_bits(diagonal: list[int]) -> int:
    """Bits that hold every coefficient of a positive semidefinite matrix, with sign: the k-th is the sum
    of the products of k eigenvalues, at most (1 + trace / d) ** d in all."""
    d = max(len(diagonal), 1)
    return d * ((sum(diagonal) // d + 2).bit_length()) + 2


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo p, constant first, of det(x I - matrix): Hessenberg form by elimination and
    its exact inverse on the columns, then the recurrence over leading minors."""
    h = matrix.astype(np.int64) % p
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1][None, :] % p) % p
        # Column k+1 gains each eliminated column times its factor, reduced before the sum.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor[None, :] % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for m in range(n):
        cur = np.zeros(m + 2, np.int64)
        cur[1:] = polys[m]
        cur[:-1] = (cur[:-1] - h[m, m] * polys[m]) % p
        chain = 1
        for i in range(m - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            cur[:i + 1] = (cur[:i + 1] - (chain * int(h[i, m]) % p) * polys[i]) % p
        polys.append(cur % p)
    return [int(c) for c in polys[n]]


def combine(residues: list[int], primes: list[int]) -> int:
    """The integer of least size with these residues, by halves."""
    pairs = [(r % p, p) for r, p in zip(residues, primes)]
    while len(pairs) > 1:
        joined = [(a + m * ((b - a) * pow(m, -1, n) % n), m * n) for (a, m), (b, n) in zip(pairs[::2], pairs[1::2])]
        pairs = joined + pairs[len(pairs) // 2 * 2:]
    value, modulus = pairs[0]
    return value - modulus if 2 * value > modulus else value


def _above(poly: list[int], at: int, shift: int) -> int:
    """Roots, with their multiplicity, above ``at / 2**shift`` of a polynomial all whose roots are real:
    the sign changes of its Taylor shift, which Descartes' rule then counts exactly."""
    n = len(poly) - 1
    while shift and at % 2 == 0:
        at, shift = at >> 1, shift - 1
    c = [a << (shift * (n - i)) for i, a in enumerate(poly)]  # roots times 2**shift
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def top_roots(poly: list[int], count: int, bits: int) -> list[tuple[int, int, int]]:
    """The ``count`` greatest roots, falling, of a polynomial with real roots of at least 0, as
    ``(numerator, shift, number in the same interval)``: each lies in ``(numerator - 1, numerator] / 2**shift``,
    known to ``bits`` bits. Roots that no such interval parts count as one root several times.

    Sign changes of Taylor shifts isolate the roots; a root alone in its interval is then halved in by the sign
    of the polynomial itself."""
    n = len(poly) - 1
    shape = max((abs(a).bit_length() + n - i - 1) // (n - i) for i, a in enumerate(poly[:-1])) + 2 if n else 1
    out: list[tuple[int, int, int]] = []
    shift = max(bits - shape, 0)

    def sign(at: int) -> int:
        down = shift
        while down and at % 2 == 0:
            at, down = at >> 1, down - 1
        v = 0
        for i, a in enumerate(reversed(poly)):  # Horner on 2**(down * n) times the value
            v = v * at + (a << (down * i))
        return (v > 0) - (v < 0)

    def split(lo: int, hi: int, over_lo: int, over_hi: int) -> None:
        """Roots of (lo, hi]; the counts are those above either end."""
        if len(out) >= count or over_lo == over_hi:
            return
        if hi - lo == 1:
            out.extend([(hi, shift, over_lo - over_hi)] * min(over_lo - over_hi, count - len(out)))
        elif over_lo - over_hi == 1:
            side = -1 if over_hi % 2 else 1  # the polynomial's sign above the root
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if sign(mid) == -side else (lo, mid)
            out.append((hi, shift, 1))
        else:
            mid = (lo + hi) // 2
            over = _above(poly, mid, shift)
            split(mid, hi, over, over_hi)
            split(lo, mid, over_lo, over)

    split(-1 << (shape + shift), 1 << (shape + shift), n, 0)
    return out


def null_basis(matrix: list[list[int]], root: int, shift: int, dim: int) -> list[list[int]]:
    """``dim`` orthonormal vectors, in fixed point of ``bits`` bits, next to the null space of
    ``matrix - root / 2**shift``: triangular factors once in long fixed point, then inverse iteration."""
    n = len(matrix)
    size = max(max(abs(v).bit_length() for row in matrix for v in row), 1)
    bits = size + GUARD_BITS
    one = 1 << bits
    # Entries over 2**size, as fixed point.
    a = np.array([[(v << (bits - size)) for v in row] for row in matrix], dtype=object)
    move = (root << (bits - size)) >> shift if bits - size >= 0 else 0
    for i in range(n):
        a[i, i] -= move
    order, factors = list(range(n)), []
    for k in range(n):
        pivot = max(range(k, n), key=lambda r: abs(a[r, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1  # an exact zero: the least step of the fixed point
        f = np.array([(int(v) << bits) // int(a[k, k]) for v in a[k + 1:, k]], dtype=object)
        factors.append((pivot, f))
        if len(f):
            a[k + 1:, k:] = a[k + 1:, k:] - ((f[:, None] * a[k, k:][None, :]) >> bits)

    def solve(v: list[int]) -> list[int]:
        v = list(v)
        for k, (pivot, f) in enumerate(factors):
            v[k], v[pivot] = v[pivot], v[k]
            for i, w in enumerate(f):
                v[k + 1 + i] -= (int(w) * v[k]) >> bits
        for k in range(n - 1, -1, -1):
            s = v[k] - (sum(int(a[k, j]) * v[j] for j in range(k + 1, n)) >> bits)
            v[k] = (s << bits) // int(a[k, k])
        return v

    def normal(v: list[int]) -> list[int]:
        top = max(max(abs(x).bit_length() for x in v) - bits, 0)
        v = [x >> top for x in v]
        length = math.isqrt(sum(x * x for x in v)) or 1
        return [(x << bits) // length for x in v]

    def apart(v: list[int], others: list[list[int]]) -> list[int]:
        for o in others:
            dot = sum(x * y for x, y in zip(v, o)) >> bits
            v = [x - ((dot * y) >> bits) for x, y in zip(v, o)]
        return v

    basis: list[list[int]] = []
    for b in range(dim):
        v = normal([one // (1 + (i * (2 * b + 3) + b * b) % (n + b + 1)) for i in range(n)])  # a fixed start
        for _ in range(4):
            v = normal(apart(normal(solve(apart(v, basis))), basis))
        basis.append(normal(apart(v, basis)))
    return [[x / one for x in v] for v in basis]
