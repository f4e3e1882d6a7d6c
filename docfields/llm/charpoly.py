"""Exact characteristic polynomials of integer matrices, their real roots, and null vectors, to a stated precision.

Everything here works on one symmetric positive semi-definite integer matrix, whose size is the dimension of the vectors and
never the number of rows.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import numpy as np


def is_prime(n: int) -> bool:
    """Exact below 3.2e9, which covers every 31-bit number: strong tests to the bases 2, 3, 5 and 7."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all(pow(a, odd, n) in (1, n - 1) or any(pow(a, odd << r, n) == n - 1 for r in range(1, twos)) for a in (2, 3, 5, 7))


def coefficient_bits(trace: int, d: int) -> int:
    """Bits that hold every coefficient of a positive semi-definite matrix's polynomial: the k-th is at most
    binomial(d, k) * (trace / d)^k by the inequality of the elementary symmetric means."""
    if trace <= 0:
        return 1
    per = math.log2(trace) - math.log2(d)
    return max(0, math.ceil(max(math.lgamma(d + 1) / math.log(2) - (math.lgamma(k + 1) + math.lgamma(d - k + 1)) / math.log(2) + k * per for k in range(d + 1)))) + 2


def primes_for(trace: int, d: int) -> list[int]:
    """31-bit primes, from the largest down, whose product exceeds every coefficient."""
    out, need, n = [], coefficient_bits(trace, d), 2**31 - 1
    while need > 0:
        if is_prime(n):
            out.append(n)
            need -= 30
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x*I - matrix) modulo a prime below 2**31: reduction to Hessenberg form by
    similarity, then the recurrence over its leading minors. All products stay below 2**62."""
    a = np.array([[int(v) % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            a[[k + 1, at]] = a[[at, k + 1]]
            a[:, [k + 1, at]] = a[:, [at, k + 1]]
        factors = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - factors[:, None] * a[k + 1] % p) % p
        # the inverse of the row operation, on columns: terms are below 2**31, so their sum stays in range
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * factors % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        line = np.zeros(d + 1, np.int64)
        line[1:] = minors[k - 1, :-1]
        line = (line - a[k - 1, k - 1] * minors[k - 1]) % p
        factor, weights = 1, []
        for i in range(k - 2, -1, -1):
            factor = factor * int(a[i + 1, i]) % p
            weights.append(factor * int(a[i, k - 1]) % p)
        if weights:
            line = (line - (np.array(weights, np.int64)[:, None] * minors[k - 2::-1] % p).sum(0)) % p
        minors[k] = line
    return minors[d]


def combined(residues: list[np.ndarray], primes: list[int]) -> list[int]:
    """The polynomial's integer coefficients from its residues. Signs alternate with the power, as all roots are at least 0."""
    product = math.prod(primes)
    parts = [(product // p) * pow(product // p % p, -1, p) for p in primes]
    d = len(residues[0]) - 1
    out = []
    for i in range(d + 1):
        sign = -1 if (d - i) % 2 else 1
        out.append(sign * (sum(sign * int(r[i]) * part for r, part in zip(residues, parts)) % product))
    return out


def _above(poly: list[int], at: int, bits: int) -> int:
    """How many roots exceed at / 2**bits. For a polynomial with real roots only, Descartes' count on the shifted polynomial
    is exact, multiplicities included."""
    d = len(poly) - 1
    shifted = [c << (bits * (d - i)) for i, c in enumerate(poly)]
    for k in range(d):
        for i in range(d - 1, k - 1, -1):
            shifted[i] += at * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * at + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int, precision: int = 110) -> list[tuple[Decimal, int]]:
    """(root, cluster) of the ``most`` largest positive roots, falling; multiple roots come as often as they count.

    Roots are first isolated by exact counts on halved intervals. An interval with one simple root goes on by signs alone. The
    width at the end is 2**-precision of the largest root; roots that no interval of that width tells apart share a cluster.
    """
    d = len(poly) - 1
    zeros = next(i for i, c in enumerate(poly) if c)
    most = min(most, d - zeros)
    if most <= 0:
        return []
    poly = poly[zeros:]
    high = 1
    while _above(poly, high, 0):
        high *= 2
    # everything is held on the grid 1 / 2**bits
    bits = max(0, precision - high.bit_length() + 2)
    top = high << bits
    found: list[tuple[int, int, int]] = []  # low, high, how many roots in (low, high]
    todo = [(0, top, len(poly) - 1, 0)]  # the roots in (low, high], and how many lie above high
    while todo:
        low, up, inside, above = todo.pop()
        if inside == 0 or above >= most:
            continue
        if inside == 1 and up - low < top:
            found.append((low, up, 1))
            continue
        if up - low <= 1:
            found.append((low, up, inside))
            continue
        middle = (low + up) // 2
        upper = _above(poly, middle, bits) - above
        todo += [(low, middle, inside - upper, above + upper), (middle, up, upper, above)]
    out: list[tuple[Decimal, int]] = []
    with localcontext() as context:
        context.prec = precision
        for cluster, (low, up, count) in enumerate(sorted(found, key=lambda f: -f[1])):
            if count == 1:
                at_up = _sign(poly, up, bits)
                while up - low > 1 and at_up:
                    middle = (low + up) // 2
                    s = _sign(poly, middle, bits)
                    low, up, at_up = (middle, up, at_up) if s and s != at_up else (low, middle, s)
            root = Decimal(2 * up - (1 if _sign(poly, up, bits) else 0)) / Decimal(2) / (Decimal(2) ** bits)
            out += [(root, cluster)] * count
    return out[:most]


def _solve_factors(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU of a square Decimal matrix with row exchanges; a pivot of 0 is replaced by a tiny one, as inverse iteration wants."""
    a, order, d = a.copy(), list(range(len(a))), len(a)
    tiny = max(abs(x) for x in a.ravel()) * Decimal(10) ** -60 or Decimal(10) ** -60
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(a[i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            order[k], order[at] = order[at], order[k]
        if a[k, k] == 0:
            a[k, k] = tiny
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        if k + 1 < d:
            a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - np.multiply.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x, d = b[order].copy(), len(b)
    for i in range(1, d):
        x[i] -= (lu[i, :i] * x[:i]).sum()
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            x[i] -= (lu[i, i + 1:] * x[i + 1:]).sum()
        x[i] /= lu[i, i]
    return x


def null_vectors(matrix: np.ndarray, roots: list[tuple[Decimal, int]], digits: int = 70) -> list[np.ndarray]:
    """A unit vector for every root, by inverse iteration on matrix - root * I in ``digits`` decimal digits.

    Vectors are kept orthogonal to all earlier ones, which also gives a multiple root as many as it counts. The component of
    largest size (the first on ties) is positive.
    """
    d, out = len(matrix), []
    with localcontext() as context:
        context.prec, context.rounding = digits, ROUND_HALF_EVEN
        exact = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        factors: dict[Decimal, tuple] = {}

        def unit(x: np.ndarray) -> np.ndarray:
            return x / (x * x).sum().sqrt()

        def cleared(x: np.ndarray) -> np.ndarray:
            for v in out:
                x = x - v * (v * x).sum()
            return x

        for nth, (root, _) in enumerate(roots):
            if root not in factors:
                factors[root] = _solve_factors(exact - root * np.array([[Decimal(int(i == j)) for j in range(d)] for i in range(d)], object))
            lu, order = factors[root]
            # a fixed start without symmetry; other vectors of a cluster start elsewhere
            x = unit(cleared(np.array([Decimal(1) + Decimal((i * i * 7 + i * 13 + nth * 31 * (i + 1)) % 101) / 101 for i in range(d)], object)))
            for _ in range(80):
                y = unit(cleared(_solved(lu, order, x)))
                step = min(max(abs(v) for v in y - x), max(abs(v) for v in y + x))
                x = y
                if step < Decimal(10) ** -24:
                    break
            largest = max(range(d), key=lambda i: (round(abs(x[i]), 20), -i))
            out.append(-x if x[largest] < 0 else x)
    return out
