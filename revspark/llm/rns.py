"""Exact integer inner products from float32 matrix products in a residue number system.

A score is computed modulo several primes, each small enough that float32 sums of products of residues stay below 2^24 and are
therefore exact. Chinese remaindering with signed digits gives the score itself: it is unique as long as the product of the primes
exceeds twice the largest possible score.
"""

from __future__ import annotations

import numpy as np

#: 64 products of signed residues of a prime under this stay below 2^24.
LARGEST = 1 << 10
_EXACT = 1 << 24


def primes(bound: int) -> list[int]:
    """The largest primes under LARGEST, as many as are needed to tell apart all integers from -bound to bound."""
    found: list[int] = []
    product, n = 1, LARGEST
    while product <= 2 * bound + 1:
        n -= 1
        while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
            n -= 1
        found.append(n)
        product *= n
    return found


def residues(values: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """Signed residues, as float32, of a matrix of whole numbers held as doubles (fmod of doubles is exact)."""
    out = []
    for p in moduli:
        r = np.fmod(values, p)
        r[r > p // 2] -= p
        r[r < -(p // 2)] += p
        out.append(r.astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products of the rows behind two lists of residue matrices; missing components are zero."""
    depth = min(a[0].shape[1], b[0].shape[1])
    score, known = np.zeros((len(a[0]), len(b[0])), dtype=np.int64), 1
    for x, y, p in zip(a, b, moduli, strict=True):
        step = _EXACT // (p // 2) ** 2
        total = np.zeros_like(score)
        for k in range(0, depth, step):
            total += (x[:, k:min(k + step, depth)] @ y[:, k:min(k + step, depth)].T).astype(np.int64)
        digit = (total - score) % p * pow(known, -1, p) % p
        digit[digit > p // 2] -= p
        score += digit * known
        known *= p
    return score
