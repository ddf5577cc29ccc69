"""Hard negatives against plain Python, and the residue number system against integers."""

import math
import random

import numpy as np
import pytest

from revspark.llm import hard_negatives as hn
from revspark.llm.rns import primes, products, residues

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, rank long"


def brute(rows, every=10, n_pos=5, n_neg=10):
    own = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, (i, label, e) in enumerate(own):
        if i is None or i % every:
            continue
        scores = [(sum(a * b for a, b in zip(e, f, strict=False)), j, other == label) for m, (j, other, f) in enumerate(own) if m != k]
        for p, pid, _ in sorted((s for s in scores if s[2]), key=order)[:n_pos]:
            near = sorted((s for s in scores if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:n_neg]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j, _) in enumerate(near)]
    return out


def got(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return [tuple(r)[:6] for r in hn.hard_negatives(table, every=10, **kw).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def vectors(rng, n, labels, values):
    return [(k - 5, [rng.choice(values) for _ in range(6)], rng.choice(labels)) for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_many_ties(spark, seed):
    rng = random.Random(seed)
    rows = vectors(rng, 120, [0, 0, 0, 1, 2], [0.0, 0.25, 0.5, -0.25])
    want = ordered(brute(rows))
    assert ordered(got(spark, rows)) == want and len(want) > 100
    assert ordered(got(spark, rows, tile=3, share=20)) == want


def test_odd_rows(spark):
    """Null ids, labels, vectors and components, infinite ones, repeated rows and ids, empty and short vectors."""
    rng = random.Random(9)
    rows = vectors(rng, 60, [1, 2], [0.1, 0.7, 0.33])
    rows += [(None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (100, None, 1), (110, [0.5] * 6, None), (120, [0.5, None], 1),
             (130, [math.inf] * 6, 1), (140, [math.nan] * 6, 2), (150, [], 1), (160, [0.9, 0.8], 1), (170, [0.3] * 9, 2)]
    rows += [(0, [0.6] * 6, 1)] * 4 + [rows[5]] * 3
    assert ordered(got(spark, rows)) == ordered(brute(rows))


def test_one_vector_holds_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = vectors(rng, 80, [1, 2, 3], [0.2, 0.4, 0.6]) + [(1000 + k, [0.4] * 6, 4) for k in range(40)]
    assert ordered(got(spark, rows)) == ordered(brute(rows))


def test_nothing(spark):
    assert got(spark, []) == [] and got(spark, [(10, [1.0], 1)]) == []


def test_large_components(spark):
    rows = [(k, [float(10 ** (k % 5)), -float(k), 1000.5], k % 2) for k in range(40)]
    assert ordered(got(spark, rows)) == ordered(brute(rows))
    with pytest.raises(ArithmeticError):
        got(spark, [(10, [1e30], 1), (20, [1e30], 1)])


def test_ranks_of_scores_too_large_to_shift():
    score = np.array([[1 << 57, -(1 << 57), 3, 3]])
    assert np.argsort(-hn._ranked(score))[0].tolist() == [0, 2, 3, 1]


@pytest.mark.parametrize("size", [3, 1 << 10, 1 << 24])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (5, 300)), rng.integers(-size, size + 1, (7, 300))
    moduli = primes(300 * size * size)
    assert math.prod(moduli) > 600 * size * size and len(set(moduli)) == len(moduli)
    assert (products(residues(a.astype(float), moduli), residues(b.astype(float), moduli), moduli) == a @ b.T).all()
