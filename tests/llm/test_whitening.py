"""Whitening against exact rational arithmetic and numpy on small tables, with nulls, repeats, ties and huge entries."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fillwise.llm import op12_whitening as white


def leverrier(m):
    """Coefficients of det(x - m), lowest first, by the traces of powers, in rationals."""
    d = len(m)
    a, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        a = [[sum(m[i][t] * a[t][j] for t in range(d)) + (out[-1] * m[i][j]) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][i] for i in range(d)) / k)
    return [int(c) for c in out[::-1]]


def brute(rows, most=4):
    """{index of a usable row: (deviation, whitened)}, n, eigenvalue shares; numpy's eigenvectors."""
    usable = {i: tuple(int(np.floor(256 * float(c))) for c in v) for i, v in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted(set(usable.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    values, vectors = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
    order = [k for k in np.argsort(-values)[:most] if values[k] > 1e-9 * values.max()]
    out = {}
    for i, x in usable.items():
        y = [n * a - b for a, b in zip(x, s, strict=True)]
        out[i] = sum(v * v for v in y), (np.array(y, float) / n) @ vectors[:, order] / np.sqrt(values[order])
    return out, n, values[order] / values.sum()


def frame(spark, rows, kind="double"):
    # columns with names of the operator's own change nothing
    return spark.createDataFrame([(i, v, 7, "y") for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>, x int, n string").repartition(3)


def test_whitening_equals_numpy(spark):
    rng = random.Random(5)
    rows = [[rng.gauss(0, 1 + k) for k in range(7)] for _ in range(80)]
    rows += [rows[0], rows[3], None, [], [None] * 7, [float("nan")] * 7, [1.0] * 6 + [float("inf")], [1.0] * 5, [-0.0] * 7, [0.0] * 7]
    want, n, shares = brute([v if v and len(v) == 7 else None for v in rows])
    got = white.whitened(frame(spark, rows)).toPandas()
    assert set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    assert np.allclose(got.groupby("component")["explained"].first(), shares, rtol=1e-12)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert sorted(wide.index) == sorted(want)
    assert {i: int(v) for i, v in got.groupby("vec_id")["deviation"].first().items()} == {i: d for i, (d, _) in want.items()}
    own, theirs = wide.to_numpy(), np.array([want[i][1] for i in wide.index])
    assert np.allclose(own * np.sign((own * theirs).sum(axis=0)), theirs, atol=1e-9)


@pytest.mark.parametrize("rows", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_without_two_vectors_no_rows(spark, rows):
    assert white.whitened(frame(spark, rows)).count() == 0


def test_components_stop_at_the_rank_and_equal_roots_give_a_basis(spark):
    square = [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0]]
    got = white.whitened(frame(spark, square, "float")).toPandas()
    assert set(got["component"]) == {1, 2} and np.allclose(got["explained"], 0.5) and got["identity_error"].max() < 1e-12


def test_huge_entries_stay_exact(spark):
    rng = random.Random(9)
    rows = [[rng.uniform(-1, 1) * 10.0**k for k in (0, 6, 12)] for _ in range(40)]
    want, n, shares = brute(rows)
    got = white.whitened(frame(spark, rows)).toPandas()
    assert {i: int(v) for i, v in got.groupby("vec_id")["deviation"].first().items()} == {i: d for i, (d, _) in want.items()}
    assert got["identity_error"].max() < 1e-9 and set(got["component"]) == {1, 2, 3}


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**32), st.sampled_from([1, 3, 10**6, 10**14]))
def test_polynomial_modulo_primes_is_that_of_rationals(d, seed, size):
    rng = random.Random(seed)
    m = np.array([[rng.randint(-size, size) if rng.random() < 0.7 else 0 for _ in range(d)] for _ in range(d)], dtype=object)
    m = m + m.T
    want = leverrier(m.tolist())
    for p in (2**31 - 1, 1_000_003, 101):
        assert white.polynomial_mod((m % p).astype(np.int64), p).tolist() == [c % p for c in want]


def test_polynomial_is_put_together_from_primes(spark):
    rng = random.Random(2)
    m = np.array([[rng.randint(-(10**20), 10**20) for _ in range(6)] for _ in range(6)], dtype=object)
    m = m + m.T
    assert white.characteristic_polynomial(spark, m) == leverrier(m.tolist())


def test_roots_are_isolated_with_their_multiplicity():
    roots = [Fraction(1), Fraction(9), Fraction(9), Fraction(9) + Fraction(1, 2**90), Fraction(40), Fraction(0)]
    poly = [Fraction(1)]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - (r * poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    scale = 2**90
    poly = [int(c * scale) for c in poly]
    found, bits = white.largest_roots(poly, 4)
    assert bits > 90
    for (low, shift), want in zip(found, sorted(roots, reverse=True), strict=False):
        assert Fraction(low, 2**shift) < want <= Fraction(low + 1, 2**shift)
    assert len(found) == 5


def test_close_eigenvalues_get_their_own_components(spark):
    """Two eigenvalues of the scatter that differ by 2 in 4 * 10^16: too close for doubles."""
    big = 2 * 10**16
    m = np.array([[big + 1, 1, 0], [1, big + 1, 0], [0, 0, 5]], dtype=object)
    model = white.components(spark, 10, [0, 0, 0], m, 3)
    half = np.sqrt(0.5)
    assert np.allclose(np.abs(model.vectors), [[half, half, 0], [half, half, 0], [0, 0, 1]], atol=1e-15)
    assert model.vectors[0][0] * model.vectors[0][1] > 0 > model.vectors[1][0] * model.vectors[1][1]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 2**20, 2**40, 2**62]))
def test_products_are_exact(seed, size):
    x = np.random.default_rng(seed).integers(-size, size, (9, 3))
    want = [[sum(int(r[i]) * int(r[k]) for r in x) for k in range(3)] for i in range(3)]
    assert white.gram(x).tolist() == want


def test_primes():
    assert [n for n in range(60) if white.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert white.primes_beyond(2**62)[0] == 2**31 - 1 and len(white.primes_beyond(2**62)) == 3
