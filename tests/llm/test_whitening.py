"""Operator 11 against dense eigenproblems: single updates, combined spectra, whole tables with copies and odd rows."""

import numpy as np
import pytest

from isohyet.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], ROWS.replace("float", kind))


def rebuilt(values, basis):
    return (basis * values) @ basis.T


@pytest.mark.parametrize("seed", range(40))
def test_rank_one_updates(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 30))
    basis, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = np.sort(rng.choice([0.0, 1.0, 1.0 + 1e-9, 2.0, 50.0, 1e4], d) * rng.choice([1.0, rng.random()], d))
    v = rng.normal(size=d) * rng.choice([1e-8, 1.0, 1e3])
    if seed % 3 == 0:
        v = basis[:, 0] * 2.0
    if seed % 5 == 0:
        v = basis[:, : max(1, d // 2)].sum(1)
    got_values, got_basis = whitening.rank_one(values, basis, 0.7, v)
    want = rebuilt(values, basis) + 0.7 * np.outer(v, v)
    scale = np.abs(want).max() + 1e-300
    assert np.allclose(rebuilt(got_values, got_basis) / scale, want / scale, atol=1e-12)
    assert np.allclose(got_basis.T @ got_basis, np.eye(d), atol=1e-12)
    assert (np.diff(got_values) >= 0).all()
    assert np.allclose(got_values, np.linalg.eigvalsh(want), atol=1e-12 * scale * d)


def test_roots_next_to_their_poles():
    poles = np.array([0.0, 1e-12, 1.0, 1.0 + 1e-9, 1e6])
    weights = np.array([1e-3, 1e-10, 1e-20, 5.0, 1e-6])
    origin, x = whitening.secular_roots(poles, weights)
    for i in range(len(poles)):
        f = lambda t: 1 + (weights / ((poles - poles[origin[i]]) - t)).sum()  # noqa: B023, E731
        assert f(x[i] * (1 - 1e-9) if x[i] > 0 else x[i] * (1 + 1e-9)) < 0 < f(x[i] * (1 + 1e-9) if x[i] > 0 else x[i] * (1 - 1e-9))


@pytest.mark.parametrize("cuts", [[], [10], [1, 2, 3, 40], [5, 60, 61, 100]])
def test_combined_spectra(cuts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12)) + 5
    x[:, 11] = x[:, 0]
    total = whitening.nothing(12)
    for part in np.split(x, cuts):
        s = whitening.nothing(12)
        for row in part:
            s = whitening.add(s, row)
        total = whitening.combine(total, s)
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    assert total.n == 150 and np.allclose(total.mean, x.mean(0))
    assert np.allclose(rebuilt(total.values, total.basis), scatter, rtol=0, atol=1e-10 * np.abs(scatter).max())


def brute(vectors, k=16):
    """x, exact moments, eigenvalues and components of the fit list."""
    d = max(map(len, vectors))
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) + (1_000_000,) * (d - len(v)) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(v[i] for v in fit) for i in range(d)]
    off = np.array([[(n * v[i] - sums[i]) / n for i in range(d)] for v in fit])
    values, turn = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:k]
    return x, n, sums, values[order], turn[:, order], values.sum()


def check(rows, vectors, k=16):
    x, n, sums, values, turn, trace = brute([v for _, v in vectors], k)
    k = len(values)
    by_row = {}
    for r in rows:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert len(rows) == k * len(vectors)
    signs = np.zeros(k)
    for (i, _), v in zip(vectors, x, strict=True):
        exact = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        mine = sorted(by_row[i, exact], key=lambda r: r["component"])[:k] if len(by_row[i, exact]) == k else None
        off = np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)])
        want = off @ turn / np.sqrt(values)
        if mine is None:
            continue
        got = np.array([r["whitened"] for r in mine])
        assert [r["component"] for r in mine] == list(range(1, k + 1)) and {r["n"] for r in mine} == {n}
        if not signs.any() and np.abs(want).min() > 1e-6:
            signs = np.sign(got * want)
        if signs.any():
            assert np.allclose(got * signs, want, rtol=1e-7, atol=1e-7)
        assert np.allclose(np.abs(got), np.abs(want), rtol=1e-7, atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], values / trace, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine)
    assert signs.any()


@pytest.mark.parametrize("d,n", [(20, 300), (64, 40), (3, 50)])
def test_whitened_rows(spark, d, n):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(n, d)) * np.geomspace(3, 0.3, d)).astype(np.float32).tolist()
    good = list(enumerate(x)) + [(1000 + i, x[0]) for i in range(100)] + [(None, x[1])]
    odd = [(5000, None), (5001, [None] * d), (5002, [float("nan")] * d), (5003, [float("inf"), *x[0][1:]]), (5004, [-float("inf"), *x[0][1:]])]
    rows = whitening.whiten(frame(spark, good + odd).repartition(7)).collect()
    check(rows, good, min(16, d, n - 1))


def test_short_vectors_and_large_entries(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).tolist()
    good = list(enumerate(x)) + [(100, x[0][:3]), (101, []), (102, [3.0e4, *x[1][1:]])]
    rows = whitening.whiten(frame(spark, good, "double")).collect()
    big = whitening.whiten(frame(spark, [*good, (103, [1e300] * 5), (104, [-1e300] * 5)], "double"))
    assert big.filter("deviation IS NULL").select("vec_id").distinct().count() >= 2
    x, n, sums, values, _, trace = brute([v for _, v in good])
    assert {r["n"] for r in rows} == {n} and len(rows) == 5 * len(good)
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(good, x, strict=True)}
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: v if v < 1 << 63 else None for i, v in exact.items()}
    assert np.isclose(max(r["explained"] for r in rows), values[0] / trace)


def test_tables_without_a_direction(spark):
    one = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.filter("false")).count() == 0
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 10
