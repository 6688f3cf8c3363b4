import math

import numpy as np
import pytest

from emberline.llm import feast_whitening as W


def with_spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.logspace(0, -12, 40), np.ones(30), np.r_[np.ones(3), np.full(30, .5)], np.r_[3., 2, 1, np.zeros(20)],
                                    np.r_[1 + 1e-8 * np.arange(20), np.linspace(.1, .3, 30)], 1 + .01 * np.linspace(0, 1, 64), np.array([2.]),
                                    np.array([2., 1.]), np.r_[1e6, np.linspace(0.01, 1, 60)]])
def test_components_against_a_dense_decomposition(values):
    a = with_spectrum(values)
    e, v = W.components(a)
    want = np.sort(values)[::-1]
    k = min(8, int((want > 1e-10 * want[0]).sum())) if want[-1] == 0 else min(8, len(want))
    assert len(e) == k and np.abs(e - want[:k]).max() < 1e-13 * want[0]
    assert np.abs(a @ v - v * e).max() < 1e-13 * want[0] * len(a) and np.abs(v.T @ v - np.eye(k)).max() < 1e-13


def test_inertia_counts_and_intervals():
    values = np.array([0.5, 1.0, 1.0, 2.0, 7.0, 40.0, 41.0])
    a = with_spectrum(values)
    form = W.tridiagonal(a)
    for shift in (-1, 0.2, 0.7, 1.5, 3, 20, 40.5, 50):
        assert W.above(form, shift)[0] == (values > shift).sum()
    found = W.intervals(form, 41.5, 3)
    assert sum(n for *_, n in found) >= 3 and all(((values > lo) & (values < hi)).sum() == n for lo, hi, n in found)
    for lo, hi, n in found:
        e, v = W.feast(a, lo, hi, n, 41.0)
        assert np.allclose(np.sort(e), np.sort(values[(values > lo) & (values < hi)]), atol=1e-12) and v.shape == (7, n)
    assert W.components(np.zeros((4, 4)))[0].size == 0
    with pytest.raises(ArithmeticError):
        W.feast(a, 3.0, 20.0, 2, 41.0)


SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, n long"


def brute(rows, wanted=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in r] for r in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    centred = np.array([[float((n * a - b)) / n for a, b in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred @ v[:, ::-1][:, :wanted] / np.sqrt(e[::-1][:wanted]), e[::-1][:wanted] / e.sum()


def test_whiten_against_brute_force_with_edge_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in r] for r in rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) + 0.3]
    rows = [(i, r, 1, "a", "b", 7) for i, r in enumerate(good)]
    rows[20:20] = [(900, None, 1, "a", "b", 7), (901, [None] + good[0][1:], 1, "a", "b", 7), (902, [float("nan")] + good[0][1:], 1, "", "", 1),
                   (903, [float("-inf")] + good[0][1:], 1, "", "", 1), (904, [], 1, "", "", 1), (905, good[0][:5], 1, "", "", 1)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    deviation, white, explained = brute(good)
    assert len(found) == 300 * 8 and {r["n"] for r in found} == {300}
    got = np.zeros((300, 8))
    for r in found:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] - explained[r["component"] - 1]) < 1e-12 and r["identity_error"] < 1e-12
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * sign).max() < 1e-9


def test_degenerate_tables(spark):
    def of(rows):
        return W.whiten(spark.createDataFrame([(i, r, 1, "", "", 1) for i, r in rows], SCHEMA)).collect()

    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [0.5, 0.25])]) == [] and of([(1, [])]) == []
    assert of([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []
    # Two points span one component; ids may be null or repeated.
    line = of([(None, [0.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])])
    assert [r["component"] for r in line] == [1, 1, 1] and sorted(str(r["vec_id"]) for r in line) == ["7", "7", "None"]
    assert {r["n"] for r in line} == {3} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    # Entries of any size, and sums beyond a long.
    huge = of([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])])
    assert all(math.isfinite(r["whitened"]) for r in huge) and any(r["deviation"] is None for r in huge)


def test_whole_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 20, 1 << 30, 1 << 39):
        y = rng.integers(-most, most, (5000 if most < 1 << 30 else 50, 5))
        assert (W._whole_products(y) == y.astype(object).T.dot(y.astype(object))).all()
