import numpy as np
import pytest

from kinweave.operators import curves

POINTS = "query string, users_n long, a double, b double"


def curve_of(spark, data, dense=curves.DENSE):
    return curves.pchip_curve(spark.createDataFrame(data, POINTS), dense)


def pchip(x, y, at):
    """Plain-loop monotone cubic interpolation to compare with."""
    n = len(x)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(n)
    if n == 2:
        d[:] = s[0]
    else:
        for k in range(1, n - 1):
            if s[k - 1] * s[k] > 0:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (w1 + w2) / (w1 / s[k - 1] + w2 / s[k])
        for end, h0, h1, s0, s1 in ((0, h[0], h[1], s[0], s[1]), (-1, h[-1], h[-2], s[-1], s[-2])):
            v = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            if np.sign(v) != np.sign(s0):
                v = 0.0
            elif np.sign(s0) != np.sign(s1) and abs(v) > 3 * abs(s0):
                v = 3 * s0
            d[end] = v
    out = []
    for v in at:
        k = min(max(int(np.searchsorted(x, v, side="right")) - 1, 0), n - 2)
        u = (v - x[k]) / h[k]
        out.append(
            (1 + 2 * u) * (1 - u) ** 2 * y[k]
            + u * (1 - u) ** 2 * h[k] * d[k]
            + u**2 * (3 - 2 * u) * y[k + 1]
            + u**2 * (u - 1) * h[k] * d[k + 1]
        )
    return np.array(out)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    data, want = [], {}
    for q, n in (("q2", 2), ("q3", 3), ("q4", 4), ("q7", 7)):
        x = np.sort(rng.choice(np.arange(10, 100_000), n, replace=False)).astype(float)
        a, b = rng.normal(5, 3, n), np.cumsum(rng.random(n))
        if n == 7:
            a[3] = a[2]
        data += [(q, int(u), float(v), float(w)) for u, v, w in zip(x, a, b)]
        grid = np.logspace(np.log10(x.min()), np.log10(x.max()), 200)
        want[q] = (grid, pchip(x, a, grid), pchip(x, b, grid))
    got = curve_of(spark, data, 200).orderBy("query", "i").toPandas()
    for q, (grid, a, b) in want.items():
        part = got[got["query"] == q]
        assert list(part["i"]) == list(range(200))
        np.testing.assert_allclose(part["x"], grid, rtol=1e-9)
        np.testing.assert_allclose(part["a"], a, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(part["b"], b, rtol=1e-7, atol=1e-9)


def test_one_size_has_no_curve(spark):
    assert curve_of(spark, [("q", 10, 1.0, 2.0)]).count() == 0


CROSSING = [("q", 10, 1.0, 2.0), ("q", 100, 3.0, 2.0), ("flat", 10, 1.0, 1.0), ("flat", 100, 1.0, 1.0)]


def test_crossovers(spark):
    curve = curve_of(spark, CROSSING)
    got = {r.query: r for r in curves.crossovers(curve, "a", "b").collect()}
    one = got["q"]
    assert (one.n_crossings, one.initial, one.final) == (1, "a", "b")
    assert one.critical == pytest.approx(55.0)
    # Equal curves touch at every point of the grid.
    assert (got["flat"].n_crossings, got["flat"].initial) == (curves.DENSE, "equal")
    assert got["flat"].critical == pytest.approx(10.0)


def test_max_gap_takes_the_first_of_equal_gaps(spark):
    got = {r.query: r for r in curves.max_gap(curve_of(spark, CROSSING), "a", "b").collect()}
    assert (got["q"].max_rel_pct, got["q"].winner_at_max) == (pytest.approx(50.0), "a")
    assert got["q"].x_at_max == pytest.approx(10.0)
    assert (got["flat"].max_rel_pct, got["flat"].x_at_max) == (0.0, pytest.approx(10.0))


def test_global_threshold(spark):
    df = spark.createDataFrame([("x", 10.9), ("y", 20.0), ("z", None)], "query string, critical double")
    assert curves.global_threshold(df).first()[0] == 15
    assert curves.global_threshold(df.where("critical is null")).first()[0] is None
