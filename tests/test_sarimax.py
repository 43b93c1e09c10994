"""Seasonal ARIMA against the likelihood written out as a normal density."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import sarimax
from tabloom.operators.sarimax import Filter, Search, Spec, fold, likelihood, polynomials


def covariance(ar, ma, n):
    """Autocovariances of a unit-shock ARMA process from its moving average, far enough to be exact."""
    psi = np.zeros(1500)
    psi[0] = 1
    for j in range(1, len(psi)):
        psi[j] = (ma[j - 1] if j <= len(ma) else 0) + sum(a * psi[j - i] for i, a in enumerate(ar, 1) if i <= j)
    g = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])
    return g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def direct(spec, free, rows):
    """Log-likelihood, variance and coefficients by generalized least squares over the whole covariance matrix."""
    n = len(rows)
    v = covariance(*polynomials(spec, free), n)
    inv, (_, log) = np.linalg.inv(v), np.linalg.slogdet(v)
    y, x = rows[:, 0], rows[:, 1:]
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y) if x.shape[1] else np.zeros(0)
    e = y - x @ beta
    s = e @ inv @ e / n
    return -0.5 * (n * (math.log(2 * math.pi * s) + 1) + log), s, beta


SPECS = [Spec((1, 0, 1)), Spec((2, 0, 0), exog=("x",)), Spec((0, 0, 2)), Spec((1, 0, 1), (1, 0, 1, 4)), Spec((0, 1, 1), (0, 1, 1, 4)), Spec((1, 0, 0), (0, 0, 1, 3), ("x",))]


@pytest.mark.parametrize("spec", SPECS, ids=str)
@pytest.mark.parametrize("cuts", [(), (1,), (13, 40, 41)])
def test_likelihood_equals_the_density(spec, cuts):
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.normal(size=60).cumsum() * 0.3, *[np.ones(60)] * spec.constant, *[rng.normal(size=60) for _ in spec.exog]])
    points = rng.normal(size=(3, sum(spec.sizes))) * 0.5
    bounds = [0, *cuts, 60]
    state = cross = log = None
    for a, b in zip(bounds, bounds[1:]):
        one = Filter(spec, points)
        part = one.summary(rows[a:b], a)
        if state is None:
            state, cross, log = np.zeros((3, one.m, rows.shape[1])), np.zeros_like(part["cross"]), np.zeros(3)
        state, cross = fold(state, cross, part)
        log = log + part["log"]
    for i, p in enumerate(points):
        ll, s, beta = likelihood(cross[i], log[i], 60)
        want = direct(spec, p, rows)
        assert ll == pytest.approx(want[0], abs=1e-8) and s == pytest.approx(want[1], rel=1e-9) and np.allclose(beta, want[2], atol=1e-9)


def test_polynomials_and_differences():
    spec = Spec((1, 1, 1), (1, 1, 1, 4))
    ar, ma, sar, sma = sarimax.coefficients(spec, np.array([0.3, -0.2, 0.5, 0.1]))
    far_ar, far_ma = polynomials(spec, np.array([0.3, -0.2, 0.5, 0.1]))
    assert np.allclose(far_ar, [ar[0], 0, 0, sar[0], -ar[0] * sar[0]]) and np.allclose(far_ma, [ma[0], 0, 0, sma[0], ma[0] * sma[0]])
    assert spec.differences.tolist() == [1, -1, 0, 0, -1, 1]
    assert not Spec((0, 1, 0)).constant and Spec((1, 0, 0)).constant


def test_trials_stay_stationary():
    rng = np.random.default_rng(1)
    for _ in range(200):
        c = sarimax.stationary(rng.normal(size=4) * 2)
        assert np.abs(np.roots(np.append(1.0, -c))).max() < 1 + 1e-9


def test_search_finds_the_bottom():
    search = Search(3)
    goal = np.array([0.4, -1.0, 0.2])
    f = lambda p: float((p - goal) @ np.diag([1.0, 30.0, 5.0]) @ (p - goal) + 0.1 * np.sum((p - goal) ** 4))
    while not search.done:
        search.take(np.array([f(p) for p in search.points()]))
        search = Search(3, search.kept())
    assert np.allclose(search.at, goal, atol=1e-4) and search.points().shape == (1, 3)


def series(rng, n, phi, theta, beta):
    x, e = rng.normal(size=n), rng.normal(size=n)
    u = np.zeros(n)
    for t in range(n):
        u[t] = phi * (u[t - 1] if t else 0) + e[t] + theta * (e[t - 1] if t else 0)
    return 5 + beta * x + u, x


@pytest.fixture(scope="module")
def two(spark):
    rng, rows = np.random.default_rng(5), []
    for k, (phi, theta, beta) in enumerate([(0.7, 0.3, 2.0), (-0.4, 0.0, -1.0)]):
        y, x = series(rng, 120, phi, theta, beta)
        rows += [("ab"[k], t, float(a), float(b)) for t, (a, b) in enumerate(zip(y, x))]
    rows += [("a", 900, None, 1.0), (None, 1, 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, t long, y double, x double").repartition(3).persist()


def test_fit_and_forecast(spark, two):
    spec = Spec((1, 0, 1), exog=("x",))
    fits = sarimax.fit(two, ["k"], "t", "y", spec, size=70)  # two chunks a series
    got = {r.k: r for r in fits.collect()}
    assert set(got) == {"a", "b"}
    for k, phi, beta in (("a", 0.7, 2.0), ("b", -0.4, -1.0)):
        r = got[k]
        rows = np.array([(q.y, 1.0, q.x) for q in two.where((F.col("k") == k) & F.col("y").isNotNull()).orderBy("t").collect()])
        ll, s, _ = direct(spec, np.array(r.free), rows)
        assert r.log_likelihood == pytest.approx(ll, abs=1e-6) and r.sigma2 == pytest.approx(s, rel=1e-8)
        assert r.aic == pytest.approx(2 * 5 - 2 * ll, abs=1e-6) and r.n == 120
        # no point around it is better
        for move in np.eye(2) * 0.01:
            assert max(direct(spec, np.array(r.free) + d, rows)[0] for d in (move, -move)) <= ll + 1e-5
        assert r.exog[0] == pytest.approx(beta, abs=0.4) and r.ar[0] + r.ma[0] == pytest.approx(phi + (0.3 if k == "a" else 0), abs=0.5)
    one = {r.k: r.log_likelihood for r in sarimax.fit(two, ["k"], "t", "y", spec).collect()}
    assert all(one[k] == pytest.approx(got[k].log_likelihood, abs=1e-5) for k in one)
    future = spark.createDataFrame([(k, h, float(h)) for k in "ab" for h in (1, 2, 3, 5)], "k string, step int, x double")
    ahead = {(r.k, r.step): r for r in sarimax.forecast(two, ["k"], "t", "y", fits, spec, 5, future).collect()}
    assert set(ahead) == {(k, h) for k in "ab" for h in (1, 2, 3)}
    for k in "ab":
        r = got[k]
        rows = [(q.y, q.x) for q in two.where((F.col("k") == k) & F.col("y").isNotNull()).orderBy("t").collect()]
        u = [y - r.constant - r.exog[0] * x for y, x in rows]
        e = 0.0
        for t in range(1, len(u)):
            e = u[t] - r.ar[0] * u[t - 1] - r.ma[0] * e
        first = r.constant + r.exog[0] * 1.0 + r.ar[0] * u[-1] + r.ma[0] * e
        assert ahead[k, 1].mean == pytest.approx(first, abs=1e-6)
        assert ahead[k, 1].upper - ahead[k, 1].mean == pytest.approx(1.959964 * math.sqrt(r.sigma2), rel=1e-4)
        assert ahead[k, 3].upper - ahead[k, 3].lower > ahead[k, 1].upper - ahead[k, 1].lower


def test_seasonal_forecast_repeats_a_season(spark):
    rng = np.random.default_rng(9)
    season = np.array([0.0, 5.0, -3.0, 8.0])
    rows = [(1, t, float(0.5 * t + season[t % 4] + rng.normal() * 0.05)) for t in range(80)]
    df = spark.createDataFrame(rows, "k int, t int, y double")
    spec = Spec((0, 1, 1), (0, 1, 1, 4))
    fits = sarimax.fit(df, ["k"], "t", "y", spec)
    got = sorted(sarimax.forecast(df, ["k"], "t", "y", fits, spec, 8).collect(), key=lambda r: r.step)
    assert fits.first().order == "0,1,1;0,1,1,4" and fits.first().n == 75
    for r in got:
        t = 79 + r.step
        assert abs(r.mean - (0.5 * t + season[t % 4])) < 0.4 and r.lower < r.mean < r.upper


def test_best_of_several_orders_and_short_series(spark, two):
    specs = [Spec((0, 0, 0)), Spec((1, 0, 0), exog=("x",))]
    fits = sarimax.fit(two, ["k"], "t", "y", specs)
    assert {r.k: r.model for r in fits.collect()} == {"a": 1, "b": 1}
    white = sarimax.fit(two, ["k"], "t", "y", specs[0]).collect()
    for r in white:
        y = np.array([q.y for q in two.where((F.col("k") == r.k) & F.col("y").isNotNull()).collect()])
        assert r.constant == pytest.approx(y.mean()) and r.sigma2 == pytest.approx(y.var())
        assert r.log_likelihood == pytest.approx(-60 * (math.log(2 * math.pi * y.var()) + 1))
    assert sarimax.fit(two.where("t < 3"), ["k"], "t", "y", specs[1]).collect() == []
