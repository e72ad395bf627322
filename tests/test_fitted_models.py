"""Seasonal autoregressions and fitted smoothing: known processes are found again, brute force agrees, no series is lost."""

import datetime as dt
import math

import numpy as np
import pytest

from tallyspark.operators import forecasting as fc
from tallyspark.operators import sarima, smoothing

FIRST = dt.date(2023, 1, 1)


def table(spark, series):
    rows = [(name, FIRST + dt.timedelta(i), None if y is None else float(y)) for name, ys in series.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "product string, date date, sales double")


def simulated(seed, n, ar=(), ma=(), mean=100.0):
    """ar and ma are (lag, weight) pairs."""
    rng = np.random.default_rng(seed)
    e, w = rng.normal(0, 5, n + 50), np.zeros(n + 50)
    for t in range(n + 50):
        w[t] = e[t] + sum(a * w[t - k] for k, a in ar if t >= k) + sum(b * e[t - k] for k, b in ma if t >= k)
    return mean + w[50:]


def test_sarima_recovers_processes(spark):
    walk = np.cumsum(np.random.default_rng(9).normal(0, 3, 1500)) + 500
    series = {"ma": simulated(1, 1500, ma=[(1, 0.7)]), "season": simulated(2, 1500, ar=[(7, 0.8)]), "ar2": simulated(3, 1500, ar=[(1, 0.5), (2, 0.3)]), "walk": walk}
    fits = {r["product"]: r for r in sarima.sarima_fit(table(spark, series)).collect()}
    n = len(sarima.LAGS)
    ma, season, ar2 = fits["ma"], fits["season"], fits["ar2"]
    assert ma.d == season.d == ar2.d == 0 and fits["walk"].d == 1
    # The first lags of the weights of a moving average: shock at lag 1, or what an autoregression of it leaves.
    assert ma.q >= 1 and abs(ma.weights[n] + ma.weights[0] - 0.7) < 0.12
    assert season.seasonal_p == 1 and abs(season.weights[n - 1] - 0.8) < 0.12
    implied = np.array(ar2.weights)
    assert abs(implied[0] + implied[n] - 0.5) < 0.12
    assert all(f.status == "fitted" for f in fits.values())


def plain_fit(y):
    """Orders and weights of one series, step by step over its rows."""
    def root(v):
        z, x, c = np.diff(v)[1:], v[1:-1], np.diff(v)[:-1]
        n = len(z)
        if n <= 6:
            return False
        m = np.column_stack([np.ones(n), x, c])
        try:
            b = np.linalg.solve(m.T @ m, m.T @ z)
        except np.linalg.LinAlgError:
            return False
        s2 = ((z - m @ b) ** 2).sum() / (n - 3)
        t = b[1] / math.sqrt(s2 * np.linalg.inv(m.T @ m)[1, 1])
        p = sarima.ADF_POINT
        return t > p[0] + p[1] / n + p[2] / n**2 + p[3] / n**3

    d = 0 if not root(y) else 1 if not root(np.diff(y)) else 2
    w = np.diff(y, d)
    w = w - w.mean()
    long = np.column_stack([w[sarima.LONG - k : len(w) - k] for k in range(1, sarima.LONG + 1)])
    e = np.full(len(w), np.nan)
    e[sarima.LONG :] = w[sarima.LONG :] - long @ np.linalg.lstsq(long, w[sarima.LONG :], rcond=None)[0]
    start = sarima.LONG + sarima.SEASON
    target = w[start:]
    columns = {1 + i: w[start - k : len(w) - k] for i, k in enumerate(sarima.LAGS)} | {1 + len(sarima.LAGS) + i: e[start - k : len(w) - k] for i, k in enumerate(sarima.LAGS)}
    best = None
    for order in sarima.ORDERS:
        places = sarima.members(*order)
        if len(target) < 3 * (len(places) + 1):
            continue
        if places:
            m = np.column_stack([columns[p] for p in places])
            b = np.linalg.lstsq(m, target, rcond=None)[0]
            error = ((target - m @ b) ** 2).sum()
        else:
            b, error = [], (target**2).sum()
        value = len(target) * math.log(max(error / len(target), 1e-12)) + 2 * (len(places) + 1)
        if best is None or value < best[0] - 1e-9:
            weights = np.zeros(2 * len(sarima.LAGS))
            weights[np.array(places, int) - 1] = b
            best = (value, order, weights)
    return d, best


def test_sarima_against_plain_regressions(spark):
    rng = np.random.default_rng(4)
    series = {f"s{i}": simulated(10 + i, int(rng.integers(60, 400)), ar=[(1, 0.4), (7, 0.3)], ma=[(1, 0.3)]) for i in range(6)}
    series["trend"] = np.arange(200) * 2.0 + rng.normal(0, 1, 200)
    fits = {r["product"]: r for r in sarima.sarima_fit(table(spark, series)).collect()}
    for name, ys in series.items():
        d, (value, order, weights) = plain_fit(np.asarray(ys, float))
        got = fits[name]
        assert got.d == d
        assert abs(got.aic - value) < 1e-4 and (got.p, got.q, got.seasonal_p, got.seasonal_q) == order
        assert np.allclose(got.weights, weights, atol=1e-4)


def test_sarima_forecast_keeps_every_series(spark):
    series = {"one": [5], "short": [1, 2, 3], "week": [4, 5, 6, 7, 8, 9, 10], "flat": [3] * 60, "zero": [0] * 60, "gone": [None, None], "long": simulated(5, 200, ar=[(1, 0.6)])}
    rows = sarima.sarima(table(spark, series), horizon=5).collect()
    found = {}
    for r in rows:
        found.setdefault(r["product"], []).append(r)
    # A series without any value has no day and no series.
    assert set(found) == set(series) - {"gone"}
    assert [r.status for r in found["one"]] == ["too_short"] and found["one"][0].yhat is None and found["short"][0].status == "too_short"
    assert [round(r.yhat, 6) for r in sorted(found["flat"], key=lambda r: r.date)] == [3.0] * 5
    assert [r.yhat for r in found["zero"]] == [0.0] * 5
    assert {r.status for r in found["week"]} == {"mean"} and all(r.yhat is not None for r in found["week"])
    days = sorted(r.date for r in found["long"])
    assert days == [FIRST + dt.timedelta(199 + i) for i in range(1, 6)]


def test_roll_is_the_recursion_and_never_explodes():
    n = len(sarima.LAGS)
    weights = np.zeros(2 * n)
    weights[0], weights[n - 1], weights[n] = 0.5, 0.2, 0.4
    w, e = [float(i) for i in range(7, 0, -1)], [0.3, -0.2, 0.1, 0, 0, 0, 0.5]
    past, shocks, want = list(w), list(e), []
    for _ in range(10):
        v = 0.5 * past[0] + 0.2 * past[6] + 0.4 * shocks[0]
        want.append(v)
        past.insert(0, v)
        shocks.insert(0, 0.0)
    assert np.allclose(sarima.roll(weights, w, e, 10), want)
    weights[0] = 1.7
    assert abs(sarima.roll(weights, w, e, 400)[-1]) < 1


def test_order_shares_count_every_series(spark):
    series = {f"s{i}": simulated(i, 80, ar=[(1, 0.5)]) for i in range(4)} | {"one": [1]}
    rows = sarima.shares(sarima.sarima_fit(table(spark, series))).collect()
    assert sum(r.n_series for r in rows) == 5 and abs(sum(r.share for r in rows) - 1) < 1e-9


# ---- smoothing ----


def one_walk(ys, alpha, beta, gamma, factor, shift):
    floor = max(fc.FLOOR * abs(sum(ys) / len(ys)), 1e-8)
    first, second = sum(ys[:7]) / 7, sum(ys[7:14]) / 7
    base = max(first, floor)
    level, trend = max(base * factor, floor), (second - first) / 7 + shift * base / 7
    season = [max(y / base, fc.FLOOR) for y in ys[:7]]
    error = 0.0
    for y in ys[7:]:
        s = season.pop(0)
        ahead = level + trend
        error += (y - ahead * s) ** 2
        moved = max(alpha * y / s + (1 - alpha) * ahead, floor)
        trend = beta * (moved - level) + (1 - beta) * trend
        season.append(max(gamma * y / moved + (1 - gamma) * s, fc.FLOOR))
        level = moved
    return error, level, trend, season


def weekly(seed, n):
    rng = np.random.default_rng(seed)
    return np.maximum((100 + 0.3 * np.arange(n)) * (1 + 0.4 * np.sin(2 * np.pi * np.arange(n) / 7)) + rng.normal(0, 8, n), 0)


def test_walk_against_the_plain_recursion():
    ys = weekly(1, 75)
    points = np.array([[0.3, 0.1, 0.2, 1.0, 0.0], [0.7, 0.01, 0.05, 1.3, -0.4], [0.1, 0.3, 0.6, 0.8, 0.2]])
    error, level, trend, season = smoothing.walk(ys, points)
    for i, p in enumerate(points):
        e, l, t, s = one_walk(ys.tolist(), *p)
        assert np.allclose([error[i], level[i], trend[i]], [e, l, t]) and np.allclose(season[i], s)


def test_fitted_error_is_never_above_the_grid(spark):
    series = {f"s{i}": weekly(i, 40 + 30 * i) for i in range(6)} | {"zero": [0] * 30, "spiky": [0, 0, 9] * 20, "short": [1, 2, 3]}
    data = table(spark, series)
    grid = {r["product"]: r for r in fc.holt_winters_fit(data).collect()}
    rows = {r["product"]: r for r in smoothing.fitted_smoothing_fit(data).collect()}
    assert set(rows) == set(series)
    for name, r in rows.items():
        if name == "short":
            assert r.status == "mean" and r.level == 2 and r.sse is None
        else:
            assert r.status == "fitted" and r.sse <= grid[name].sse * (1 + 1e-9)
    assert sum(rows[f"s{i}"].sse < grid[f"s{i}"].sse * 0.999 for i in range(6)) >= 5


def test_fitted_forecast_follows_its_states(spark):
    series = {"a": weekly(3, 90), "short": [4, 4, 4]}
    data = table(spark, series)
    fit = {r["product"]: r for r in smoothing.fitted_smoothing_fit(data).collect()}
    for r in smoothing.fitted_smoothing(data, horizon=9).collect():
        f = fit[r["product"]]
        i = (r.date - f.last_date).days
        assert r.yhat == pytest.approx((f.level + i * f.trend) * f.seasons[(i - 1) % 7])


# ---- piecewise trend and waves ----


def test_fourier_trend_recovers_a_planted_break(spark):
    from tallyspark.operators import fourier

    n = 800
    t = np.arange(n)
    rng = np.random.default_rng(8)
    level = 200 + 0.2 * t + np.where(t > 360, 0.9 * (t - 360), 0)
    ys = level * (1 + 0.3 * np.sin(2 * np.pi * t / 7)) + rng.normal(0, 4, n)
    data = table(spark, {"a": ys, "one": [5], "zero": [0] * 40, "two": [3, 4]})
    rows = fourier.fourier_trend(data, horizon=20).collect()
    mine = sorted((r for r in rows if r["product"] == "a"), key=lambda r: r.date)
    assert len(mine) == n + 20 and sum(r.is_future for r in mine) == 20
    ahead = np.arange(n, n + 20)
    truth = (200 + 0.2 * ahead + 0.9 * (ahead - 360)) * (1 + 0.3 * np.sin(2 * np.pi * ahead / 7))
    got = np.array([r.yhat for r in mine[n:]])
    assert np.abs(got / truth - 1).mean() < 0.05
    widths = [r.yhat_upper - r.yhat_lower for r in mine[n:]]
    assert all(b > a for a, b in zip(widths, widths[1:]))
    inside = np.mean([r.yhat_lower <= r.y <= r.yhat_upper for r in mine[:n]])
    assert inside > 0.9
    # Every series is forecast, however short.
    assert {r["product"] for r in rows if r.is_future} == {"a", "one", "zero", "two"}
    assert all(abs(r.yhat) < 1e-6 for r in rows if r["product"] == "zero")
    changes = [r for r in fourier.change_points(data).collect() if r["product"] == "a"]
    assert len(changes) == fourier.CHANGES
    top = max(changes, key=lambda r: r.slope_change)
    assert abs((top.date - FIRST).days - 360) <= n * fourier.REACH / (fourier.CHANGES + 1)
    assert abs(sum(r.slope_change for r in changes) - 0.9) < 0.25


def test_autoregression_and_backtest_keep_short_series(spark):
    data = table(spark, {"short": [1, 2, 3], "long": simulated(6, 90, ar=[(1, 0.5)])})
    rows = fc.autoregressive(data, horizon=3, with_status=True).collect()
    assert sorted((r["product"], r.status, r.yhat is None) for r in rows) == [("long", "fitted", False)] * 3 + [("short", "too_short", True)]
    for model in ("trend_seasonal", "autoregressive", "holt_winters"):
        found = {r["product"]: r for r in fc.backtest(data, model, step=5, with_status=True).collect()}
        assert found["short"].status == "too_short" and found["short"].n == 0 and found["short"].mae is None
        assert found["long"].status == "scored" and found["long"].mae > 0
