"""Boosted trees of many series: splits against plain enumeration, early stop, status of short series."""

import datetime as dt

import numpy as np

from tallyspark.operators import boosting as bo


def _plain(x, y, bins, leaf_rows):
    """The best split by trying all of them: rank bins, first of equal gains by feature and place."""
    g, best = y - y.mean(), None
    for j in range(x.shape[1]):
        place = np.array([(x[:, j] < v).sum() for v in x[:, j]]) * bins // len(y)
        for b in sorted(set(place)):
            left = place <= b
            if leaf_rows <= left.sum() <= len(y) - leaf_rows:
                gain = round((g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()) / (g @ g), bo.GAIN_DIGITS)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, j, x[left, j].max())
    return best


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    for n, bins in ((60, 64), (200, 16), (333, 7)):
        x = np.stack([rng.integers(0, 4, n), rng.normal(size=n), np.repeat(1.0, n), rng.integers(0, 4, n) // 2], axis=1).astype(float)
        y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5, 0) + rng.normal(size=n)
        *_, first = bo.boost(x, y, x, y, x[:2], rounds=1, bins=bins, leaf_rows=10)
        _, feature, threshold = _plain(x, y, bins, 10)
        assert first == (feature, threshold)


def test_a_tree_holds_the_means_of_its_leaves():
    rng = np.random.default_rng(6)
    cells, y = rng.integers(0, 8, (400, 3)), rng.normal(size=400)
    y += 4.0 * (cells[:, 2] > 3) * (cells[:, 0] > 1)
    levels, values = bo.grow(cells, y, 3, 8, 20)
    node = np.zeros(400, np.int64)
    for feature, cut in levels:
        node = bo.descend(cells, node, feature, cut)
    for leaf in set(node):
        assert (node == leaf).sum() >= 20 and abs(values[leaf] - y[node == leaf].mean()) < 1e-9
    assert {int(levels[0][0][0]), int(levels[1][0][1])} == {0, 2}


def test_stops_when_validation_no_longer_improves():
    rng = np.random.default_rng(7)
    x, noise = rng.normal(size=(100, 2)), rng.normal(size=100)
    turn, guess, *_ = bo.boost(x, noise, x[:20], -noise[:20] * 9, x[:1], rounds=100, patience=3)
    assert turn == 1 and len(guess) == 20
    # A flat series has nothing to split on.
    turn, guess, ahead, splits, first = bo.boost(x, np.full(100, 4.0), x[:5], np.full(5, 4.0), x[:3])
    assert (turn, first, splits.sum()) == (0, None, 0) and set(guess) | set(ahead) == {4.0}


def test_every_series_has_its_own_model(spark, days):
    week = days([100.0 + 60 * (i % 7 >= 3) for i in range(400)], product="a")
    weekend = days([10.0 + 30 * (i % 7 >= 5) for i in range(400)], product="b")
    short, flat = days([5.0] * 40, product="c"), days([8.0] * 120, product="d")
    series = week.unionByName(weekend).unionByName(short).unionByName(flat)
    result = bo.boosted_forecast(series, 14, ["product"])
    fits = {r["product"]: r for r in result.fits.collect()}
    assert {p: r["status"] for p, r in fits.items()} == {"a": "fitted", "b": "fitted", "c": "too_short", "d": "fitted"}
    assert fits["c"]["n_rows"] == 10 and fits["c"]["yhat"] is None and [r["product"] for r in result.left_out.collect()] == ["c"]
    ahead = {(r["product"], r["ds"]): r["yhat"] for r in result.forecast.collect()}
    first = dt.date(2025, 2, 4)
    assert len(ahead) == 42 and {d for p, d in ahead if p == "b"} == {first + dt.timedelta(i) for i in range(14)}
    for i in range(14):
        day = first + dt.timedelta(i)
        assert abs(ahead["b", day] - (40 if day.weekday() >= 5 else 10)) < 2
        assert abs(ahead["a", day] - (160 if day.weekday() >= 3 else 100)) < 2
    assert all(v == 8.0 for (p, _), v in ahead.items() if p == "d")
    assert result.importances["is_weekend"] + result.importances["day_of_week"] > 0


def test_fits_and_relational_splits_agree(spark, days):
    rng = np.random.default_rng(8)
    parts = [days((50 + 9 * np.sin(np.arange(150) * s) + rng.normal(size=150) * 4).tolist(), product=f"p{s}") for s in range(1, 5)]
    series = parts[0]
    for part in parts[1:]:
        series = series.unionByName(part)
    found = bo.first_splits(bo.training_rows(series, ["product"]), ["product"], bo.feature_columns())
    want = {r["product"]: (r["feature"], r["threshold"]) for r in found.collect()}
    fits = {r["product"]: (r["first_feature"], r["first_threshold"]) for r in bo.boosted_fit(series, 3, ["product"]).collect()}
    assert len(want) == 4 and fits == want


def test_without_keys_and_repeated_days(spark, days):
    one = days([20.0 + i % 5 for i in range(130)])
    doubled = one.unionByName(one)
    a, b = bo.boosted_fit(one, 5).first(), bo.boosted_fit(doubled, 5).first()
    assert a["n_rows"] == b["n_rows"] == 100 and all(abs(2 * x - y) < 1e-6 for x, y in zip(a["yhat"], b["yhat"], strict=True))
    assert bo.boosted_fit(one.limit(0), 5).count() == 0
