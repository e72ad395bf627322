import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import by
from tallyspark.operators import forecasting as fc, rollups
from tallyspark.operators.boosting import boosted_forecast, feature_columns

WEEK = [10, 20, 30, 40, 50, 60, 70]


def test_trend_seasonal_line(days):
    rows = sorted(fc.trend_seasonal(days([100 + 2 * i for i in range(28)], product="a"), 5).collect(), key=lambda r: r["date"])
    assert len(rows) == 33 and [r["is_future"] for r in rows].count(True) == 5
    assert rows[28]["date"] == dt.date(2024, 1, 29) and abs(rows[28]["yhat"] - 156) < 6
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in rows)


def test_trend_seasonal_week(days):
    rows = [r for r in fc.trend_seasonal(days(WEEK * 6, product="a"), 7).collect() if r["is_future"]]
    rows.sort(key=lambda r: r["date"])
    for r, expected in zip(rows, WEEK, strict=True):
        assert abs(r["yhat"] - expected) / expected < 0.2


def test_short_series(days):
    one = days([5], product="a")
    for model in fc.MODELS:
        # Smoothing falls back to the mean; the other models have nothing to fit on one day.
        assert fc.forecast(one, model, 3).count() == (3 if model == "holt_winters" else 0)
    assert fc.trend_seasonal(days([5, 5], product="a"), 3).count() == 5
    assert fc.autoregressive(days([4, 6, 5, 5, 5], product="a"), 2).select("yhat").distinct().first()[0] == 5.0
    assert fc.holt_winters(days([5] * 13, product="a"), 3).select("yhat").distinct().first()[0] == 5.0


def test_autoregression_counts_days_with_data(spark):
    sparse = [("a", dt.date(2024, 1, 1 + 7 * i), 5.0) for i in range(4)]
    df = spark.createDataFrame(sparse, "product string, date date, sales double")
    assert fc.autoregressive(df, 3).count() == 0


def test_backtest_reads_null_as_zero(days):
    values = WEEK * 5
    holes = [None if i == 30 else v for i, v in enumerate(values)]
    zeros = [0 if i == 30 else v for i, v in enumerate(values)]
    a, b = (fc.backtest(days(v, product="a"), window=21, horizon=7).first() for v in (holes, zeros))
    assert a == b


def test_autoregression_recovers_process(days):
    y = [50.0]
    for _ in range(60):
        y.append(20 + 0.5 * y[-1])
    # A pure lag-1 process started away from its mean of 40.
    fit = fc.ar_coefficients(days(y, product="a")).first()
    rows = sorted(fc.autoregressive(days(y, product="a"), 3).collect(), key=lambda r: r["date"])
    assert len(rows) == 3 and all(abs(r["yhat"] - 40) < 0.5 for r in rows)
    assert fit["last_date"] == dt.date(2024, 3, 1)


def test_autoregression_steps(days):
    """The rolled-forward path equals the same recursion in plain Python."""
    import random

    rnd = random.Random(5)
    y = [100 + 30 * math.sin(i / 3) + rnd.gauss(0, 10) for i in range(80)]
    fit = fc.ar_coefficients(days(y, product="a")).first()
    got = [r["yhat"] for r in sorted(fc.autoregressive(days(y, product="a"), 10).collect(), key=lambda r: r["date"])]
    levels = list(y)
    for _ in range(10):
        if fit["d"] == 1:
            z = [b - a for a, b in zip(levels, levels[1:], strict=False)]
            levels.append(levels[-1] + fit["c"] + fit["phi1"] * z[-1] + fit["phi7"] * z[-7])
        else:
            levels.append(fit["c"] + fit["phi1"] * levels[-1] + fit["phi7"] * levels[-7])
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, levels[80:], strict=True))


def test_holt_winters_repeats_the_week(days):
    rows = sorted(fc.holt_winters(days(WEEK * 4, product="a"), 14).collect(), key=lambda r: r["date"])
    assert [round(r["yhat"], 6) for r in rows] == [float(v) for v in WEEK * 2]


def test_holt_winters_survives_gaps(spark):
    rows = [("a", dt.date(2024, 1, 1), 5.0), ("a", dt.date(2024, 2, 20), 5.0)]
    out = fc.holt_winters(spark.createDataFrame(rows, "product string, date date, sales double"), 5).collect()
    assert len(out) == 5 and all(math.isfinite(r["yhat"]) for r in out)


def test_series_are_independent(days):
    both = days(WEEK * 4, product="a").union(days([v * 3 for v in WEEK * 4], product="b"))
    for model in fc.MODELS:
        rows = by(fc.forecast(both, model, 1).groupBy("series_key").agg(F.max_by("yhat", "date").alias("y")), "series_key")
        assert math.isclose(rows["b"]["y"], 3 * rows["a"]["y"], rel_tol=1e-6)
    alone = fc.forecast(both.filter("product = 'a'"), "trend_seasonal", 1, keys=()).collect()
    assert {r["series_key"] for r in alone} == {"All Products"}
    with pytest.raises(ValueError):
        fc.forecast(both, "other")
    with pytest.raises(ValueError):
        fc.forecast(both, "holt_winters", 0)


def test_direction(spark):
    past = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), 10.0)], "product string, date date, y double")
    for value, expected in ((12.1, "UP"), (7.9, "DOWN"), (10.0, "FLAT")):
        ahead = spark.createDataFrame([("a", dt.date(2024, 1, 3), value), ("a", dt.date(2024, 1, 4), 99.0)], "product string, date date, yhat double")
        assert fc.forecast_direction(past, ahead).first()["direction"] == expected


def naive_origins(n, window, horizon, dates):
    pairs = []
    for i in range(n - window - horizon + 1):
        end = dates[i + window - 1]
        for k in range(n):
            if 0 < (dates[k] - end).days <= horizon:
                pairs.append((i, dates[k]))
    return sorted(pairs)


def test_origins_match_brute_force(spark):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in (0, 1, 2, 5, 6, 7, 8, 12, 13, 14, 15, 16, 17, 21)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(dates)], "product string, date date, sales double")
    rows = fc._origins(df, 5, 3, 1, ["product"], "date", "sales").collect()
    got = sorted((r["_origin"], r["date"]) for r in rows if r["_test"])
    assert got == naive_origins(len(dates), 5, 3, dates)
    train = {}
    for r in rows:
        if not r["_test"]:
            train.setdefault(r["_origin"], []).append(r["date"])
    assert {i: sorted(v) for i, v in train.items()} == {i: dates[i:i + 5] for i in range(len(dates) - 7)}


@pytest.mark.parametrize("model", list(fc.MODELS))
def test_backtest(days, model):
    row = fc.backtest(days(WEEK * 5, product="a"), model, window=21, horizon=7).first()
    assert row["n"] == 8 * 7 and 0 <= row["mape"] < 40
    assert fc.backtest(days(WEEK, product="a"), model, window=21, horizon=7).count() == 0


def test_boosting(days):
    values = [100 + 20 * (i % 7) for i in range(120)]
    result = boosted_forecast(days(values, product="a"), 7, ["product"], rounds=5)
    rows = result.forecast.collect()
    assert len(rows) == 7 and all(r["yhat"] >= 0 for r in rows) and min(r["ds"] for r in rows) == dt.date(2024, 4, 30)
    assert set(result.importances) == set(feature_columns()) and not any("lag" in c for c in result.importances)
    metrics = result.metrics.first()
    assert 0 <= metrics["mae"] <= metrics["rmse"]
    with pytest.raises(ValueError, match="at least 50"):
        boosted_forecast(days(values[:60], product="a"), 7, ["product"])


def test_boosted_forecast_leaves_out_short_series(days):
    long = days([100.0 + i % 7 for i in range(120)], product="a")
    result = boosted_forecast(long.unionByName(days([5.0] * 40, product="b")), 3, ["product"], rounds=2)
    assert {r["product"] for r in result.forecast.collect()} == {"a"}
    assert [r["product"] for r in result.left_out.collect()] == ["b"]


def test_short_series_are_forecast_by_their_mean(days):
    for n in (1, 2, 13, 14):
        rows = fc.holt_winters(days([2.0, 4.0] * 7, product="a").orderBy("date").limit(n), 3).collect()
        assert len(rows) == 3 and (n == 14 or all(abs(r["yhat"] - (2.0 if n == 1 else 3.0 - (n % 2) / n)) < 1e-9 for r in rows))


def test_tasks_grow_with_the_rows(spark, capsys):
    parts = spark.range(3000).selectExpr("cast(id % 100 as string) product", "date_add(date'2024-01-01', cast(id % 41 as int)) date", "cast(id as double) sales")
    cores = spark.sparkContext.defaultParallelism
    assert rollups.partitions_for(parts) == cores and rollups.partitions_for(parts.limit(0)) == cores
    assert rollups.partitions_for(parts, 100) == 30 and rollups.partitions_for(parts.union(parts), 100) == 60
    dealt = rollups.daily_sales(parts.repartition(30, "product", "date"), ["product"])
    many, few = (fc.trend_seasonal(x, 3, partitions=n) for x, n in ((dealt, 30), (rollups.daily_sales(parts, ["product"]), None)))
    many.explain()
    # Two exchanges, both of that many partitions: the rollup adds none of its own, which would not grow.
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all(", 30), REPARTITION_BY_NUM" in line for line in exchanges)
    shown = [{(r["product"], r["date"], r["y"], round(r["yhat"], 6), round(r["yhat_upper"], 6)) for r in x.collect()} for x in (many, few)]
    assert shown[0] == shown[1] and len(shown[0]) == many.count()


def test_parts_are_dealt_out_by_their_rows(spark, tmp_path, monkeypatch, capsys):
    from tallyspark.plans.queries import REGISTRY

    rows = spark.range(400).selectExpr("id % 7 l_partkey", "timestamp'2024-01-01' + make_dt_interval(cast(id % 50 as int)) l_shipdate", "cast(id as double) l_extendedprice", "1d l_quantity")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    counted = rollups.partitions_for
    monkeypatch.setattr(rollups, "partitions_for", lambda df: counted(df, 20))
    forecast = REGISTRY["forecast_parts"](spark, str(tmp_path))
    forecast.explain()
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all(", 20), REPARTITION_BY_NUM" in line for line in exchanges)
    assert forecast.count() == 7 * 30
