import datetime as dt

import pytest

from tallyspark.operators import kpis, rollups, series
from tallyspark.functions.dates import calendar_features, time_features


@pytest.fixture(scope="module")
def shop(spark):
    def build(rows, columns="product string, date timestamp_ntz, sales double, quantity double, profit double"):
        return spark.createDataFrame([(p, dt.datetime.fromisoformat(d), *map(float, rest)) for p, d, *rest in rows], columns)

    return build


def test_totals_and_shares(shop):
    df = shop([("a", "2024-01-01", 50, 5, 10), ("b", "2024-01-01", 40, 4, -1), ("c", "2024-01-02", 7, 3, 8), ("d", "2024-01-02", 2, 2, 9), ("e", "2024-01-03", 1, 1, 9)])
    assert tuple(kpis.kpi_totals(df).first()) == (100.0, 35.0, 5)
    assert tuple(kpis.kpi_totals(df.drop("profit")).first()) == (100.0, None, 5)
    assert [(r["rank"], r["product"], round(r["share_pct"], 9)) for r in kpis.product_top(df).collect()] == [(1, "a", 50.0), (2, "b", 40.0), (3, "c", 7.0)]
    assert kpis.product_bottom(df).count() == 0  # 10 % is not under 5 %
    assert [r["product"] for r in kpis.product_bottom(df, k=2).collect()] == ["e", "d"]
    assert [r["product"] for r in kpis.low_profit_items(df).collect()] == ["b"]
    assert tuple(kpis.top_product(df).first()) == ("a", 50.0)
    assert kpis.low_sales_alert(df).first()["product"] == "e"
    movers = {r["kind"]: r for r in kpis.inventory_movers(df).collect()}
    assert movers["fast"]["products"] == "a, b, c" and movers["fast"]["impact"] == 80.0
    assert movers["slow"]["products"] == "c, d, e" and movers["slow"]["impact"] == 60.0


def test_few_products_have_no_bottom(shop):
    df = shop([("a", "2024-01-01", 50, 5, 1), ("b", "2024-01-01", 1, 1, 1)])
    assert kpis.product_bottom(df).count() == 0 and [r["kind"] for r in kpis.inventory_movers(df).collect()] == ["fast"]


def test_ties_go_by_name(shop):
    df = shop([(p, "2024-01-01", 5, 5, 1) for p in "dcba"])
    assert [r["product"] for r in kpis.product_top(df).collect()] == ["a", "b", "c"]


def test_week_over_week(days):
    row = kpis.week_over_week(days([10] * 7 + [20] * 7)).first()
    assert (row["recent_sales"], row["previous_sales"], row["change_pct"], row["significant"]) == (140.0, 70.0, 100.0, True)
    assert kpis.week_over_week(days([10] * 13)).count() == 0
    row = kpis.week_over_week(days([0] * 7 + [20] * 7)).first()
    assert row["initiated"] and row["change_pct"] is None and row["significant"]
    assert not kpis.week_over_week(days([10] * 7 + [10.5] * 7)).first()["significant"]


def test_month_over_month_crosses_years(days):
    row = kpis.month_over_month(days([10] * 31 + [20] * 15, start="2023-12-01")).first()
    assert (row["current_sales"], row["previous_sales"]) == (300.0, 310.0) and not row["significant"]
    assert kpis.month_over_month(days([10] * 31 + [20] * 31, start="2023-12-01")).first()["change_pct"] == 100.0


def test_iso_week(days):
    # 2024-12-30 is in ISO week 1 of 2025: week numbers alone put week 52 last.
    df = days([1] * 7 + [2] * 7 + [5] * 7, start="2024-12-16")
    row = kpis.iso_week_trend(df).first()
    assert (row["latest_week"], row["sales_latest"], row["sales_previous"], row["change_pct"]) == (52, 14.0, 7.0, 100.0)
    row = kpis.iso_week_trend(df, year_aware=True).first()
    assert (row["latest_week"], row["sales_latest"], row["sales_previous"]) == (dt.date(2024, 12, 30), 35.0, 14.0)


def test_weekend(days):
    row = kpis.weekend_effect(days([10] * 5 + [40] * 2)).first()  # 2024-01-01 is a Monday
    assert (row["effect"], row["ratio"], row["impact"]) == ("surge", 1.6, 60.0)
    row = kpis.weekend_effect(days([10] * 7)).first()
    assert row["effect"] == "lag" and row["impact"] == 60.0
    assert kpis.weekend_effect(days([10] * 7), per_day=True).first()["effect"] == "none"
    assert kpis.weekend_effect(days([10] * 5)).count() == 0


def test_peak_hour(shop):
    df = shop([("a", "2024-01-01T09:30:00", 30, 1, 1), ("a", "2024-01-02T17:00:00", 30, 1, 1), ("a", "2024-01-02T18:00:00", 40 / 3, 1, 1)])
    row = kpis.peak_hour(df).first()
    assert row["peak_hour"] == 9 and row["significant"]
    assert not kpis.peak_hour(df, share_pct=50).first()["significant"]


def test_fill_days(spark):
    rows = [("a", dt.date(2024, 1, 1), 5.0), ("a", dt.date(2024, 1, 4), 7.0), ("b", dt.date(2024, 1, 9), 1.0)]
    df = spark.createDataFrame(rows, "product string, date date, sales double")
    out = sorted((r["product"], r["date"].day, r["sales"]) for r in rollups.fill_days(df, ["product"]).collect())
    assert out == [("a", 1, 5.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 7.0), ("b", 9, 1.0)]
    assert rollups.fill_days(df.filter("product = 'a'")).agg({"sales": "sum"}).first()[0] == 12.0


def test_active_day_average(shop):
    df = shop([("a", "2024-01-01T08:00:00", 2, 1, 0), ("a", "2024-01-01T20:00:00", 4, 1, 0), ("a", "2024-01-09", 2, 4, 0)])
    row = rollups.avg_daily_by_product(df).first()
    assert (row["active_days"], row["avg_daily_sales"], row["avg_daily_quantity"]) == (2, 4.0, 3.0)
    assert rollups.daily_sales(df).agg({"sales": "sum"}).first()[0] == kpis.kpi_totals(df).first()["total_sales"]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 17, 5),)], "date timestamp_ntz")
    row = calendar_features(df).first()
    assert (row["day_of_week"], row["hour"], row["month"], row["week_of_year"], row["year"]) == ("Monday", 17, 12, 1, 2024)
    row = time_features(df).first()
    assert (row["day_of_week"], row["quarter"], row["is_weekend"], row["is_month_end"]) == (0, 4, 0, 1)


def test_features(days):
    rows = sorted(series.ml_features(days(list(range(1, 41)))).collect(), key=lambda r: r["date"])
    assert rows[0]["sales_lag_1"] is None and rows[7]["sales_lag_7"] == 1.0 and rows[30]["sales_lag_30"] == 1.0
    assert rows[5]["sales_rolling_mean_7"] is None and rows[6]["sales_rolling_mean_7"] == 4.0
    assert abs(rows[6]["sales_rolling_std_7"] - 2.160246899) < 1e-8 and rows[28]["sales_rolling_std_30"] is None


def test_accuracy(spark):
    df = spark.createDataFrame([(10.0, 8.0), (20.0, 25.0), (0.0, 0.0)], "y double, yhat double")
    row = series.accuracy_metrics(df).first()
    assert row["n"] == 3 and abs(row["mae"] - 7 / 3) < 1e-12 and abs(row["mape"] - 15.0) < 1e-9
