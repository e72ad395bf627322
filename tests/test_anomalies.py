import datetime as dt
import math
import random

import pytest

from tallyspark.operators import anomalies as an
from tallyspark.operators.rollups import fill_days


def test_zscore(days):
    found = an.detect_anomalies(days([100] * 28 + [200, 50]), threshold=2.0).collect()
    assert sorted(r["sales"] for r in found) == [50.0, 200.0]
    high = next(r for r in found if r["sales"] == 200)
    mean = (28 * 100 + 250) / 30
    assert high["anomaly_type"] == "High Sales" and math.isclose(high["expected_sales"], mean)
    assert math.isclose(high["deviation_pct"], (200 - mean) / mean * 100) and high["severity"] == "High"


def test_iqr_and_mad(days):
    assert sorted(r["sales"] for r in an.detect_anomalies(days([100] * 25 + [200, 300, 10, 5]), "iqr").collect()) == [5, 10, 200, 300]
    # The median deviation is 0 here: any deviation is anomalous, none is not.
    found = an.detect_anomalies(days([100] * 27 + [250, 20, 10]), "mad").collect()
    assert sorted(r["sales"] for r in found) == [10, 20, 250] and {r["method"] for r in found} == {"mad"}


def test_quiet_series(days):
    rnd = random.Random(7)
    assert an.detect_anomalies(days([100 + max(-10, min(10, rnd.gauss(0, 5))) for _ in range(30)]), threshold=3.0).count() == 0
    assert an.detect_anomalies(days([100] * 30)).count() == 0
    assert an.detect_anomalies(days([1, 2, 3])).count() == 0


def test_nothing_expected_is_critical(days):
    row = an.detect_anomalies(days([0] * 9 + [5]), "iqr").first()
    assert row["deviation_pct"] is None and row["severity"] == "Critical"


def test_arguments(days, spark):
    df = days([1] * 10)
    with pytest.raises(ValueError, match="Missing required columns"):
        an.detect_anomalies(spark.range(1))
    with pytest.raises(ValueError, match="must be positive"):
        an.detect_anomalies(df, threshold=-1)
    with pytest.raises(ValueError, match="method must be"):
        an.detect_anomalies(df, method="other")
    with pytest.raises(ValueError, match="method must be"):
        an.detector(df, method="other")


def test_products(days):
    values = [[200 if i == 14 else 100 for i in range(30)], [300 if i == 14 else 150 for i in range(30)]]
    rows = days(values[0], product_id="P001").union(days(values[1], product_id="P002")).union(days([1, 2, 99], product_id="P003"))
    found = an.detect_product_anomalies(rows).collect()
    assert sorted((r["product_id"], r["sales"]) for r in found) == [("P001", 200.0), ("P002", 300.0)]


def test_centred_average(days):
    values = [100 + 2 * i for i in range(30)]
    values[15] = 200
    assert an.centred_average_anomalies(days(values)).count() == 0
    row = an.centred_average_anomalies(days(values), gate_pct=40).collect()
    assert len(row) == 1 and row[0]["moving_avg"] == 140.0 and math.isclose(row[0]["deviation_pct"], 60 / 140 * 100)


def test_rolling_band(days):
    # Six equal days and one spike: mean 114.3, deviation 37.8; only full windows count.
    found = an.rolling_band(fill_days(days([100] * 6 + [200]))).collect()
    assert len(found) == 1 and found[0]["direction"] == "high" and math.isclose(found[0]["rolling_mean"], 800 / 7)
    assert an.rolling_band(fill_days(days([100] * 5 + [200]))).count() == 0


def test_rolling_zscore(days):
    rows = {r["date"].day: r for r in an.rolling_zscore(days([100] * 6 + [200, 100])).collect()}
    assert rows[1]["z_score"] == 0 and rows[6]["z_score"] == 0 and rows[1]["std_dev_sales"] is None
    assert math.isclose(rows[7]["z_score"], 6 / math.sqrt(7)) and rows[7]["is_anomaly_high"] and not rows[7]["is_anomaly_low"]
    assert an.rolling_zscore(days([5])).count() == 0
    assert an.rolling_zscore(days([100, 101] * 4 + [200]), exclude_current=True).filter("is_anomaly_high").count() == 1


def test_detector(days):
    values = [100, 101] * 10 + [400, 1]
    found = {r["sales"]: r for r in an.detector(days(values), "iqr").collect()}
    assert set(found) == {400.0, 1.0} and found[400.0]["anomaly_type"] == "High Sales Spike"
    assert found[400.0]["severity"] == "Critical" and found[1.0]["severity"] == "Moderate"
    assert [r["sales"] for r in an.detector(days(values), "zscore").collect()] == [400.0]


def test_detector_window_follows_length(days):
    # 16 rows give windows of 4: the largest z-score of 4 points is 1.5, so nothing can exceed 2.
    assert an.detector(days([1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 90]), "rolling").count() == 0
    # 32 rows give windows of 8, where a spike reaches 7/sqrt(8) = 2.47.
    assert [r["sales"] for r in an.detector(days([1, 2] * 15 + [1, 90]), "rolling").collect()] == [90.0]


def test_digest(days):
    row = an.anomaly_digest(an.detector(days([100, 101] * 10 + [400, 1]), "iqr")).first()
    assert tuple(row) == (1, 1, 2)


def test_context(days):
    daily = days([100] * 20 + [900] + [100] * 20)
    found = an.anomaly_context(an.detect_anomalies(daily, threshold=3.0), daily).collect()
    assert len(found) == 22 and sum(r["is_anomaly"] for r in found) == 1
    assert min(r["date"] for r in found) == dt.date(2024, 1, 7) and max(r["date"] for r in found) == dt.date(2024, 1, 28)


def test_thresholds_are_monotonic(days):
    rnd = random.Random(3)
    df = days([rnd.expovariate(0.01) for _ in range(60)])
    sizes = [an.detect_anomalies(df, threshold=t).count() for t in (1.0, 2.0, 3.0)]
    assert sizes == sorted(sizes, reverse=True)


def test_festivals(spark, days):
    calendar = spark.createDataFrame([("2024-01-03", "A"), ("2024-02-01", "B"), ("2023-12-01", "C")], "date string, name string")
    near = an.festival_windows(days([1] * 10), calendar).collect()
    assert sorted((r["festival"], r["offset_days"]) for r in near) == [("A", k) for k in range(-2, 4)]
    from pyspark.sql import functions as F

    coming = an.upcoming_festivals(calendar, F.lit("2024-01-01")).collect()
    assert [(r["name"], r["days_away"]) for r in coming] == [("A", 2), ("B", 31)]


def test_empty(days):
    empty = days([])
    for method in an.METHODS:
        assert an.detect_anomalies(empty, method).count() == 0
    assert an.rolling_band(fill_days(empty)).count() == 0 and an.detector(empty, "rolling").count() == 0
