"""Windows of one series cut into stretches: the same rows as one window over all of it, and no single task."""

import datetime as dt
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import anomalies, rollups, series, stretches


def _sparse(spark, n, seed, longest):
    rng, day, rows = random.Random(seed), dt.date(1969, 3, 1), []
    for _ in range(n):
        rows.append((day, float(rng.randrange(1000))))
        day += dt.timedelta(rng.choice([1, 1, 2, rng.randrange(1, longest)]))
    return spark.createDataFrame(rows, "date date, sales double")


def _build(w):
    past, around = w.rowsBetween(-6, 0), w.rowsBetween(-3, 2)
    return {"past": F.sum("sales").over(past), "n": F.count("sales").over(past), "around": F.sum("sales").over(around), "lag": F.lag("sales", 6).over(w)}


def test_stretches_equal_one_window(spark):
    # Stretches shorter than, as long as and longer than the gaps, some of them with fewer rows than a frame.
    for n, longest, stretch in ((200, 4, 7), (200, 60, 10), (60, 400, 16), (5, 3, 64), (1, 2, 8), (0, 2, 8)):
        rows = _sparse(spark, n, n + stretch, longest)
        want = sorted(tuple(r) for r in rows.withColumns(_build(W.orderBy("date"))).collect())
        got = sorted(tuple(r) for r in stretches.windowed(rows, (), "date", 6, 2, _build, stretch).collect())
        assert got == want and len(got) == n
        ahead = rows.withColumn("next", F.lead("date").over(W.orderBy("date"))).select("date", "next").collect()
        found = stretches.with_next_date(rows, (), "date", "next", stretch).select("date", "next").collect()
        assert sorted((r[0], str(r[1])) for r in found) == sorted((r[0], str(r[1])) for r in ahead)


def test_rows_without_a_date_come_first(spark):
    rows = spark.createDataFrame([(None, 1.0), (dt.date(1960, 1, 1), 2.0), (dt.date(2030, 1, 1), 4.0)], "date date, sales double")
    got = stretches.windowed(rows, (), "date", 6, 2, _build).select("sales", "past").collect()
    assert {r["sales"]: r["past"] for r in got} == {1.0: 1.0, 2.0: 3.0, 4.0: 7.0}


def test_filled_days_over_stretches(spark):
    filled = rollups.fill_days(spark.createDataFrame([(dt.date(2000, 1, 1), 5.0), (dt.date(2012, 6, 1), 7.0)], "date date, sales double"))
    rows = {r["date"]: r["sales"] for r in filled.collect()}
    assert len(rows) == (dt.date(2012, 6, 1) - dt.date(2000, 1, 1)).days + 1 and sum(rows.values()) == 12.0


def test_no_window_in_a_single_task(spark):
    daily = _sparse(spark, 50, 3, 5).groupBy("date").agg(F.sum("sales").alias("sales"))
    plans = {
        "W1": anomalies.rolling_band(rollups.fill_days(daily)), "W2": anomalies.rolling_zscore(daily), "W8": anomalies.centred_average_anomalies(daily),
        "W11": anomalies.detector(daily, "rolling"), "W13": series.lag_features(daily), "W14": series.rolling_features(daily),
    }
    for name, frame in plans.items():
        lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        windows = [i for i, line in enumerate(lines) if "Window [" in line]
        assert windows, name
        for i in windows:
            below = next(line for line in lines[i:] if "Exchange" in line)
            assert "hashpartitioning" in below and "SinglePartition" not in below, (name, below)
