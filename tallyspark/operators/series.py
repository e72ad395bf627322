"""Feature tables over daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tallyspark.functions.dates import time_features
from tallyspark.operators.stretches import windowed
from tallyspark.schemas import require_columns

LAGS = (1, 7, 14, 30)
WINDOWS = (7, 14, 30)


def lag_features(series: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales", lags: Sequence[int] = LAGS) -> DataFrame:
    """Values of earlier rows of the same series."""
    require_columns(series, [*keys, date, sales])
    return windowed(series, keys, date, max(lags), 0, lambda ordered: {f"sales_lag_{k}": F.lag(sales, k).over(ordered) for k in lags})


def rolling_features(series: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales", windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Trailing mean and sample deviation; null until a window is full."""
    require_columns(series, [*keys, date, sales])
    def trailing(ordered: WindowSpec) -> dict[str, Column]:
        out = {}
        for n in windows:
            frame = ordered.rowsBetween(1 - n, 0)
            full = F.count(sales).over(frame) == n
            out[f"sales_rolling_mean_{n}"] = F.when(full, F.avg(sales).over(frame))
            out[f"sales_rolling_std_{n}"] = F.when(full, F.stddev_samp(sales).over(frame))
        return out

    return windowed(series, keys, date, max(windows) - 1, 0, trailing)


def ml_features(series: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales") -> DataFrame:
    """Calendar, lag and rolling features; all windows share one sort of each series."""
    return rolling_features(lag_features(time_features(series, date), keys, date, sales), keys, date, sales)


def accuracy_metrics(pairs: DataFrame, keys: Sequence[str] = (), actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """Mean absolute error and mean absolute percentage error (zero actuals guarded) per key."""
    require_columns(pairs, [*keys, actual, predicted])
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return pairs.groupBy(*keys).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e / F.greatest(y, F.lit(1e-8)))) * 100).alias("mape"),
    )
