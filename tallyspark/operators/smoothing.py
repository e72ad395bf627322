"""Exponential smoothing whose parameters and start states are fitted for each series.

A pattern search starts at the best point of the smoothing grid, so its error is never above the grid's.  It moves the
three smoothing weights, the first level and the first trend, always to the best of the neighbouring points, and
halves its step where none is better.  All neighbours of a series are evaluated together, in one walk over its days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.forecasting import FLOOR, SEASON, SMOOTHING_GRID, _daily
from tallyspark.operators.rollups import fill_days

ROUNDS = 40
FIRST_STEP = 0.16
LEAST_STEP = 0.002
WEIGHTS = (0.001, 0.999)  # Bounds of the smoothing weights.


def walk(ys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One walk over a series from its second week, for all points at once: error, level, trend, season factors.

    A point has the weights of level, trend and season, a factor on the first level and a shift of the first trend in
    levels a week.  Additive trend, multiplicative week, as in the grid fit.
    """
    alpha, beta, gamma = points[:, 0], points[:, 1], points[:, 2]
    floor = max(FLOOR * abs(ys.mean()), 1e-8)
    first, second = ys[:SEASON].mean(), ys[SEASON : 2 * SEASON].mean()
    base = max(first, floor)
    level = np.maximum(base * points[:, 3], floor)
    trend = (second - first) / SEASON + points[:, 4] * base / SEASON
    season = np.repeat(np.maximum(ys[:SEASON] / base, FLOOR)[None], len(points), axis=0)
    error = np.zeros(len(points))
    for t, y in enumerate(ys[SEASON:]):
        due = season[:, t % SEASON]
        ahead = level + trend
        miss = y - ahead * due
        error += miss * miss
        moved = np.maximum(alpha * (y / due) + (1 - alpha) * ahead, floor)
        trend = beta * (moved - level) + (1 - beta) * trend
        season[:, t % SEASON] = np.maximum(gamma * (y / moved) + (1 - gamma) * due, FLOOR)
        level = moved
    turn = (len(ys) - SEASON) % SEASON
    return error, level, trend, np.roll(season, -turn, axis=1)


def fit(ys: np.ndarray, grid: Sequence[tuple[float, float, float]] = SMOOTHING_GRID) -> tuple[np.ndarray, float, float, float, np.ndarray]:
    """The fitted point of one series of two weeks or more, its error, and level, trend and season at its end."""
    starts = np.array([[*g, 1.0, 0.0] for g in grid])
    errors, *_ = walk(ys, starts)
    point, error, step = starts[errors.argmin()], errors.min(), FIRST_STEP
    low, high = np.array([*[WEIGHTS[0]] * 3, 0.2, -3.0]), np.array([*[WEIGHTS[1]] * 3, 5.0, 3.0])
    moves = np.concatenate([np.eye(5), -np.eye(5)])
    for _ in range(ROUNDS):
        around = np.clip(point + step * moves, low, high)
        errors, *_ = walk(ys, around)
        best = int(errors.argmin())
        if errors[best] < error:
            point, error = around[best], errors[best]
        elif step < LEAST_STEP:
            break
        else:
            step /= 2
    _, level, trend, season = walk(ys, point[None])
    return point, float(error), float(level[0]), float(trend[0]), season[0]


def fitted_smoothing_fit(series: DataFrame, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """One row for every series: parameters, squared error, and the states at its end.

    ``status`` is ``fitted``, or ``mean`` for less than two weeks, whose level is the mean of its days.
    """
    keys = list(keys)
    filled = fill_days(_daily(series, keys, date, sales), keys, "date", "y")
    packed = F.transform(F.sort_array(F.collect_list(F.struct("date", "y"))), lambda p: p["y"])
    arrays = filled.groupBy(*keys).agg(F.max("date").alias("last_date"), packed.alias("ys"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.select(*keys, "last_date").schema.fields)
    names = ["alpha", "beta", "gamma", "level_factor", "trend_shift", "sse", "level", "trend"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seasons, status = [], [], []
            for values in batch.column("ys"):
                ys = np.array(values.as_py(), float)
                if len(ys) < 2 * SEASON:
                    rows.append([None] * 6 + [float(ys.mean()), 0.0])
                    seasons.append([1.0] * SEASON)
                    status.append("mean")
                    continue
                point, error, level, trend, season = fit(ys)
                rows.append([*point.tolist(), error, level, trend])
                seasons.append(season)
                status.append("fitted")
            fitted = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*keys, "last_date")], *fitted, pa.array(seasons, pa.list_(pa.float64())), pa.array(status)],
                names=[*keys, "last_date", *names, "seasons", "status"],
            )

    return arrays.mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}, seasons array<double>, status string")


def fitted_smoothing(series: DataFrame, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """Forecast of the fitted parameters, from the day after the last."""
    found = fitted_smoothing_fit(series, keys, date, sales)
    return found.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, F.date_add("last_date", F.col("_i")).alias("date"),
        ((F.col("level") + F.col("_i") * F.col("trend")) * F.element_at("seasons", (F.col("_i") - 1) % SEASON + 1)).alias("yhat"), "status",
    )
