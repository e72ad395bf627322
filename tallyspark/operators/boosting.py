"""Boosted trees, one model for each series, all series in one job.

Feature rows are made by Spark; a series is bounded by its days and is fitted whole in one task.  A task bins each
feature of a series by rank, then adds trees level by level: gradient sums and counts by (node, feature, bin) give the
gain of every split of a level at once.  Nothing is sampled, so a fit depends on the rows alone.  ``first_splits``
finds the first split of each series with joins and windows only, and the fits must agree with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.dates import time_features
from tallyspark.operators.forecasting import _daily
from tallyspark.operators.series import WINDOWS, ml_features

CALENDAR = ("day_of_week", "month", "quarter", "is_weekend", "is_month_end")
BINS = 64
LEAF_ROWS = 20
PATIENCE = 10
# Features are compared at six decimals and gains at nine, so that the noise of sums does not break ties.
VALUE_DIGITS, GAIN_DIGITS = 6, 9


@dataclass(frozen=True)
class BoostedForecast:
    """The fits of ``boosted_fit`` and what is read from them; ``left_out`` are the series without enough rows."""

    fits: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]

    @property
    def forecast(self) -> DataFrame:
        return self.fits.filter(F.col("status") == "fitted").select(*self.keys, "last_date", F.posexplode("yhat").alias("_i", "yhat")).select(
            *self.keys, F.date_add("last_date", F.col("_i") + 1).alias("ds"), "yhat",
        )

    @property
    def metrics(self) -> DataFrame:
        """Validation error of each series."""
        return self.fits.filter(F.col("status") == "fitted").select(*self.keys, F.lit("boosted trees").alias("model_type"), "mae", "rmse")

    @property
    def left_out(self) -> DataFrame:
        return self.fits.filter(F.col("status") != "fitted").select(*self.keys, "n_rows")

    @cached_property
    def importances(self) -> dict[str, float]:
        """Number of splits on each feature, over all series."""
        sums = self.fits.agg(*[F.sum(F.get("splits", F.lit(i))).alias(f"_{i}") for i in range(len(self.columns))]).first()
        return {c: float(sums[i] or 0) for i, c in enumerate(self.columns)}


def feature_columns(use_lags: bool = False) -> list[str]:
    rolling = [f"sales_rolling_{k}_{n}" for n in WINDOWS for k in ("mean", "std")]
    lags = [f"sales_lag_{k}" for k in (1, 7, 14, 30)] if use_lags else []
    return [*CALENDAR, *lags, *rolling]


def split_rows(features: DataFrame, keys: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """Flag the later part of every series, in time order, as validation."""
    order = W.partitionBy(*keys).orderBy("date")
    size = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return features.withColumn("is_validation", F.row_number().over(order) > F.floor(size * train_share))


def training_rows(daily: DataFrame, keys: Sequence[str] = (), min_rows: int = 50) -> DataFrame:
    """Days with all their features, of the series that have ``min_rows`` such days, with the validation flag."""
    usable = ml_features(daily, keys).dropna(subset=feature_columns(True)).withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return split_rows(usable.filter(F.col("_rows") >= min_rows).drop("_rows"), keys)


def future_features(daily: DataFrame, horizon: int, keys: Sequence[str]) -> DataFrame:
    """Calendar of the coming days with the recent level and spread of each series held constant."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date")))
    recent = daily.withColumn("_rn", newest).filter(F.col("_rn") <= max(WINDOWS))
    stats = recent.groupBy(*keys).agg(
        F.max("date").alias("last_date"), F.avg("sales").alias("_mean"),
        *[F.stddev_samp(F.when(F.col("_rn") <= n, F.col("sales"))).alias(f"sales_rolling_std_{n}") for n in WINDOWS],
    )
    # Without keys an empty series still gives one row of statistics.
    days = stats.filter(F.col("last_date").isNotNull()).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, F.date_add("last_date", F.col("_i")).alias("date"),
        *[F.col("_mean").alias(f"sales_rolling_mean_{n}") for n in WINDOWS], *[f"sales_rolling_std_{n}" for n in WINDOWS],
    )
    return time_features(days)


def first_splits(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], bins: int = BINS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The first split of the first tree of every series: feature, threshold (left is up to it) and share of variance gained.

    Rows are those of ``training_rows``.  Series without a split that leaves ``leaf_rows`` on both sides have no row.
    """
    keys = list(keys)
    fitted = rows.filter(~F.col("is_validation"))
    whole = W.partitionBy(*keys)
    centred = fitted.withColumns({"_n": F.count(F.lit(1)).over(whole), "_g": F.col("sales") - F.avg("sales").over(whole)})
    values = F.array(*[F.round(F.col(c).cast("double"), VALUE_DIGITS) for c in columns])
    long = centred.select(*keys, "_n", "_g", F.posexplode(values).alias("_feature", "_value"))
    place = F.rank().over(W.partitionBy(*keys, "_feature").orderBy("_value"))
    binned = long.withColumn("_bin", F.floor((place - 1) * bins / F.col("_n")))
    sums = binned.groupBy(*keys, "_feature", "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_g").alias("_s"), F.sum(F.col("_g") * F.col("_g")).alias("_ss"), F.max("_value").alias("threshold"),
    )
    feature = W.partitionBy(*keys, "_feature")
    left = feature.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    sides = sums.select(
        *keys, "_feature", "_bin", "threshold", F.sum("_c").over(left).alias("n_left"), F.sum("_s").over(left).alias("_left"),
        F.sum("_c").over(feature).alias("_n"), F.sum("_s").over(feature).alias("_all"), F.sum("_ss").over(feature).alias("_ss"),
    ).withColumn("n_right", F.col("_n") - F.col("n_left")).filter((F.col("n_left") >= leaf_rows) & (F.col("n_right") >= leaf_rows) & (F.col("_ss") > 0))
    right = F.col("_all") - F.col("_left")
    gain = F.col("_left") * F.col("_left") / F.col("n_left") + right * right / F.col("n_right") - F.col("_all") * F.col("_all") / F.col("_n")
    judged = sides.withColumn("gain", F.round(gain / F.col("_ss"), GAIN_DIGITS)).filter(F.col("gain") > 0)
    best = F.row_number().over(whole.orderBy(F.desc("gain"), "_feature", "_bin"))
    return judged.withColumn("_r", best).filter(F.col("_r") == 1).select(
        *keys, F.get(F.array(*[F.lit(c) for c in columns]), F.col("_feature")).alias("feature"), "threshold", "n_left", "n_right", "gain",
    )


def grow(cells: np.ndarray, gradient: np.ndarray, depth: int, bins: int, leaf_rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """One tree over binned rows: (feature, last left bin) of the nodes of each level, and the leaf values.

    A node that does not split sends all its rows left; its feature is -1.
    """
    n, width = cells.shape
    node, levels, spread = np.zeros(n, np.int64), [], float(gradient @ gradient)
    offsets, weights = np.arange(width) * bins, np.repeat(gradient, width)
    for level in range(depth):
        nodes = 1 << level
        flat = (node[:, None] * (width * bins) + offsets + cells).ravel()
        counts = np.bincount(flat, minlength=nodes * width * bins).reshape(nodes, width, bins).cumsum(2)
        sums = np.bincount(flat, weights, nodes * width * bins).reshape(nodes, width, bins).cumsum(2)
        total, rest = counts[:, :1, -1:], counts[:, :1, -1:] - counts
        whole = sums[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums**2 / counts + (whole - sums) ** 2 / rest - whole**2 / total
            gain = np.where((counts >= leaf_rows) & (rest >= leaf_rows), np.round(gain / spread, GAIN_DIGITS), 0.0)
        gain = gain.reshape(nodes, width * bins)
        pick = gain.argmax(1)
        splits = gain[np.arange(nodes), pick] > 0
        feature, cut = np.where(splits, pick // bins, -1), np.where(splits, pick % bins, bins)
        levels.append((feature, cut))
        node = descend(cells, node, feature, cut)
        if not splits.any():
            break
    leaves = 1 << len(levels)
    return levels, np.bincount(node, gradient, leaves) / np.maximum(np.bincount(node, minlength=leaves), 1)


def descend(cells: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return 2 * node + (cells[np.arange(len(node)), feature[node]] > cut[node])


def boost(
    train: np.ndarray, y: np.ndarray, valid: np.ndarray, y_valid: np.ndarray, coming: np.ndarray, rounds: int = 100, depth: int = 5,
    learning_rate: float = 0.05, bins: int = BINS, leaf_rows: int = LEAF_ROWS, patience: int = PATIENCE,
) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple[int, float] | None]:
    """Best round, predictions of the validation and of the coming rows, splits by feature, and the first split.

    Fitting ends when the mean absolute validation error has not fallen for ``patience`` rounds; the best round counts.
    """
    n, width = train.shape
    edges = []
    for column in train.T:
        ordered = np.sort(column)
        place = np.searchsorted(ordered, ordered) * bins // n
        upper = np.full(bins, -np.inf)
        np.maximum.at(upper, place, ordered)
        edges.append(np.maximum.accumulate(upper))

    def binned(rows: np.ndarray) -> np.ndarray:
        # The first bin that reaches the value; beyond all of them a value is right of every cut.
        return np.stack([np.minimum(np.searchsorted(e, c), bins - 1) for e, c in zip(edges, rows.T, strict=True)], axis=1)

    parts = [binned(train), binned(valid), binned(coming)]
    fits = [np.full(len(p), y.mean()) for p in parts]
    splits, first = np.zeros(width, np.int64), None
    best = (np.inf, 0, fits[1], fits[2], splits)
    for turn in range(1, rounds + 1):
        gradient = y - fits[0]
        if not gradient @ gradient > 0:
            break
        levels, values = grow(parts[0], gradient, depth, bins, leaf_rows)
        if turn == 1 and levels and levels[0][0][0] >= 0:
            first = (int(levels[0][0][0]), float(edges[levels[0][0][0]][levels[0][1][0]]))
        for i, cells in enumerate(parts):
            node = np.zeros(len(cells), np.int64)
            for feature, cut in levels:
                node = descend(cells, node, feature, cut)
            fits[i] = fits[i] + learning_rate * values[node]
        splits = splits + sum(np.bincount(f[f >= 0], minlength=width) for f, _ in levels)
        error = float(np.abs(y_valid - fits[1]).mean())
        if error < best[0]:
            best = (error, turn, fits[1], fits[2], splits)
        elif turn - best[1] >= patience:
            break
    return best[1], best[2], best[3], best[4], first


def boosted_fit(
    series: DataFrame, horizon: int = 30, keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    rounds: int = 100, depth: int = 5, learning_rate: float = 0.05, min_rows: int = 50, use_lags: bool = False,
) -> DataFrame:
    """One row for every series: its fit on the first 80 % of its usable days, its error on the rest, and its coming days.

    ``status`` is ``fitted``, or ``too_short`` for less than ``min_rows`` days with all features; ``n_rows`` counts them.
    """
    keys = list(keys)
    daily = _daily(series, keys, date, sales).withColumnRenamed("y", "sales")
    columns = feature_columns(use_lags)
    coming = future_features(daily, horizon, keys)
    if use_lags:
        coming = coming.withColumns({f"sales_lag_{k}": F.col("sales_rolling_mean_30") for k in (1, 7, 14, 30)})
    values = F.array(*[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), VALUE_DIGITS) for c in columns]).alias("features")
    # Coming days have no flag; a series without usable days still has coming days, and so a row.
    usable = split_rows(ml_features(daily, keys).dropna(subset=feature_columns(True)), keys)
    rows = usable.select(*keys, "date", "sales", "is_validation", values).unionByName(
        coming.select(*keys, "date", F.lit(None).cast("double").alias("sales"), F.lit(None).cast("boolean").alias("is_validation"), values)
    )
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema.fields)
    schema = (
        f"{kinds}last_date date, n_rows bigint, status string, best_round int, mae double, rmse double, first_feature string, "
        "first_threshold double, splits array<bigint>, yhat array<double>"
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        known, ahead = rows[rows["sales"].notna()], rows[rows["sales"].isna()]
        start = ahead["date"].iloc[0] - pd.Timedelta(days=1)
        out = {c: [rows[c].iloc[0]] for c in keys}
        if len(known) < min_rows:
            empty = {c: [None] for c in ("best_round", "mae", "rmse", "first_feature", "first_threshold", "splits", "yhat")}
            return pd.DataFrame({**out, "last_date": [start], "n_rows": [len(known)], "status": ["too_short"], **empty})
        late = known["is_validation"].to_numpy(bool)
        x, y = np.stack(known["features"].to_numpy()), known["sales"].to_numpy(float)
        turn, guess, yhat, splits, first = boost(x[~late], y[~late], x[late], y[late], np.stack(ahead["features"].to_numpy()), rounds, depth, learning_rate)
        miss = y[late] - guess
        return pd.DataFrame({
            **out, "last_date": [start], "n_rows": [len(known)], "status": ["fitted"], "best_round": [turn],
            "mae": [float(np.abs(miss).mean())], "rmse": [float(np.sqrt((miss * miss).mean()))],
            "first_feature": [columns[first[0]] if first else None], "first_threshold": [first[1] if first else None],
            "splits": [splits.tolist()], "yhat": [np.maximum(yhat, 0.0).tolist()],
        })

    return rows.groupBy(*keys).applyInPandas(fit, schema)


def boosted_forecast(
    series: DataFrame, horizon: int = 30, keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    rounds: int = 100, depth: int = 5, learning_rate: float = 0.05, min_rows: int = 50, use_lags: bool = False,
) -> BoostedForecast:
    """Fit one model for each series, stop early on the last 20 % of its days, and predict its coming days (never below 0).

    Series without ``min_rows`` usable days are not forecast; ``left_out`` lists them.  ``use_lags`` adds the lag features
    to the fit; the coming days then see the recent mean in their place.
    """
    daily = _daily(series, keys, date, sales).withColumnRenamed("y", "sales")
    if training_rows(daily, keys, min_rows).isEmpty():
        raise ValueError(f"Need at least {min_rows} days of data in a series for a boosted forecast")
    fits = boosted_fit(series, horizon, keys, date, sales, rounds, depth, learning_rate, min_rows, use_lags)
    return BoostedForecast(fits, tuple(keys), tuple(feature_columns(use_lags)))
