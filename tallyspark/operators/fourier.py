"""Piecewise-linear trend with change points and Fourier seasons, for all series at once.

The trend is a line whose slope may change at points spread over the first 80 % of a series; weekly and yearly waves
scale with the level of a plain line, so seasons are multiplicative while the model stays linear.  Spark sums the
products of all columns for each series (its Gram matrix); a ridge solution of these sums gives the weights, and the
days are predicted from the joined weights.  The band widens with the slope changes seen in the history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators.forecasting import FLOOR, INTERVAL_Z, _daily, _with_future

CHANGES = 8
WEEK_WAVES = 3
YEAR_WAVES = 4
REACH = 0.8  # Share of the history that change points are spread over.
# Penalties per row on slope changes and on waves, for values in units of the series mean.
CHANGE_PENALTY = 0.001
WAVE_PENALTY = 0.0005
SIZE = 2 + CHANGES + 2 * (WEEK_WAVES + YEAR_WAVES)
PENALTIES = np.array([1e-9, 1e-9, *[CHANGE_PENALTY] * CHANGES, *[WAVE_PENALTY] * (SIZE - 2 - CHANGES)])


def _columns() -> list[Column]:
    """The regressors of a day: level, slope, slope changes, weekly and yearly waves."""
    u, level = F.col("_u"), F.col("_line")
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")
    out = [F.lit(1.0), u, *[F.greatest(u - F.lit(REACH * (k + 1) / (CHANGES + 1)), F.lit(0.0)) for k in range(CHANGES)]]
    for period, waves in ((7.0, WEEK_WAVES), (365.25, YEAR_WAVES)):
        for k in range(1, waves + 1):
            angle = day * F.lit(2 * math.pi * k / period)
            out += [level * F.cos(angle), level * F.sin(angle)]
    return out


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ridge solutions, the residual deviation and the mean slope change of a batch of Gram matrices."""
    i, j = np.triu_indices(SIZE + 1)
    for batch in batches:
        flat = np.array(batch.column("_m").to_pylist(), float).reshape(batch.num_rows, -1)
        n = batch.column("n").to_numpy().astype(float)
        gram = np.zeros((len(flat), SIZE + 1, SIZE + 1))
        gram[:, i, j] = gram[:, j, i] = flat
        inner, target = gram[:, :SIZE, :SIZE], gram[:, :SIZE, SIZE]
        raised = inner + n[:, None, None] * np.diag(PENALTIES)
        half = np.linalg.cholesky(raised)
        found = np.linalg.solve(half.transpose(0, 2, 1), np.linalg.solve(half, target[..., None]))[..., 0]
        error = gram[:, SIZE, SIZE] - 2 * (found * target).sum(axis=1) + np.einsum("bi,bij,bj->b", found, inner, found)
        noise = np.sqrt(np.maximum(error, 0) / np.maximum(n - 1, 1))
        change = np.abs(found[:, 2 : 2 + CHANGES]).mean(axis=1)
        columns = [c for name, c in zip(batch.schema.names, batch.columns) if name not in ("_m", "n")]
        names = [c for c in batch.schema.names if c not in ("_m", "n")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found), pa.list_(pa.float64())), pa.array(noise), pa.array(change)], names=[*names, "weights", "noise", "change"])


def _placed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days in shares of the history, values in units of the mean, and the level of a plain line."""
    whole = W.partitionBy(*keys)
    known = F.col("y").isNotNull()
    first = F.min("date").over(whole)
    span = F.greatest(F.datediff(F.max(F.when(known, F.col("date"))).over(whole), first), F.lit(1)).cast("double")
    rows = rows.select("*", (F.datediff("date", first) / span).alias("_u"), span.alias("_span"), F.avg("y").over(whole).alias("_mean"))
    rows = rows.withColumn("_unit", F.when(F.abs("_mean") > 1e-8, F.abs("_mean")).otherwise(1.0)).withColumn("_v", F.col("y") / F.col("_unit"))
    rows = rows.select(
        "*", F.coalesce(F.regr_slope("_v", "_u").over(whole), F.lit(0.0)).alias("_slope"),
        F.avg(F.when(known, F.col("_u"))).over(whole).alias("_at"), F.avg("_v").over(whole).alias("_base"),
    )
    return rows.withColumn("_line", F.greatest(F.col("_base") + F.col("_slope") * (F.col("_u") - F.col("_at")), F.lit(FLOOR)))


def fourier_trend_fit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, weights, noise, change`` of days that ``_placed`` has prepared."""
    named = rows.filter(F.col("y").isNotNull()).select(*keys, *[c.alias(f"_x{k}") for k, c in enumerate(_columns())], F.col("_v").alias(f"_x{SIZE}"))
    products = [F.sum(F.col(f"_x{a}") * F.col(f"_x{b}")) for a in range(SIZE + 1) for b in range(a, SIZE + 1)]
    sums = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("_m"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return sums.mapInArrow(_fit, f"{kinds}, weights array<double>, noise double, change double")


def fourier_trend(series: DataFrame, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """History and ``horizon`` future days of every series with ``yhat`` and a 95 % band; one day of data is enough."""
    keys = list(keys)
    rows = _placed(_with_future(_daily(series, keys, date, sales), keys, horizon), keys)
    placed = rows.join(fourier_trend_fit(rows, keys), keys)
    weight = F.col("weights")
    value = sum((weight[k] * c for k, c in enumerate(_columns()) if k), weight[0])
    # Future slope changes: as many in a stretch of time as change points in the history, of the mean size seen.
    ahead = F.greatest(F.col("_u") - 1, F.lit(0.0))
    drift = F.lit(CHANGES / REACH * 2 / 3) * F.col("change") * F.col("change") * ahead * ahead * ahead
    spread = INTERVAL_Z * F.sqrt(F.col("noise") * F.col("noise") + drift)
    out = placed.select(*keys, "date", "y", (value * F.col("_unit")).alias("yhat"), (spread * F.col("_unit")).alias("_spread"), "is_future")
    return out.select(*keys, "date", "y", "yhat", (F.col("yhat") - F.col("_spread")).alias("yhat_lower"), (F.col("yhat") + F.col("_spread")).alias("yhat_upper"), "is_future")


def change_points(series: DataFrame, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """Per series and change point: its day, and the slope change there in sales per day."""
    keys = list(keys)
    rows = _placed(_with_future(_daily(series, keys, date, sales), keys, 0), keys)
    facts = rows.groupBy(*keys).agg(F.min("date").alias("_first"), F.first("_span").alias("_span"), F.first("_unit").alias("_unit"))
    places = F.array(*[F.lit(REACH * (k + 1) / (CHANGES + 1)) for k in range(CHANGES)])
    fit = fourier_trend_fit(rows, keys).join(facts, keys).select("*", F.posexplode(places).alias("_k", "_place"))
    return fit.select(
        *keys, F.expr("date_add(_first, cast(ceil(_place * _span) as int))").alias("date"),
        (F.element_at("weights", F.col("_k") + 3) * F.col("_unit") / F.col("_span")).alias("slope_change"),
    )
