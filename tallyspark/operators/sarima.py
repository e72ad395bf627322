"""Seasonal autoregressions with moving averages, for all series at once.

Every step is a sum over a series' rows, so a series is read row by row and never gathered: Spark sums the products
of lagged columns (a moment vector for each series), and small systems of these sums are solved for whole batches of
series.  The steps are a unit-root test that chooses the order of differencing, a long autoregression whose
residuals stand in for the unseen shocks, and a regression on lagged values and lagged residuals (two-stage
regression) for every order of the grid, judged by the information criterion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product as cartesian

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numeric import ratio
from tallyspark.operators.forecasting import SEASON, _daily
from tallyspark.operators.rollups import fill_days

MOST = 5  # Largest order of lagged values and of lagged shocks.
LONG = 8  # Lags of the autoregression that estimates the shocks; covers a week and a day.
MIN_ROWS = 5
LAGS = (*range(1, MOST + 1), SEASON)
# 5 % point of the unit-root statistic with a constant, as a polynomial in 1 / n.
ADF_POINT = (-2.86154, -2.8903, -4.234, -40.04)
# Orders (p, q, P, Q); the seasonal ones say whether lag 7 takes part.
ORDERS = tuple(cartesian(range(MOST + 1), range(MOST + 1), (0, 1), (0, 1)))
# Entries of the second moment vector: the value, its lags, the lagged shocks.
NAMES = ("w", *[f"w{k}" for k in LAGS], *[f"e{k}" for k in LAGS])


def members(p: int, q: int, seasonal_p: int, seasonal_q: int) -> list[int]:
    """Places in ``NAMES`` of the regressors of an order."""
    n = len(LAGS)
    return [*range(1, p + 1), *([n] if seasonal_p else []), *range(n + 1, n + 1 + q), *([2 * n] if seasonal_q else [])]


def unit_root(filled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: days, unit-root statistics of the values and of their changes, and the order of differencing.

    The statistic is that of the lagged level in the regression of the change on a constant, the lagged level and
    the change before.  A series that cannot be tested (constant, or too short) is not differenced.
    """
    ordered = W.partitionBy(*keys).orderBy("date")
    rows = filled.withColumns({f"_l{k}": F.lag("y", k).over(ordered) for k in range(1, 4)})
    levels = {0: (F.col("y"), F.col("_l1"), F.col("_l2")), 1: (F.col("y") - F.col("_l1"), F.col("_l1") - F.col("_l2"), F.col("_l2") - F.col("_l3"))}
    moments = [F.count(F.lit(1)).alias("n_days")]
    for d, (a, b, c) in levels.items():
        full = c.isNotNull()
        z, x, v = F.when(full, a - b), F.when(full, b), F.when(full, b - c)
        moments += [
            F.count(v).cast("double").alias(f"_n{d}"), F.var_pop(z).alias(f"_zz{d}"), F.var_pop(x).alias(f"_xx{d}"), F.var_pop(v).alias(f"_vv{d}"),
            F.covar_pop(z, x).alias(f"_zx{d}"), F.covar_pop(z, v).alias(f"_zv{d}"), F.covar_pop(x, v).alias(f"_xv{d}"),
        ]
    stats = rows.groupBy(*keys).agg(*moments)

    def statistic(d: int) -> tuple[Column, Column]:
        n, zz, xx, vv, zx, zv, xv = (F.col(f"_{m}{d}") for m in ("n", "zz", "xx", "vv", "zx", "zv", "xv"))
        det = xx * vv - xv * xv
        rho, gamma = (zx * vv - zv * xv) / det, (zv * xx - zx * xv) / det
        error = (zz - rho * zx - gamma * zv) * n / (n - 3)
        usable = (n > 6) & (det > F.lit(1e-9) * xx * vv) & (error > 1e-12 * zz)
        t = F.when(usable, rho / F.sqrt(error * vv / (det * n)))
        point = F.lit(ADF_POINT[0]) + ADF_POINT[1] / n + ADF_POINT[2] / (n * n) + ADF_POINT[3] / (n * n * n)
        return t, t > point

    (t0, root0), (t1, root1) = statistic(0), statistic(1)
    d = F.when(F.coalesce(root0, F.lit(False)), F.when(F.coalesce(root1, F.lit(False)), 2).otherwise(1)).otherwise(0)
    return stats.select(*keys, "n_days", t0.alias("adf"), t1.alias("adf_changes"), d.alias("d"))


def _products(names: Sequence[str]) -> Column:
    """The moment vector of columns: sums of all products, by row."""
    return F.array(*[F.sum(F.col(f"_{a}") * F.col(f"_{b}")) for i, a in enumerate(names) for b in names[i:]])


def _gram(flat: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = out[:, j, i] = flat
    return out


def solve(gram: np.ndarray, places: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of entry 0 on the entries ``places``, for a batch of moment matrices: coefficients and squared error."""
    target = gram[:, places, 0]
    inner = gram[:, places][:, :, places].copy()
    diagonal = np.arange(len(places))
    # Slightly raised, so that entries without variation cannot make it singular.
    inner[:, diagonal, diagonal] = inner[:, diagonal, diagonal] * (1 + 1e-9) + 1e-9
    found = np.linalg.solve(inner, target[..., None])[..., 0] if len(places) else target
    error = gram[:, 0, 0] - 2 * (found * target).sum(axis=1) + np.einsum("bi,bij,bj->b", found, gram[:, places][:, :, places], found)
    return found, error


def _shocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coefficients of the long autoregression from its moments."""
    for batch in batches:
        flat = np.array([[0.0 if v is None else v for v in row] for row in batch.column("_m").to_pylist()]).reshape(batch.num_rows, -1)
        found, _ = solve(_gram(flat, LONG + 1), list(range(1, LONG + 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(found), pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "_phi"])


def search(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order with the least criterion for each moment matrix: its number, its criterion, coefficients by place."""
    best = np.full(len(gram), -1)
    least = np.full(len(gram), np.inf)
    weights = np.zeros((len(gram), len(NAMES)))
    for number, order in enumerate(ORDERS):
        places = members(*order)
        found, error = solve(gram, places)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = n * np.log(np.maximum(error / n, 1e-12)) + 2 * (len(places) + 1)
        better = (n >= 3 * (len(places) + 1)) & (value < least)
        best[better], least[better] = number, value[better]
        weights[better] = 0
        weights[np.ix_(better, places)] = found[better]
    return best, least, weights


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = len(NAMES)
        flat = np.array([[0.0 if v is None else v for v in row] for row in batch.column("_m").to_pylist()]).reshape(batch.num_rows, size * (size + 1) // 2)
        n = batch.column("n_used").to_numpy().astype(float)
        best, least, weights = search(_gram(flat, size), n)
        orders = np.array([*ORDERS, (0, 0, 0, 0)])[best]
        columns = {c: v for c, v in zip(batch.schema.names, batch.columns) if c != "_m"}
        for i, name in enumerate(("p", "q", "seasonal_p", "seasonal_q")):
            columns[name] = pa.array(orders[:, i], pa.int32())
        columns["aic"] = pa.array(least, mask=best < 0)
        columns["weights"] = pa.array(list(weights[:, 1:]), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict(columns)


def sarima_fit(series: DataFrame, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """One row for every series: orders, criterion, weights of the lags and what is needed to roll forward.

    ``weights`` has the coefficients of lags 1 to 5 and 7 of the value and then of the shock, 0 where they take no
    part.  ``status`` is ``fitted``, ``mean`` (too few rows for any order) or ``too_short`` (under 5 days with data,
    for which no forecast is made).  Gaps between the days of a series count as 0.
    """
    keys = list(keys)
    daily = _daily(series, keys, date, sales)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in daily.select(*keys).schema.fields)
    known = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_known"))
    filled = fill_days(daily, keys, "date", "y")
    ordered = W.partitionBy(*keys).orderBy("date")
    rows = filled.join(unit_root(filled, keys), keys)
    y1, y2 = F.lag("y", 1).over(ordered), F.lag("y", 2).over(ordered)
    rows = rows.withColumns({"_y1": y1, "_y2": y2})
    value = F.when(F.col("d") == 0, F.col("y")).when(F.col("d") == 1, F.col("y") - F.col("_y1")).otherwise(F.col("y") - 2 * F.col("_y1") + F.col("_y2"))
    rows = rows.withColumn("_raw", value)
    rows = rows.withColumn("_mu", F.coalesce(F.avg("_raw").over(W.partitionBy(*keys)), F.lit(0.0)))
    rows = rows.withColumn("_w", F.col("_raw") - F.col("_mu"))
    rows = rows.withColumns({f"_w{k}": F.lag("_w", k).over(ordered) for k in range(1, LONG + 1)})

    long_names = ["w", *[f"w{k}" for k in range(1, LONG + 1)]]
    complete = rows.filter(F.col(f"_w{LONG}").isNotNull())
    phi = complete.groupBy(*keys).agg(_products(long_names).alias("_m")).mapInArrow(_shocks, f"{kinds}, _phi array<double>")
    rows = rows.join(phi, keys, "left")
    guess = sum((F.col("_phi")[k - 1] * F.col(f"_w{k}") for k in range(2, LONG + 1)), F.col("_phi")[0] * F.col("_w1"))
    rows = rows.withColumn("_e", F.col("_w") - guess)
    rows = rows.withColumns({f"_e{k}": F.lag("_e", k).over(ordered) for k in range(1, SEASON + 1)})

    usable = F.col(f"_e{SEASON}").isNotNull()
    recent = F.struct(
        *[F.col("y").alias("y0"), F.col("_y1").alias("y1"), F.col("_mu").alias("mu")],
        F.array("_w", *[f"_w{k}" for k in range(1, SEASON)]).alias("w"), F.array("_e", *[f"_e{k}" for k in range(1, SEASON)]).alias("e"),
    )
    moments = rows.groupBy(*keys).agg(
        F.max("date").alias("last_date"), F.first("n_days").alias("n_days"), F.first("adf").alias("adf"), F.first("adf_changes").alias("adf_changes"), F.first("d").alias("d"),
        F.count_if(usable).alias("n_used"), F.max_by(recent, "date").alias("recent"),
        F.array(*[F.sum(F.when(usable, F.col(f"_{a}") * F.col(f"_{b}"))) for i, a in enumerate(NAMES) for b in NAMES[i:]]).alias("_m"),
    )
    recent_kind = "struct<y0: double, y1: double, mu: double, w: array<double>, e: array<double>>"
    schema = (
        f"{kinds}, last_date date, n_days long, adf double, adf_changes double, d int, n_used long, recent {recent_kind}, "
        "p int, q int, seasonal_p int, seasonal_q int, aic double, weights array<double>"
    )
    fit = moments.mapInArrow(_chosen, schema).join(known, keys)
    status = F.when(F.col("n_known") < MIN_ROWS, "too_short").when(F.col("aic").isNull(), "mean").otherwise("fitted")
    return fit.withColumn("status", status)


def contract(weights: np.ndarray, lags: Sequence[int], least: float = 0.98) -> np.ndarray:
    """Weights whose recursion dies away: lag k is scaled by f^k where the largest root reaches 1."""
    size = max(lags)
    row = np.zeros(size)
    row[np.array(lags) - 1] = weights
    if not row.any():
        return weights
    radius = np.abs(np.linalg.eigvals(np.vstack([row, np.eye(size)[:-1]]))).max()
    return weights if radius < 0.999 else weights * (least / radius) ** np.array(lags)


def roll(weights: np.ndarray, w: Sequence[float], e: Sequence[float], horizon: int) -> list[float]:
    """The next values of a centred series from its latest values and shocks (newest first)."""
    n = len(LAGS)
    ar, ma = contract(weights[:n], LAGS), weights[n:]
    values, shocks = list(w), list(e)
    for _ in range(horizon):
        ahead = sum(a * values[k - 1] + b * shocks[k - 1] for a, b, k in zip(ar, ma, LAGS))
        values.insert(0, float(ahead))
        shocks.insert(0, 0.0)
    return values[horizon - 1 :: -1]


def sarima(series: DataFrame, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """Forecast from the day after the last, and the ``status`` of each series; a series that is too short gives one row with null."""
    keys = list(keys)
    fit = sarima_fit(series, keys, date, sales)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fit.select(*keys).schema.fields)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for row in batch.select(["status", "d", "recent", "weights"]).to_pylist():
                if row["status"] == "too_short":
                    paths.append(None)
                    continue
                recent = row["recent"]
                w, e = ([v or 0.0 for v in recent[c]] for c in "we")
                path = np.array(roll(np.array(row["weights"]), w, e, horizon)) + recent["mu"]
                if row["d"] == 2:
                    path = (recent["y0"] - (recent["y1"] or 0.0)) + np.cumsum(path)
                if row["d"] >= 1:
                    path = recent["y0"] + np.cumsum(path)
                paths.append(path)
            columns = [batch.column(k) for k in (*keys, "last_date", "status")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, pa.list_(pa.float64()))], names=[*keys, "last_date", "status", "path"])

    paths = fit.select(*keys, "last_date", "status", "d", "recent", "weights").mapInArrow(ahead, f"{kinds}, last_date date, status string, path array<double>")
    return paths.select(*keys, "last_date", "status", F.posexplode_outer("path").alias("_i", "yhat")).select(
        *keys, F.date_add("last_date", F.col("_i") + 1).alias("date"), "yhat", "status",
    )


def shares(fit: DataFrame) -> DataFrame:
    """How many series have each order, most frequent first."""
    orders = ["d", "p", "q", "seasonal_p", "seasonal_q", "status"]
    total = fit.select(F.count(F.lit(1)).alias("n")).scalar()
    return fit.groupBy(*orders).agg(F.count(F.lit(1)).alias("n_series")).withColumn("share", ratio(F.col("n_series"), total)).orderBy(F.desc("n_series"), *orders)
