"""Forecasts of all series at once.

Every model takes a daily table (series keys, date, sales) and fits each series
inside one shuffle on its keys.  A series is at most one row per day, so what a
task holds for one key is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product as cartesian

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numeric import ratio
from tallyspark.operators.rollups import fill_days
from tallyspark.operators.series import accuracy_metrics
from tallyspark.schemas import require_columns

# Fixed value: two-sided 95 % normal interval.
INTERVAL_Z = 1.96
# Divisors are floored at this share of the series mean, so that runs of zero days stay finite.
FLOOR = 0.05


def _daily(series: DataFrame, keys: Sequence[str], date: str, sales: str, partitions: int | None = None) -> DataFrame:
    """Clean daily input: readable dates and values, one row per series and day.

    Many series need ``partitions`` that grow with their rows (``rollups.partitions_for``), where these are more than the session's.
    """
    require_columns(series, [*keys, date, sales])
    rows = series.select(*keys, F.to_date(date).alias("date"), F.col(sales).alias("_y"))
    rows = rows.filter(F.col("date").isNotNull() & F.col("_y").isNotNull())
    daily = rows.groupBy(*keys, "date").agg(F.sum("_y").cast("double").alias("y"))
    if not keys:
        return daily
    # Fitting costs far more per byte than a scan, so the series keep all partitions
    # instead of being packed together by size; every later window and grouping reuses them.
    return daily.repartition(max(partitions or 0, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _with_future(daily: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """History plus ``horizon`` empty future days per series, unfolded from the last row of each."""
    ordered = W.partitionBy(*keys).orderBy("date")
    is_last = F.lead("date").over(ordered).isNull()
    ahead = F.when(is_last, F.sequence(F.lit(0), F.lit(horizon))).otherwise(F.array(F.lit(0)))
    rows = daily.select(*keys, F.col("date").alias("_d"), F.col("y").alias("_y"), ahead.alias("_ahead"))
    return rows.select(*keys, "_d", "_y", F.explode("_ahead").alias("_k")).select(
        *keys, F.date_add("_d", F.col("_k")).alias("date"), F.when(F.col("_k") == 0, F.col("_y")).alias("y"),
        (F.col("_k") > 0).alias("is_future"),
    )


def trend_seasonal(
    series: DataFrame, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales",
    min_rows: int = 2, partitions: int | None = None,
) -> DataFrame:
    """Linear trend times weekday index times month index, with a 95 % band.

    Returns history and future rows, as a multiplicative decomposition fitted per
    series: least-squares trend, then the ratio of sales to trend per weekday,
    then per month what remains.  All of it is window arithmetic over one shuffle.
    ``partitions`` of that shuffle should grow with the rows where series are many.
    """
    return _fit_trend_seasonal(_with_future(_daily(series, keys, date, sales, partitions), keys, horizon), keys, min_rows)


def _fit_trend_seasonal(
    rows: DataFrame, keys: Sequence[str], min_rows: int = 2, carry: Sequence[str] = ("is_future",),
) -> DataFrame:
    """Fit on the rows with ``y``; rows without are only predicted.  ``carry`` columns pass through."""
    whole = W.partitionBy(*keys)
    t = F.datediff("date", F.min("date").over(whole)).cast("double")
    rows = rows.select("*", t.alias("_t"))
    known = F.col("y").isNotNull()
    rows = rows.select(
        "*", F.count("y").over(whole).alias("_n"), F.avg("y").over(whole).alias("_mean"),
        F.coalesce(F.regr_slope("y", "_t").over(whole), F.lit(0.0)).alias("_slope"),
        F.avg(F.when(known, F.col("_t"))).over(whole).alias("_tbar"),
    ).filter(F.col("_n") >= min_rows)
    floor = F.greatest(F.lit(FLOOR) * F.abs("_mean"), F.lit(1e-8))
    trend = F.greatest(F.col("_mean") + F.col("_slope") * (F.col("_t") - F.col("_tbar")), floor)
    rows = rows.select("*", trend.alias("_trend"))

    def index(base: Column, *by: Column) -> Column:
        w = W.partitionBy(*keys, *by)
        return F.coalesce(ratio(F.sum("y").over(w), F.sum(F.when(known, base)).over(w)), F.lit(1.0))

    rows = rows.select("*", index(F.col("_trend"), F.weekday("date")).alias("_week"))
    # A weekday that never sold predicts 0; its index is floored where it divides.
    base = F.col("_trend") * F.greatest(F.col("_week"), F.lit(FLOOR))
    rows = rows.select("*", (F.col("_trend") * F.col("_week") * index(base, F.month("date"))).alias("yhat"))
    spread = F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat")).over(whole), F.lit(0.0)) * INTERVAL_Z
    return rows.select(
        *keys, "date", "y", "yhat", (F.col("yhat") - spread).alias("yhat_lower"), (F.col("yhat") + spread).alias("yhat_upper"),
        *carry,
    )


# --- autoregression ------------------------------------------------------------------------------------

def ar_candidates(
    series: DataFrame, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales", min_rows: int = 5,
) -> DataFrame:
    """Least-squares autoregressions of every series on lags {1} and {1, 7}, plain and differenced, plus the mean.

    One row per series with the candidate array, the observations compared on
    and the recent values needed to roll forward.  Coefficients are closed forms
    of population covariances, so fitting is one aggregate.
    """
    daily = _daily(series, keys, date, sales)
    # The minimum counts the days with data, before gaps are filled.
    sized = daily.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter(F.col("_n") >= min_rows)
    filled = fill_days(sized, keys, "date", "y")
    ordered = W.partitionBy(*keys).orderBy("date")
    lags = {f"l{k}": F.lag("y", k).over(ordered) for k in range(1, 9)}
    rows = filled.withColumns(lags).withColumn("_newest", F.lead("date").over(ordered).isNull())
    full = F.col("l8").isNotNull()
    variables = {
        0: (F.col("y"), F.col("l1"), F.col("l7")),
        1: (F.col("y") - F.col("l1"), F.col("l1") - F.col("l2"), F.col("l7") - F.col("l8")),
    }
    moments = [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(full).cast("double").alias("m"), F.avg("y").alias("mean_y"),
        F.max("date").alias("last_date"),
        F.max_by("y", F.when(F.col("_newest"), F.col("date"))).alias("r0"),
        *[F.max_by(f"l{k}", F.when(F.col("_newest"), F.col("date"))).alias(f"r{k}") for k in range(1, 8)],
    ]
    for d, (z, x1, x7) in variables.items():
        zz, a, b = (F.when(full, v) for v in (z, x1, x7))
        moments += [
            F.avg(zz).alias(f"z{d}"), F.avg(a).alias(f"a{d}"), F.avg(b).alias(f"b{d}"), F.var_pop(zz).alias(f"szz{d}"),
            F.var_pop(a).alias(f"saa{d}"), F.var_pop(b).alias(f"sbb{d}"), F.covar_pop(a, b).alias(f"sab{d}"),
            F.covar_pop(zz, a).alias(f"sza{d}"), F.covar_pop(zz, b).alias(f"szb{d}"),
        ]
    stats = rows.groupBy(*keys).agg(*moments)
    m = F.col("m")
    forms = [(d, lag7) for d in variables for lag7 in (False, True)]

    def phis(d: int, lag7: bool) -> list[Column]:
        saa, sbb, sab, sza, szb = (F.col(f"{s}{d}") for s in ("saa", "sbb", "sab", "sza", "szb"))
        tag = f"{d}{int(lag7)}"
        if not lag7:
            return [F.when(saa > 0, ratio(sza, saa)).alias(f"p1_{tag}"), F.lit(0.0).alias(f"p7_{tag}")]
        det = saa * sbb - sab * sab
        usable = det > F.lit(1e-9) * saa * sbb
        return [
            F.when(usable, ratio(sza * sbb - szb * sab, det)).alias(f"p1_{tag}"),
            F.when(usable, ratio(szb * saa - sza * sab, det)).alias(f"p7_{tag}"),
        ]

    def criterion(d: int, lag7: bool) -> Column:
        tag, terms = f"{d}{int(lag7)}", 3 if lag7 else 2
        error = F.col(f"szz{d}") - F.col(f"p1_{tag}") * F.col(f"sza{d}") - F.col(f"p7_{tag}") * F.col(f"szb{d}")
        return F.when(m >= terms + 2, m * F.ln(F.greatest(error, F.lit(1e-12))) + 2 * terms).alias(f"aic_{tag}")

    def candidate(d: int, lag7: bool) -> Column:
        tag = f"{d}{int(lag7)}"
        phi1, phi7, aic = F.col(f"p1_{tag}"), F.col(f"p7_{tag}"), F.col(f"aic_{tag}")
        return F.when((phi1 + aic).isNotNull(), F.struct(
            aic.alias("aic"), F.lit(f"d{d}_lag1{'_7' if lag7 else ''}").alias("form"), F.lit(d).alias("d"),
            (F.col(f"z{d}") - phi1 * F.col(f"a{d}") - phi7 * F.col(f"b{d}")).alias("c"), phi1.alias("phi1"), phi7.alias("phi7"),
        ))

    mean_only = F.struct(
        F.when(m >= 3, m * F.ln(F.greatest(F.col("szz0"), F.lit(1e-12))) + 2).otherwise(F.lit(0.0)).alias("aic"),
        F.lit("mean").alias("form"), F.lit(0).alias("d"),
        F.when(m >= 3, F.col("z0")).otherwise(F.col("mean_y")).alias("c"), F.lit(0.0).alias("phi1"), F.lit(0.0).alias("phi7"),
    )
    fitted = stats.select("*", *[c for f in forms for c in phis(*f)])
    judged = fitted.select("*", *[criterion(*f) for f in forms])
    options = F.array_compact(F.array(*[candidate(*f) for f in forms], mean_only))
    recent = F.array(*[F.coalesce(F.col(f"r{k}"), F.lit(0.0)) for k in range(7, -1, -1)])
    return judged.select(*keys, "last_date", "n_rows", "m", options.alias("candidates"), recent.alias("recent"))


def ar_coefficients(
    series: DataFrame, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales", min_rows: int = 5,
) -> DataFrame:
    """The candidate with the smallest information criterion, per series."""
    fits = ar_candidates(series, keys, date, sales, min_rows)
    return fits.select(*keys, "last_date", "recent", F.array_min("candidates").alias("fit")).select(*keys, "last_date", "recent", "fit.*")


def autoregressive(
    series: DataFrame, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales", min_rows: int = 5,
    with_status: bool = False,
) -> DataFrame:
    """Forecast of the chosen autoregression, rolled forward day by day from the day after the last.

    With ``with_status`` no series is left out: ``status`` is ``fitted``, and a series of under ``min_rows`` days with
    data gives one row with status ``too_short`` and no forecast.
    """
    fit = ar_coefficients(series, keys, date, sales, min_rows)
    levels = F.col("recent")
    changes = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.element_at(levels, i + 1) - F.element_at(levels, i))
    start = F.struct(
        F.when(F.col("d") == 1, changes).otherwise(F.slice(levels, 2, 7)).alias("w"),
        F.element_at(levels, -1).alias("level"), F.array().cast("array<double>").alias("out"),
    )

    def step(state: Column, _: Column) -> Column:
        z = F.col("c") + F.col("phi1") * F.element_at(state["w"], 7) + F.col("phi7") * F.element_at(state["w"], 1)
        level = F.when(F.col("d") == 1, state["level"] + z).otherwise(z)
        return F.struct(
            F.concat(F.slice(state["w"], 2, 6), F.array(z)).alias("w"), level.alias("level"),
            F.concat(state["out"], F.array(level)).alias("out"),
        )

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"])
    ahead = fit.select(*keys, "last_date", F.posexplode(path).alias("_i", "yhat")).select(
        *keys, F.date_add("last_date", F.col("_i") + 1).alias("date"), "yhat", F.lit("fitted").alias("status"),
    )
    if not with_status:
        return ahead.drop("status")
    days = _daily(series, keys, date, sales).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = days.filter(F.col("_n") < min_rows).select(
        *keys, F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("yhat"), F.lit("too_short").alias("status"),
    )
    return ahead.unionByName(short)


# --- exponential smoothing -----------------------------------------------------------------------------

SMOOTHING_GRID = tuple(cartesian((0.1, 0.3), (0.01, 0.1), (0.05, 0.2)))
SEASON = 7


def holt_winters_fit(
    series: DataFrame, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales",
    grid: Sequence[tuple[float, float, float]] = SMOOTHING_GRID,
) -> DataFrame:
    """Additive trend, multiplicative weekly season: the grid point with the least one-step squared error per series.

    The first week seeds level and season, the second the trend.  A series of less than two weeks has no
    season to fit: its level is the mean of its days, without trend, and its error and parameters are null.
    """
    filled = fill_days(_daily(series, keys, date, sales), keys, "date", "y")
    packed = F.transform(F.sort_array(F.collect_list(F.struct("date", "y"))), lambda p: p["y"])
    arrays = filled.groupBy(*keys).agg(F.max("date").alias("last_date"), packed.alias("ys"))
    ys = F.col("ys")

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)

    ready = arrays.filter(F.size("ys") >= 2 * SEASON).select(
        *keys, "last_date", "ys",
        F.greatest(F.lit(FLOOR) * F.abs(mean(ys)), F.lit(1e-8)).alias("floor"),
        mean(F.slice(ys, 1, SEASON)).alias("first"), mean(F.slice(ys, SEASON + 1, SEASON)).alias("second"),
    )
    level0 = F.greatest(F.col("first"), F.col("floor"))
    ready = ready.select(
        *keys, "last_date", "floor", level0.alias("level0"), ((F.col("second") - F.col("first")) / SEASON).alias("trend0"),
        F.slice(ys, SEASON + 1, F.size(ys) - SEASON).alias("rest"),
        *[F.greatest(ratio(F.element_at(ys, i + 1), level0), F.lit(FLOOR)).alias(f"s{i}") for i in range(SEASON)],
    )
    seasons = [f"s{i}" for i in range(SEASON)]

    def run(point: Column) -> Column:
        alpha, beta, gamma = point["alpha"], point["beta"], point["gamma"]
        start = F.struct(
            F.lit(0.0).alias("sse"), F.col("level0").alias("level"), F.col("trend0").alias("trend"), *[F.col(s) for s in seasons],
        )

        def step(a: Column, y: Column) -> Column:
            # The seven season factors rotate: s0 is always the one due today.
            ahead = a["level"] + a["trend"]
            error = y - ahead * a["s0"]
            level = F.greatest(alpha * (y / a["s0"]) + (1 - alpha) * ahead, F.col("floor"))
            trend = beta * (level - a["level"]) + (1 - beta) * a["trend"]
            season = F.greatest(gamma * (y / level) + (1 - gamma) * a["s0"], F.lit(FLOOR))
            return F.struct(
                (a["sse"] + error * error).alias("sse"), level.alias("level"), trend.alias("trend"),
                *[a[seasons[i + 1]].alias(seasons[i]) for i in range(SEASON - 1)], season.alias(seasons[-1]),
            )

        return F.aggregate(F.col("rest"), start, step, lambda a: F.struct(
            a["sse"].alias("sse"), alpha.alias("alpha"), beta.alias("beta"), gamma.alias("gamma"),
            a["level"].alias("level"), a["trend"].alias("trend"), F.array(*[a[s] for s in seasons]).alias("seasons"),
        ))

    points = F.array(*[
        F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for a, b, g in grid
    ])
    fitted = ready.select(*keys, "last_date", F.array_min(F.transform(points, run)).alias("fit")).select(*keys, "last_date", "fit.*")
    unknown = [F.lit(None).cast("double").alias(c) for c in ("sse", "alpha", "beta", "gamma")]
    short = arrays.filter(F.size("ys") < 2 * SEASON).select(
        *keys, "last_date", *unknown, mean(ys).alias("level"), F.lit(0.0).alias("trend"), F.array_repeat(F.lit(1.0), SEASON).alias("seasons"),
    )
    return fitted.unionByName(short)


def holt_winters(
    series: DataFrame, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales",
    grid: Sequence[tuple[float, float, float]] = SMOOTHING_GRID,
) -> DataFrame:
    """Forecast of the best smoothing parameters, from the day after the last."""
    fit = holt_winters_fit(series, keys, date, sales, grid)
    return fit.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, F.date_add("last_date", F.col("_i")).alias("date"),
        ((F.col("level") + F.col("_i") * F.col("trend")) * F.element_at("seasons", (F.col("_i") - 1) % SEASON + 1)).alias("yhat"),
    )


MODELS = {"trend_seasonal": trend_seasonal, "autoregressive": autoregressive, "holt_winters": holt_winters}


def forecast(series: DataFrame, model: str, horizon: int = 30, keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales") -> DataFrame:
    """Any model by name in the common shape ``series_key, date, yhat, yhat_lower, yhat_upper, model``: forecast days only."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {sorted(MODELS)}")
    if horizon < 1:
        raise ValueError("horizon must be positive")
    rows = MODELS[model](series, horizon, keys, date, sales)
    key = F.concat_ws("|", *keys) if keys else F.lit("All Products")
    none = F.lit(None).cast("double")
    return rows.select(
        key.alias("series_key"), "date", "yhat",
        *[(F.col(c) if c in rows.columns else none).alias(c) for c in ("yhat_lower", "yhat_upper")],
        F.lit(model).alias("model"),
    )


def forecast_direction(history: DataFrame, future: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """First forecast day against the last actual: UP above 120 %, DOWN below 80 %.

    ``history`` has ``date, y`` and ``future`` has ``date, yhat`` (future rows only).
    """
    last = history.groupBy(*keys).agg(F.max_by("y", "date").alias("last_actual"))
    first = future.groupBy(*keys).agg(F.min_by("yhat", "date").alias("first_forecast"))
    a, f = F.col("last_actual"), F.col("first_forecast")
    return last.join(first, list(keys)).withColumn(
        "direction", F.when(f > a * 1.2, "UP").when(f < a * 0.8, "DOWN").otherwise("FLAT")
    )


# --- backtest ------------------------------------------------------------------------------------------

def backtest(
    series: DataFrame, model: str = "trend_seasonal", window: int = 60, horizon: int = 7, step: int = 1,
    keys: Sequence[str] = ("product",), date: str = "date", sales: str = "sales", with_status: bool = False,
) -> DataFrame:
    """Rolling-origin accuracy per series: mean absolute and percentage error, pooled over all origins.

    Each origin trains on ``window`` rows and is scored on the following
    ``horizon`` days.  Origins become part of the series key, so any model fits
    them all in one pass.  ``step`` thins the origins.  With ``with_status`` no series
    is left out: ``status`` is ``scored``, ``too_short`` for one shorter than
    ``window + horizon``, or ``no_forecast`` where no origin has a day to compare,
    the latter two without measures.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {sorted(MODELS)}")
    rows = _origins(series, window, horizon, step, keys, date, sales)
    # The origin leads, as its short integers decide most comparisons when sorting.
    by_origin = ["_origin", *keys]
    if model == "trend_seasonal":
        # Test days travel with their training rows as days to predict, so nothing is joined.
        blind = rows.select(*by_origin, "date", F.when(~F.col("_test"), F.col("y")).alias("y"),
                            F.when(F.col("_test"), F.col("y")).alias("_actual"))
        fitted = _fit_trend_seasonal(blind, by_origin, carry=("_actual",))
        scored = fitted.filter(F.col("_actual").isNotNull()).select(*keys, F.col("_actual").alias("y"), "yhat")
    else:
        predicted = MODELS[model](rows.filter(~F.col("_test")), horizon, by_origin, "date", "y")
        scored = rows.filter("_test").join(predicted, [*by_origin, "date"])
    measured = accuracy_metrics(scored, keys)
    if not with_status:
        return measured
    if not keys:
        return measured.withColumn("status", F.when(F.col("n") > 0, "scored").otherwise("too_short"))
    days = series.filter(F.to_date(date).isNotNull()).groupBy(*keys).agg(F.count_distinct(F.to_date(date)).alias("_days"))
    status = F.when(F.col("n") > 0, "scored").when(F.col("_days") < window + horizon, "too_short").otherwise("no_forecast")
    return days.join(measured, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", status).drop("_days")


def _origins(
    series: DataFrame, window: int, horizon: int, step: int, keys: Sequence[str], date: str, sales: str,
) -> DataFrame:
    """Unfold each row into the origins it trains and the origins it tests.

    A row's origins follow from its position alone; the series stays partitioned
    on its keys, which also satisfies every later grouping by (keys, origin).
    """
    ordered = W.partitionBy(*keys).orderBy("date")
    position = F.row_number().over(ordered) - 1
    earlier = F.array(*[F.datediff("date", F.lag("date", j).over(ordered)) for j in range(1, horizon + 1)])
    # An unreadable value counts as a day without sales here.
    known = series.withColumn(sales, F.coalesce(F.col(sales), F.lit(0)))
    rows = _daily(known, keys, date, sales).select(
        *keys, "date", "y", position.alias("_r"), F.count(F.lit(1)).over(W.partitionBy(*keys)).cast("int").alias("_n"),
        earlier.alias("_gaps"),
    ).filter(F.col("_n") >= window + horizon)
    last = F.col("_n") - F.lit(window + horizon)
    low, high = F.greatest(F.col("_r") - F.lit(window - 1), F.lit(0)), F.least(F.col("_r"), last)
    trains = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("origin"), F.lit(False).alias("test"))))
    empty = F.filter(F.array(F.struct(F.lit(0).alias("origin"), F.lit(False).alias("test"))), lambda x: F.lit(False))
    tests = F.transform(
        # j rows back lies the last training row of the origin this row is tested on.
        F.filter(F.sequence(F.lit(1), F.lit(horizon)), lambda j: F.coalesce(F.element_at(F.col("_gaps"), j) <= horizon, F.lit(False))),
        lambda j: F.struct((F.col("_r") - j - F.lit(window - 1)).alias("origin"), F.lit(True).alias("test")),
    )
    valid = F.filter(
        F.concat(F.coalesce(trains, empty), tests),
        lambda x: (x["origin"] >= 0) & (x["origin"] <= last) & (x["origin"] % step == 0),
    )
    return rows.select(*keys, "date", "y", F.explode(valid).alias("_o")).select(
        *keys, F.col("_o.origin").alias("_origin"), "date", "y", F.col("_o.test").alias("_test"),
    )
