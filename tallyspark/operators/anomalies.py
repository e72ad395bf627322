"""Anomaly rules over daily series.

Inputs are daily rows (``date, sales`` plus optional series keys).  Windows without
keys run over stretches of the series, in as many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallyspark.functions.numeric import ratio
from tallyspark.operators.stretches import count_rows, windowed
from tallyspark.schemas import require_columns

METHODS = ("zscore", "iqr", "mad")
# Fixed value: scale that makes the median absolute deviation comparable to a standard deviation.
MAD_SCALE = 0.6745


def _series(daily: DataFrame, keys: Sequence[str], date: str, sales: str, exact: bool = False) -> DataFrame:
    """Rows with a usable value, measured as DOUBLE, under the names ``date`` and ``sales``; ``_exact`` is the value as given."""
    require_columns(daily, [*keys, date, sales])
    given = [F.col(sales).alias("_exact")] if exact else []
    return daily.select(
        *keys, F.to_date(date).alias("date"), F.col(sales).cast("double").alias("sales"), *given
    ).filter(F.col("sales").isNotNull())


def _with_stats(rows: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Attach per-series statistics: a keyed join, or one scalar subquery when there are no keys."""
    if keys:
        return rows.join(rows.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), list(keys))
    one = rows.select(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s")).scalar()
    return rows.withColumn("_s", one).select(*rows.columns, *[F.col("_s")[n].alias(n) for n in stats])


def rolling_band(
    filled: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    window: int = 7, width: float = 2.0,
) -> DataFrame:
    """Days outside rolling mean +/- ``width`` deviations; only full windows count.

    Expects a gap-free daily series.
    """
    def band(series: WindowSpec) -> dict[str, Column]:
        frame = series.rowsBetween(1 - window, 0)
        return {"rolling_mean": F.avg("sales").over(frame), "rolling_std": F.stddev_samp("sales").over(frame), "_n": F.count("sales").over(frame)}

    rows = windowed(_series(filled, keys, date, sales), keys, "date", window - 1, 0, band)
    high = F.col("sales") > F.col("rolling_mean") + width * F.col("rolling_std")
    low = F.col("sales") < F.col("rolling_mean") - width * F.col("rolling_std")
    return rows.filter((F.col("_n") == window) & (high | low)).select(
        *keys, "date", "sales", "rolling_mean", "rolling_std",
        F.when(F.col("sales") > F.col("rolling_mean"), "high").otherwise("low").alias("direction"),
        F.abs(F.col("sales") - F.col("rolling_mean")).alias("impact"),
    )


def rolling_zscore(
    daily: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    threshold: float = 2.0, window: int = 7, exclude_current: bool = False,
) -> DataFrame:
    """Every day with its trailing z-score and high / low flags; gaps are not filled.

    Short windows count from the first row; a series of one row yields nothing.
    With ``exclude_current`` a day is judged against the days before it only.
    """
    def trailing(series: WindowSpec) -> dict[str, Column]:
        frame = series.rowsBetween(-window if exclude_current else 1 - window, -1 if exclude_current else 0)
        return {"mean_sales": F.avg("sales").over(frame), "std_dev_sales": F.nullif(F.stddev_samp("sales").over(frame), F.lit(0.0))}

    measured = _series(daily, keys, date, sales)
    rows = windowed(measured, keys, "date", window, 0, trailing).withColumn("_n", count_rows(measured, keys))
    z = F.coalesce(ratio(F.col("sales") - F.col("mean_sales"), F.col("std_dev_sales")), F.lit(0.0))
    return rows.filter(F.col("_n") >= 2).withColumn("z_score", z).select(
        *keys, "date", "sales", "mean_sales", "std_dev_sales", "z_score",
        (F.col("z_score") > threshold).alias("is_anomaly_high"),
        (F.col("z_score") < -threshold).alias("is_anomaly_low"),
    )


def _record(rows: DataFrame, keys: Sequence[str], expected: Column, method: str) -> DataFrame:
    """Anomaly record: deviation, percentage, direction and severity.

    The percentage is null, and the severity Critical, where nothing was expected.
    """
    deviation = F.col("sales") - expected
    pct = ratio(deviation, F.nullif(expected, F.lit(0.0))) * 100
    size = F.abs(F.col("deviation_pct"))
    return rows.select(
        *keys, "date", "sales", expected.alias("expected_sales"), deviation.alias("deviation"),
        pct.alias("deviation_pct"),
    ).select(
        "*",
        F.when(F.col("deviation") > 0, "High Sales").otherwise("Low Sales").alias("anomaly_type"),
        F.when(size.isNull() | (size > 100), "Critical").when(size > 50, "High")
        .when(size > 25, "Medium").otherwise("Low").alias("severity"),
        F.lit(method).alias("method"),
    )


def detect_anomalies(
    daily: DataFrame, method: str = "zscore", threshold: float = 2.5, keys: Sequence[str] = (),
    date: str = "date", sales: str = "sales", min_rows: int = 7,
) -> DataFrame:
    """Z-score, inter-quartile or median-deviation anomalies of each series, with severity."""
    require_columns(daily, [*keys, date, sales])
    if threshold <= 0:
        raise ValueError("z_score_threshold must be positive")
    if method not in METHODS:
        raise ValueError("method must be 'zscore', 'iqr', or 'mad'")
    rows = _series(daily, keys, date, sales)
    x = F.col("sales")
    if method == "zscore":
        # Sums of decimals are exact, so the mean of money does not depend on the order of the rows.
        money = isinstance(daily.schema[sales].dataType, DecimalType)
        mean = F.sum("_exact").cast("double") / F.count("_exact") if money else F.avg("sales")
        rows = _series(daily, keys, date, sales, exact=money)
        found = _with_stats(rows, keys, {"_n": F.count("sales"), "_m": mean, "_sd": F.stddev_samp("sales")})
        hit = F.abs(ratio(x - F.col("_m"), F.col("_sd"))) > threshold
        expected = F.col("_m")
    elif method == "iqr":
        found = _with_stats(rows, keys, {
            "_n": F.count("sales"), "_q": F.percentile("sales", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
        })
        q1, expected, q3 = (F.col("_q")[i] for i in range(3))
        hit = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    else:
        centred = _with_stats(rows, keys, {"_n": F.count("sales"), "_med": F.percentile("sales", 0.5)})
        apart = centred.withColumn("_dev", F.abs(x - F.col("_med")))
        found = _with_stats(apart, keys, {"_mad": F.percentile("_dev", 0.5)})
        score = F.abs(F.lit(MAD_SCALE) * ratio(x - F.col("_med"), F.col("_mad")))
        hit = F.when(F.col("_mad") == 0, x != F.col("_med")).otherwise(score > threshold)
        expected = F.col("_med")
    return _record(found.filter((F.col("_n") >= min_rows) & hit), keys, expected, method)


def detect_product_anomalies(
    rows: DataFrame, product: str = "product_id", date: str = "date", sales: str = "sales", threshold: float = 2.0,
) -> DataFrame:
    """Z-score anomalies of every product at once; products with fewer than 7 rows are left out."""
    found = detect_anomalies(rows, "zscore", threshold, [product], date, sales)
    return found.withColumn(product, F.col(product).cast("string"))


def centred_average_anomalies(
    daily: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    window: int = 7, gate_pct: float = 50.0,
) -> DataFrame:
    """Days further than ``gate_pct`` from their centred moving average; full windows only."""
    before, after = window // 2, (window - 1) // 2

    def centred(series: WindowSpec) -> dict[str, Column]:
        frame = series.rowsBetween(-before, after)
        return {"moving_avg": F.when(F.count("sales").over(frame) == window, F.avg("sales").over(frame))}

    rows = windowed(_series(daily, keys, date, sales), keys, "date", before, after, centred)
    deviation = F.col("sales") - F.col("moving_avg")
    # A zero average with a nonzero deviation is infinitely far off.
    far = F.when(F.col("moving_avg") == 0, deviation != 0).otherwise(F.col("deviation_pct") > gate_pct)
    return rows.filter(F.col("moving_avg").isNotNull()).select(
        "*", deviation.alias("deviation"), F.abs(ratio(deviation, F.col("moving_avg")) * 100).alias("deviation_pct"),
    ).filter(far)


def detector(
    daily: DataFrame, method: str = "iqr", date: str = "date", sales: str = "sales",
) -> DataFrame:
    """Stand-alone detector (``iqr``, ``zscore`` on population deviation, ``rolling``) with spike / drop classes."""
    if method not in ("iqr", "zscore", "rolling"):
        raise ValueError("method must be 'iqr', 'zscore', or 'rolling'")
    rows = _series(daily, (), date, sales)
    stats = {"_med": F.percentile("sales", 0.5), "_sd": F.stddev_samp("sales")}
    x = F.col("sales")
    if method == "iqr":
        stats["_q"] = F.percentile("sales", F.array(F.lit(0.25), F.lit(0.75)))
        q1, q3 = F.col("_q")[0], F.col("_q")[1]
        hit = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    elif method == "zscore":
        stats |= {"_mean": F.avg("sales"), "_sdp": F.stddev_pop("sales")}
        hit = F.abs(ratio(x - F.col("_mean"), F.col("_sdp"))) > 2.5
    else:
        # The window is a quarter of the series, at most 30 rows: known only once the
        # series is, so a 30-row frame is carried and cut to size.
        length = count_rows(rows, ())
        rows = windowed(rows, (), "date", 29, 0, lambda series: {"_last": F.collect_list("sales").over(series.rowsBetween(-29, 0))})
        rows = rows.withColumn("_n", length)
        size = F.least(F.lit(30), F.floor(F.col("_n") / 4).cast("int"))
        recent = F.when((size >= 2) & (F.size("_last") >= size), F.slice("_last", -size, size))
        count = F.size(recent).cast("double")
        mean = F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / count
        spread = F.aggregate("_recent", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
        rows = rows.select("date", "sales", recent.alias("_recent"), mean.alias("_mean")).select(
            "date", "sales", "_mean", F.sqrt(spread / (F.size("_recent") - 1)).alias("_std"),
        )
        hit = F.abs(ratio(x - F.col("_mean"), F.col("_std"))) > 2.0
    found = _with_stats(rows, (), stats).filter(hit)
    return found.select(
        "date", "sales",
        F.when(x > F.col("_med"), "High Sales Spike").otherwise("Low Sales Drop").alias("anomaly_type"),
        F.when(F.abs(x - F.col("_med")) > 2 * F.col("_sd"), "Critical").otherwise("Moderate").alias("severity"),
    )


def anomaly_digest(anomalies: DataFrame, date: str = "date", recent_days: int = 7) -> DataFrame:
    """Counts of spikes, drops and anomalies in the days up to the latest one."""
    latest = anomalies.select(F.max(date).alias("d")).scalar()
    return anomalies.agg(
        F.count_if(F.col("anomaly_type") == "High Sales Spike").alias("spikes"),
        F.count_if(F.col("anomaly_type") == "Low Sales Drop").alias("drops"),
        F.count_if(F.col(date) >= F.date_sub(latest, recent_days)).alias("recent"),
    )


def anomaly_context(
    anomalies: DataFrame, daily: DataFrame, before: int = 14, after: int = 7,
    date: str = "date", sales: str = "sales",
) -> DataFrame:
    """The days around each anomaly, the anomaly itself flagged.

    Each anomaly unfolds into its days, which turns the range condition into an equi-join.
    """
    spans = anomalies.select(F.to_date(date).alias("anomaly_date")).distinct().select(
        "anomaly_date",
        F.explode(F.sequence(F.date_sub("anomaly_date", before), F.date_add("anomaly_date", after))).alias("date"),
    )
    days = daily.select(F.to_date(date).alias("date"), F.col(sales).cast("double").alias("sales"))
    return spans.join(days, "date").select(
        "anomaly_date", "date", "sales", (F.col("date") == F.col("anomaly_date")).alias("is_anomaly")
    )


def festival_windows(
    daily: DataFrame, calendar: DataFrame, reach: int = 3, date: str = "date", sales: str = "sales",
) -> DataFrame:
    """Series rows within ``reach`` days of a festival of the supplied ``(date, name)`` calendar."""
    require_columns(calendar, ["date", "name"])
    near = calendar.select(
        F.to_date("date").alias("festival_date"), F.col("name").alias("festival"),
    ).select(
        "*", F.explode(F.sequence(F.date_sub("festival_date", reach), F.date_add("festival_date", reach))).alias("date"),
    )
    days = daily.select(F.to_date(date).alias("date"), F.col(sales).cast("double").alias("sales"))
    return near.join(days, "date").select(
        "festival", "festival_date", "date", "sales", F.datediff("date", "festival_date").alias("offset_days"),
    )


def upcoming_festivals(calendar: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """The next k festivals on or after ``as_of`` with the days left."""
    today = F.to_date(as_of)
    return (
        calendar.select(F.to_date("date").alias("date"), "name")
        .filter(F.col("date") >= today)
        .withColumn("days_away", F.datediff("date", today))
        .orderBy("date", "name").limit(k)
    )
