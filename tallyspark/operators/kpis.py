"""Headline figures and trend comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import AsOf, as_of_moment, is_weekend
from tallyspark.functions.numeric import ratio, total
from tallyspark.operators.rollups import daily_sales, hourly_sales, product_totals, share_of, top_k


def kpi_totals(df: DataFrame, sales: str = "sales", profit: str = "profit") -> DataFrame:
    """Total sales, total profit (null when absent) and number of transactions."""
    return df.agg(
        (total(sales) if sales in df.columns else F.lit(None).cast("double")).alias("total_sales"),
        (total(profit) if profit in df.columns else F.lit(None).cast("double")).alias("total_profit"),
        F.count(F.lit(1)).alias("transactions"),
    )


def top_product(df: DataFrame, product: str = "product", sales: str = "sales") -> DataFrame:
    """The product with the largest total; ties go to the smaller name."""
    totals = product_totals(df, product, [sales])
    return totals.orderBy(F.desc(sales), F.asc("product")).limit(1).select(
        "product", F.col(sales).cast("double").alias("sales")
    )


def low_sales_alert(df: DataFrame, product: str = "product", sales: str = "sales", share: float = 0.05) -> DataFrame:
    """The product with the smallest total, if below ``share`` of all sales."""
    totals = product_totals(df, product, [sales])
    everything = share_of(totals, sales).cast("double")
    return (
        totals.orderBy(F.asc(sales), F.asc("product")).limit(1)
        .select("product", F.col(sales).cast("double").alias("sales"), everything.alias("total_sales"))
        .filter(F.col("sales") < F.lit(share) * F.col("total_sales"))
    )


def iso_week_trend(df: DataFrame, date: str = "date", sales: str = "sales", year_aware: bool = False) -> DataFrame:
    """Latest ISO week against the week before it.

    By default weeks of all years share their number; ``year_aware`` keys weeks
    by their Monday instead.
    """
    daily = daily_sales(df, date=date, sales=sales)
    week = F.trunc("date", "week") if year_aware else F.weekofyear("date")
    weekly = daily.groupBy(week.alias("week")).agg(F.sum("sales").alias("sales"))
    latest = weekly.select(F.max("week").alias("w")).scalar()
    before = F.date_sub(latest, 7) if year_aware else latest - 1
    out = weekly.agg(
        F.max("week").alias("latest_week"),
        F.coalesce(F.sum(F.when(F.col("week") == latest, F.col("sales"))).cast("double"), F.lit(0.0)).alias("sales_latest"),
        F.coalesce(F.sum(F.when(F.col("week") == before, F.col("sales"))).cast("double"), F.lit(0.0)).alias("sales_previous"),
    )
    delta = F.col("sales_latest") - F.col("sales_previous")
    return out.withColumns({
        "delta": delta,
        "change_pct": F.coalesce(ratio(delta, F.col("sales_previous")) * 100, F.lit(0.0)),
    })


def week_over_week(
    df: DataFrame, as_of: AsOf = None, date: str = "date", sales: str = "sales",
    threshold_pct: float = 10.0, min_days: int = 14,
) -> DataFrame:
    """Last 7 days against the 7 before: the measured row with its verdict flags.

    Windows are half-open on whole days: ``(as_of-7, as_of]`` and ``(as_of-14, as_of-7]``.
    """
    daily = daily_sales(df, date=date, sales=sales)
    end = F.to_date(as_of_moment(daily, "date", as_of))
    recent = (F.col("date") > F.date_sub(end, 7)) & (F.col("date") <= end)
    previous = (F.col("date") > F.date_sub(end, 14)) & (F.col("date") <= F.date_sub(end, 7))
    out = daily.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(recent).alias("recent_days"),
        F.count_if(previous).alias("previous_days"),
        F.sum(F.when(recent, F.col("sales"))).cast("double").alias("recent_sales"),
        F.sum(F.when(previous, F.col("sales"))).cast("double").alias("previous_sales"),
    ).filter((F.col("days") >= min_days) & (F.col("recent_days") > 0) & (F.col("previous_days") > 0))
    change = F.when(
        F.col("previous_sales") > 0,
        ratio(F.col("recent_sales") - F.col("previous_sales"), F.col("previous_sales")) * 100,
    )
    initiated = (F.col("previous_sales") <= 0) & (F.col("recent_sales") > 0)
    return (
        out.select("recent_sales", "previous_sales", change.alias("change_pct"), initiated.alias("initiated"))
        .withColumn("significant", F.coalesce(F.abs("change_pct") > threshold_pct, F.lit(False)) | F.col("initiated"))
    )


def month_over_month(
    df: DataFrame, as_of: AsOf = None, date: str = "date", sales: str = "sales",
    threshold_pct: float = 15.0, min_days: int = 14,
) -> DataFrame:
    """Calendar month of ``as_of`` against the month before it, year change included."""
    daily = daily_sales(df, date=date, sales=sales)
    month = F.trunc(F.to_date(as_of_moment(daily, "date", as_of)), "MM")
    of_day = F.trunc("date", "MM")
    zero = F.lit(0.0)
    out = daily.agg(
        F.count(F.lit(1)).alias("days"),
        F.coalesce(F.sum(F.when(of_day == month, F.col("sales"))).cast("double"), zero).alias("current_sales"),
        F.coalesce(F.sum(F.when(of_day == F.add_months(month, -1), F.col("sales"))).cast("double"), zero).alias("previous_sales"),
    ).filter(F.col("days") >= min_days)
    change = F.when(
        F.col("previous_sales") > 0,
        ratio(F.col("current_sales") - F.col("previous_sales"), F.col("previous_sales")) * 100,
    )
    return out.select(
        "current_sales", "previous_sales", change.alias("change_pct"),
        F.coalesce(F.abs(change) > threshold_pct, F.lit(False)).alias("significant"),
    )


def weekend_effect(
    df: DataFrame, date: str = "date", sales: str = "sales",
    surge: float = 1.2, lag: float = 0.8, per_day: bool = False,
) -> DataFrame:
    """Weekend against weekday totals (per average day with ``per_day``); needs both kinds of day."""
    daily = daily_sales(df, date=date, sales=sales)
    weekend = is_weekend(F.col("date"))
    out = daily.agg(
        F.count_if(weekend).alias("weekend_days"),
        F.count_if(~weekend).alias("weekday_days"),
        F.sum(F.when(weekend, F.col("sales"))).cast("double").alias("weekend_sales"),
        F.sum(F.when(~weekend, F.col("sales"))).cast("double").alias("weekday_sales"),
    ).filter((F.col("weekend_days") > 0) & (F.col("weekday_days") > 0))
    left, right = F.col("weekend_sales"), F.col("weekday_sales")
    if per_day:
        left, right = left / F.col("weekend_days"), right / F.col("weekday_days")
    label = (
        F.when((right > 0) & (left > right * surge), F.lit("surge"))
        .when(left < right * lag, F.lit("lag"))
        .otherwise(F.lit("none"))
    )
    change = ratio(left - right, right) * 100
    return out.select(
        "weekend_sales", "weekday_sales", ratio(left, right).alias("ratio"), label.alias("effect"),
        F.when(label == "lag", F.abs(change)).otherwise(change).alias("impact"),
    )


def peak_hour(df: DataFrame, date: str = "date", sales: str = "sales", share_pct: float = 20.0) -> DataFrame:
    """The hour with the largest total (ties: the earlier hour) and its share of all sales."""
    by_hour = hourly_sales(df, date, sales).groupBy("hour").agg(F.sum("sales").alias("sales"))
    everything = share_of(by_hour, "sales")
    share = F.when(everything > 0, ratio(F.col("sales"), everything) * 100).otherwise(F.lit(0.0))
    return (
        by_hour.orderBy(F.desc("sales"), F.asc("hour")).limit(1)
        .select(
            F.col("hour").alias("peak_hour"), F.col("sales").cast("double").alias("peak_sales"),
            share.alias("share_pct"), (share > share_pct).alias("significant"),
        )
    )


def product_top(df: DataFrame, product: str = "product", sales: str = "sales", k: int = 3) -> DataFrame:
    """Best sellers with their share of all sales."""
    totals = product_totals(df, product, [sales])
    everything = share_of(totals, sales)
    return top_k(totals, k, F.desc(sales), F.asc("product")).select(
        "rank", "product", F.col(sales).cast("double").alias("sales"),
        (ratio(F.col(sales), everything) * 100).alias("share_pct"),
    )


def product_bottom(
    df: DataFrame, product: str = "product", sales: str = "sales", k: int = 3, max_share: float = 0.05,
) -> DataFrame:
    """Worst sellers, only when more than k products exist and together they hold under ``max_share``."""
    totals = product_totals(df, product, [sales])
    facts = totals.select(F.struct(F.sum(sales).alias("total"), F.count(F.lit(1)).alias("n")).alias("f")).scalar()
    worst = top_k(totals, k, F.asc(sales), F.desc("product"))
    group_sum = share_of(worst, sales)
    return worst.filter(
        (facts["n"] > k) & (group_sum.cast("double") < facts["total"].cast("double") * max_share)
    ).select(
        "rank", "product", F.col(sales).cast("double").alias("sales"),
        (ratio(F.col(sales), facts["total"]) * 100).alias("share_pct"),
    )


def low_profit_items(
    df: DataFrame, product: str = "product", profit: str = "profit", k: int = 3, mean_share: float = 0.1,
) -> DataFrame:
    """Of the k smallest profits, those under ``mean_share`` of the mean product profit."""
    totals = product_totals(df, product, [profit])
    facts = totals.select(
        F.struct(F.sum(profit).cast("double").alias("total"), F.count(profit).alias("n")).alias("f")
    ).scalar()
    value = F.col(profit).cast("double")
    return (
        top_k(totals.filter(F.col(profit).isNotNull()), k, F.asc(profit), F.asc("product"))
        .filter(value < ratio(facts["total"], facts["n"]) * mean_share)
        .select("rank", "product", value.alias("profit"), (ratio(F.abs(value), facts["total"]) * 100).alias("impact"))
    )


def inventory_movers(df: DataFrame, product: str = "product", quantity: str = "quantity", k: int = 3) -> DataFrame:
    """The k fastest and k slowest products by quantity, joined to one text each, with impact."""
    totals = product_totals(df, product, [quantity])
    facts = totals.select(F.struct(F.sum(quantity).cast("double").alias("total"), F.count(F.lit(1)).alias("n")).alias("f")).scalar()

    def listed(kind: str, frame: DataFrame) -> DataFrame:
        # At most k rows; the slowest product closes the list of slow movers.
        ranked = F.sort_array(F.collect_list(F.struct("rank", "product")), kind == "fast")
        return frame.groupBy().agg(
            F.array_join(F.transform(ranked, lambda x: x["product"]), ", ").alias("products"),
            F.sum(quantity).cast("double").alias("group_quantity"),
        ).select(F.lit(kind).alias("kind"), "products", "group_quantity")

    fast = listed("fast", top_k(totals, k, F.desc(quantity), F.asc("product")))
    slow = listed("slow", top_k(totals, k, F.asc(quantity), F.desc("product")))
    share = ratio(F.col("group_quantity"), facts["total"]) * 100
    return (
        fast.unionByName(slow.filter(facts["n"] > k))
        .filter(F.col("group_quantity").isNotNull())
        .withColumn("impact", F.when(F.col("kind") == "fast", share).otherwise(F.lit(100.0) - share))
    )
