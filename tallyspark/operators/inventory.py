"""Stock snapshot, stockout status, slow movers and reorder planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import AsOf, as_of_moment, cutoff, day
from tallyspark.functions.numeric import half_even, normal_quantile, ratio, to_number
from tallyspark.operators.rollups import product_days
from tallyspark.schemas import require_columns


def stock_profile(df: DataFrame, product: str = "product", date: str = "date") -> DataFrame:
    """One row per product: average daily sales and quantity, and the latest known stock.

    Runs on the (product, day) rollup, so the latest stock is a numeric ``max_by``
    that stays in hash aggregation; several readings of one day count as the largest.
    """
    days = product_days(df, product, date)
    measures = [c for c in ("sales", "quantity") if c in days.columns]
    stock = (
        [F.max_by("current_stock", F.when(F.col("current_stock").isNotNull(), F.col("date"))).cast("double").alias("last_stock")]
        if "current_stock" in days.columns else [F.lit(None).cast("double").alias("last_stock")]
    )
    n = F.count(F.lit(1))
    return days.groupBy("product").agg(
        n.alias("active_days"), *[ratio(F.sum(c), n).alias(f"avg_daily_{c}") for c in measures], *stock,
    )


def stock_snapshot(df: DataFrame, product: str = "product", date: str = "date", cover_days: int = 7, fallback: float = 50.0) -> DataFrame:
    """Current stock per product.

    The last non-null reading counts, and products that never had one are left
    out.  If no product has a reading, stock is assumed to cover ``cover_days``
    of average quantity (``fallback`` where that is unknown), or 0 when nothing
    was ever sold.
    """
    profile = with_current_stock(stock_profile(df, product, date), stock_facts(df), cover_days, fallback)
    return profile.select("product", "current_stock").filter(F.col("current_stock").isNotNull())


def stock_facts(df: DataFrame) -> DataFrame:
    """Number of stock readings and quantity moved: one row of column totals."""
    has = set(df.columns)
    return df.agg(
        (F.count("current_stock") if "current_stock" in has else F.max(F.lit(0))).alias("known"),
        (F.sum("quantity") if "quantity" in has else F.max(F.lit(0.0))).alias("moved"),
    )


def with_current_stock(profile: DataFrame, facts: DataFrame, cover_days: int = 7, fallback: float = 50.0) -> DataFrame:
    """Add ``current_stock`` to a stock profile: the last reading, or the assumed cover if nobody has one.

    Whether anybody has one is told by ``facts`` (one row of ``stock_facts``), not by a second pass over the profile.
    """
    quantity = F.col("avg_daily_quantity") if "avg_daily_quantity" in profile.columns else F.lit(None).cast("double")
    facts = facts.select(F.struct("known", F.coalesce(F.col("moved").cast("double"), F.lit(0.0)).alias("moved")).alias("f")).scalar()
    assumed = F.when(facts["moved"] > 0, F.coalesce(quantity * cover_days, F.lit(fallback))).otherwise(F.lit(0.0))
    return profile.withColumn("current_stock", F.when(facts["known"] > 0, F.col("last_stock")).otherwise(assumed))


def status_columns(stock: Column, average: Column, critical_days: float) -> dict[str, Column]:
    """Stockout days, criticality and label from a stock and an average-demand column."""
    days = F.when((stock <= 0) & (average > 0), F.lit(0.0)).when(average > 0, ratio(stock, average))
    label = (
        F.when((stock > 0) & (average == 0), "No Sales")
        .when(stock <= 0, "Out of Stock")
        .when(days <= critical_days, "Critical Low Stock")
        .otherwise("Good Stock")
    )
    return {
        "stockout_risk_days": half_even(days, 1),
        "is_critical": F.coalesce((days <= critical_days) & (days >= 0), F.lit(False)),
        "status_label": label,
    }


def inventory_status_labels(stock: DataFrame, averages: DataFrame, critical_days: float = 5) -> DataFrame:
    """Status of every stocked product; products without sales average 0."""
    require_columns(stock, ["product", "current_stock"])
    require_columns(averages, ["product", "avg_daily_sales"])
    joined = stock.join(averages.select("product", "avg_daily_sales"), "product", "left").select(
        "product",
        F.col("current_stock").cast("double").alias("current_stock"),
        F.coalesce(F.col("avg_daily_sales").cast("double"), F.lit(0.0)).alias("avg_daily_sales"),
    )
    return joined.withColumns(status_columns(F.col("current_stock"), F.col("avg_daily_sales"), critical_days))


def inventory_risk_levels(stock: DataFrame, averages: DataFrame, critical_days: float = 7) -> DataFrame:
    """Risk level of the products known to both tables; unknown numbers count as 0."""
    require_columns(stock, ["product_id", "product_name", "current_stock"], "the stock table")
    require_columns(averages, ["product_id", "avg_daily_sales"], "the sales table")
    left = stock.withColumn("current_stock", F.coalesce(to_number(stock, "current_stock"), F.lit(0.0)))
    right = averages.select("product_id", F.coalesce(to_number(averages, "avg_daily_sales"), F.lit(0.0)).alias("avg_daily_sales"))
    days = ratio(F.col("current_stock"), F.col("avg_daily_sales"))
    risk = (
        F.when(days <= 0, "Critical").when(days <= critical_days, "High")
        .when(days <= critical_days * 2, "Medium").otherwise("Low")
    )
    return left.join(right, "product_id").withColumns({
        "days_until_stockout": half_even(days, 2),
        "stockout_risk": risk,
        "alert_required": risk.isin("High", "Critical"),
    })


def slow_movers_page(df: DataFrame, threshold: float = 1.0, product: str = "product", date: str = "date", measure: str = "sales") -> DataFrame:
    """Products whose mean over active days is under the threshold, slowest first."""
    require_columns(df, [product, date, measure])
    days = df.groupBy(F.col(product).alias("product"), day(date).alias("date")).agg(F.sum(measure).alias("total"))
    averages = days.groupBy("product").agg(ratio(F.sum("total"), F.count(F.lit(1))).alias("avg_daily_sales"))
    return averages.filter(F.col("avg_daily_sales") < threshold).orderBy("avg_daily_sales", "product")


def slow_movers(
    df: DataFrame, method: str = "sales_rate", threshold: float = 10.0, window_days: int = 30, as_of: AsOf = None,
    product: str = "product_id", date: str = "date", sales: str = "sales", quantity: str = "quantity", n_rows: str | None = None,
) -> DataFrame:
    """Slow-moving products of the last ``window_days`` by sales rate, quantity rate or days since last sale.

    ``n_rows`` names the row count of a table that is already summed up per product and day.
    """
    require_columns(df, [product, date, sales, quantity])
    if window_days <= 0:
        raise ValueError("days_threshold must be positive")
    if threshold < 0:
        raise ValueError("min_sales_threshold must be non-negative")
    if method not in ("sales_rate", "quantity_rate", "days_since_sale"):
        raise ValueError("method must be 'sales_rate', 'quantity_rate', or 'days_since_sale'")
    end = as_of_moment(df, date, as_of)
    recent = df.filter(F.col(date) >= cutoff(df, date, window_days, as_of))
    usable = recent.select(
        F.col(product).cast("string").alias("product_id"), day(date).alias("date"),
        F.col(sales).alias("sales"), F.col(quantity).alias("quantity"), (F.col(n_rows) if n_rows else F.lit(1)).alias("n_rows"),
    ).dropna(subset=["sales", "quantity"])
    stats = usable.groupBy("product_id").agg(
        F.sum("sales").cast("double").alias("total_sales"),
        F.sum("quantity").cast("double").alias("_quantity"),
        F.sum("n_rows").cast("bigint").alias("days_active"),
        F.max("date").alias("_last"), F.min("date").alias("_first"),
    )
    today = F.to_date(end)
    span = (F.datediff(today, F.col("_first")) + 1).cast("double")
    rated = stats.withColumns({
        "avg_daily_sales": F.col("total_sales") / span,
        "avg_daily_quantity": F.col("_quantity") / span,
        "days_since_last_sale": F.datediff(today, F.col("_last")),
    })
    limit = F.lit(float(threshold))
    if method == "days_since_sale":
        keep = F.col("days_since_last_sale") > limit
        score = ratio(limit, F.col("days_since_last_sale"))
    else:
        rate = F.col("avg_daily_sales" if method == "sales_rate" else "avg_daily_quantity")
        keep = rate < limit
        score = ratio(rate, limit)
    return rated.filter(keep).select(
        "product_id", "total_sales", F.col("_quantity").cast("bigint").alias("total_quantity"), "days_active",
        "avg_daily_sales", "avg_daily_quantity", "days_since_last_sale",
        F.lit("Slow Moving").alias("alert_type"),
        F.when(score < 0.1, "Critical").when(score < 0.3, "High").when(score < 0.6, "Medium").otherwise("Low").alias("severity"),
        limit.alias("threshold_used"), F.lit(method).alias("method"),
    )


def zero_velocity_products(
    df: DataFrame, window_days: int = 30, as_of: AsOf = None, product: str = "product_id", date: str = "date",
) -> DataFrame:
    """Products without a sale in the window: all products minus active ones, as one aggregate."""
    require_columns(df, [product, date])
    last = df.groupBy(F.col(product).cast("string").alias("product_id")).agg(F.max(date).alias("_last"))
    return last.filter(F.col("_last").isNull() | (F.col("_last") < cutoff(df, date, window_days, as_of))).select(
        "product_id", F.lit("Zero Velocity").alias("alert_type"), F.lit("Critical").alias("severity"),
        F.lit(window_days).alias("days_without_sale"), F.lit(window_days).alias("threshold_used"),
    )


def stagnant_inventory(
    df: DataFrame, window_days: int = 60, max_quantity: float = 5, as_of: AsOf = None,
    product: str = "product_id", quantity: str = "quantity", date: str = "date",
) -> DataFrame:
    """Products that sold in the window but no more than ``max_quantity``."""
    require_columns(df, [product, quantity, date])
    sold = df.filter(F.col(date) >= cutoff(df, date, window_days, as_of)).groupBy(F.col(product).cast("string").alias("product_id")).agg(
        F.coalesce(F.sum(quantity).cast("double"), F.lit(0.0)).alias("_sold")
    )
    return sold.filter(F.col("_sold") <= max_quantity).select(
        "product_id", F.col("_sold").cast("bigint").alias("total_quantity_sold"),
        F.lit("Stagnant Inventory").alias("alert_type"), F.lit("High").alias("severity"),
        F.lit(window_days).alias("days_analyzed"), F.lit(float(max_quantity)).alias("max_quantity_threshold"),
    )


# --- planning -----------------------------------------------------------------------------------

def demand_stats(df: DataFrame, product: str = "product", date: str = "date", measure: str = "quantity") -> DataFrame:
    """Mean and sample deviation of the daily demand of every product over its active days."""
    require_columns(df, [product, date, measure])
    days = df.groupBy(F.col(product).alias("product"), day(date).alias("date")).agg(F.sum(measure).cast("double").alias("demand"))
    return days.groupBy("product").agg(
        ratio(F.sum("demand"), F.count(F.lit(1))).alias("avg_daily"), F.stddev_samp("demand").alias("std_daily"),
    )


def safety_stock(std_daily: Column, lead_time: Column | float, service_level: Column | float) -> Column:
    """z(service level) * deviation * sqrt(lead time); 0 for unusable inputs and never negative."""
    lead = lead_time if isinstance(lead_time, Column) else F.lit(float(lead_time))
    level = service_level if isinstance(service_level, Column) else F.lit(float(service_level))
    usable = (std_daily > 0) & (lead > 0) & (level > 0) & (level < 1)
    inside = isinstance(service_level, Column) or 0 < service_level < 1
    z = normal_quantile(service_level) if inside else F.lit(0.0)
    return F.when(usable, F.greatest(F.lit(0.0), z * std_daily * F.sqrt(lead))).otherwise(F.lit(0.0))


def reorder_point(avg_daily: Column, lead_time: Column | float, safety: Column) -> Column:
    """Demand over the lead time plus safety stock; 0 for negative inputs."""
    lead = lead_time if isinstance(lead_time, Column) else F.lit(float(lead_time))
    return F.when((avg_daily < 0) | (lead < 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), avg_daily * lead + safety))


def order_quantity(
    avg_daily: Column, target_days: Column | float, safety: Column | float = 0.0,
    current_stock: Column | float = 0.0, net_of_stock: bool = False,
) -> Column:
    """Demand over the target days plus safety stock; stock on hand is deducted only on request."""
    days = target_days if isinstance(target_days, Column) else F.lit(float(target_days))
    extra = safety if isinstance(safety, Column) else F.lit(float(safety))
    wanted = avg_daily * days + extra
    if net_of_stock:
        wanted = wanted - (current_stock if isinstance(current_stock, Column) else F.lit(float(current_stock)))
    return F.when((avg_daily < 0) | (days < 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), wanted))


def reorder_panel(series: DataFrame, key: str = "product", date: str = "date", sales: str = "sales", last: int = 30, stock: DataFrame | None = None) -> DataFrame:
    """Quick reorder figures from the mean of each series' last ``last`` days.

    Days of cover are those of the safety stock, or of real stock when a
    ``(key, current_stock)`` table is given.
    """
    averages = recent_average(series, [key], date, sales, last)
    joined = averages.join(stock.select(key, "current_stock"), key, "left") if stock is not None else averages
    daily = F.col("recent_avg")
    safety = daily * 1.5
    on_hand = F.coalesce(F.col("current_stock").cast("double"), safety) if stock is not None else safety
    days = F.when(daily > 0, ratio(on_hand, daily)).otherwise(F.lit(0.0))
    return joined.select(
        key, daily.alias("daily_sales"), safety.alias("safety_stock"), (safety * 1.2).alias("reorder_at"),
        (safety * 2).alias("order_now"), days.alias("stock_days"),
        F.when(days < 3, "Critical (<3 days)").when(days < 7, "Low (<1 week)").otherwise("Safe").alias("status"),
    )


def recent_average(series: DataFrame, keys: list[str], date: str = "date", sales: str = "sales", last: int = 30) -> DataFrame:
    """Mean over the last ``last`` dates of each series, of each date's mean."""
    from pyspark.sql import Window as W

    require_columns(series, [*keys, date, sales])
    per_day = series.groupBy(*keys, F.col(date)).agg(ratio(F.sum(sales), F.count(sales)).alias("_mean"))
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(date)))
    kept = per_day.withColumn("_rn", newest).filter(F.col("_rn") <= last)
    return kept.groupBy(*keys).agg(F.avg("_mean").alias("recent_avg"))
