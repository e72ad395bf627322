"""Shared rollups: the few aggregates almost every other operator starts from.

Raw sales are read once into two small tables: totals per (product, day) and
per (day, hour).  Both are plain sums with map-side partial aggregation, so a
product holding a third of all rows reaches the shuffle as one row per day and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.dates import day
from tallyspark.functions.numeric import ratio
from tallyspark.schemas import require_columns


def daily_sales(df: DataFrame, keys: Sequence[str] = (), date: str = "date", sales: str = "sales") -> DataFrame:
    """Total per calendar day, and per key when keys are given; rows without a date belong to no day."""
    require_columns(df, [date, sales, *keys])
    return df.filter(F.col(date).isNotNull()).groupBy(*keys, day(date).alias("date")).agg(F.sum(sales).alias("sales"))


def partitions_for(df: DataFrame, per_task: int = 250_000) -> int:
    """How many partitions leave at most about ``per_task`` rows to a task; at least one for each core.

    The rows are counted, which for a plain view of Parquet files reads their footers alone.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task))


def hourly_sales(df: DataFrame, date: str = "date", sales: str = "sales") -> DataFrame:
    """Total per (day, hour): bounded by the calendar, whatever the number of rows; rows without a date are left out."""
    require_columns(df, [date, sales])
    moment = F.col(date)
    return df.filter(moment.isNotNull()).groupBy(day(date).alias("date"), F.hour(moment.cast("timestamp_ntz")).alias("hour")).agg(
        F.sum(sales).alias("sales"), F.count(F.lit(1)).alias("n_rows")
    )


def product_days(df: DataFrame, product: str = "product", date: str = "date") -> DataFrame:
    """Per (product, day): sums of the measures present, row count, largest non-null stock of the day."""
    require_columns(df, [product, date])
    sums = [F.sum(c).alias(c) for c in ("sales", "quantity", "profit") if c in df.columns]
    stock = [F.max("current_stock").alias("current_stock")] if "current_stock" in df.columns else []
    return df.groupBy(F.col(product).alias("product"), day(date).alias("date")).agg(
        *sums, F.count(F.lit(1)).alias("n_rows"), *stock
    )


def product_totals(df: DataFrame, product: str = "product", measures: Sequence[str] = ("sales", "quantity", "profit")) -> DataFrame:
    """Per product: sums of the measures present, in their own type."""
    require_columns(df, [product])
    return df.groupBy(F.col(product).alias("product")).agg(
        *[F.sum(c).alias(c) for c in measures if c in df.columns]
    )


def shared(rollup: DataFrame) -> DataFrame:
    """A rollup that many branches of one plan start from, run once for all of them.

    Its columns are bound into one value that the optimizer neither prunes nor filters beneath, so every branch keeps
    the same exchange and Spark reuses it.  Nothing is stored: the next plan reads the table anew.
    """
    row = F.element_at(F.array(F.struct(*rollup.columns)), 1)
    return rollup.select(row.alias("_row")).select(*[F.col("_row")[c].alias(c) for c in rollup.columns])


def fill_days(daily: DataFrame, keys: Sequence[str] = (), date: str = "date", value: str = "sales") -> DataFrame:
    """Every calendar day from first to last of each series; absent days get 0.

    Each row carries its gap to the next row of the series and unfolds that gap
    in place, so no calendar is built and nothing is joined.
    """
    from tallyspark.operators.stretches import with_next_date  # Stretches start from the rollups of this module.

    require_columns(daily, [*keys, date, value])
    offsets = F.sequence(F.lit(0), F.coalesce(F.datediff("_next", F.col(date)), F.lit(1)) - 1)
    kind = daily.schema[value].dataType
    return (
        with_next_date(daily.select(*keys, date, value), keys, date, "_next").select(*keys, F.col(date), F.col(value), offsets.alias("_gap"))
        .select(*keys, F.col(date).alias("_from"), F.col(value).alias("_value"), F.explode("_gap").alias("_k"))
        .select(
            *keys,
            F.date_add("_from", F.col("_k")).alias(date),
            F.when(F.col("_k") == 0, F.col("_value")).otherwise(F.lit(0).cast(kind)).alias(value),
        )
    )


def avg_daily_by_product(df: DataFrame, product: str = "product", date: str = "date") -> DataFrame:
    """Mean daily sales and quantity per product over the days the product sold."""
    days = product_days(df, product, date)
    measures = [c for c in ("sales", "quantity") if c in days.columns]
    return days.groupBy("product").agg(
        F.count(F.lit(1)).alias("active_days"),
        *[ratio(F.sum(c), F.count(F.lit(1))).alias(f"avg_daily_{c}") for c in measures],
    )


def share_of(total_frame: DataFrame, measure: str) -> Column:
    """Grand total of a measure as a scalar subquery over an already aggregated frame."""
    return total_frame.select(F.sum(measure).alias("t")).scalar()


def top_k(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows in order with their rank.

    The ordered limit keeps k rows per task; only those k rows meet in the rank window.
    """
    best = frame.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))
