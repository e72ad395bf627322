"""Views of the order tables as retail sales, stock and upload tables.

Every view keeps the moment column as stored, so that date filters reach the
Parquet scan, and money as decimals, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; the part is the product.  No join."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        F.col("l_extendedprice").cast(MONEY).alias("sales"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_partkey").cast("string").alias("product"),
    )


def sales_by_part_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_by_part(spark, sf_dir).withColumnRenamed("product", "product_id")


def sales_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; the brand is the product.

    Spark broadcasts the part columns only while their size is under its
    threshold; beyond it a hot part is split by the adaptive skew join.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("product"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").alias("date"),
        F.col("l_extendedprice").cast(MONEY).alias("sales"), F.col("l_quantity").cast(MONEY).alias("quantity"),
    )
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("date", "sales", "quantity", "product")


def sales_with_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-level sales with a profit: revenue after discount minus 1.4 times the list value."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(10,2)").alias("price"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").alias("date"), F.col("l_extendedprice").cast(MONEY).alias("sales"),
        F.col("l_quantity").cast("decimal(8,2)").alias("quantity"), F.col("l_discount").cast("decimal(4,2)").alias("discount"),
    )
    revenue = F.col("sales") * (F.lit(1).cast("decimal(3,2)") - F.col("discount"))
    cost = F.lit("1.4").cast("decimal(2,1)") * F.col("quantity") * F.col("price")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "date", "sales", "quantity", F.col("l_partkey").cast("string").alias("product"),
        (revenue - cost).cast("decimal(18,5)").alias("profit"),
    )


def sales_with_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-level sales with a stock reading on most rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("date"), F.col("l_extendedprice").cast(MONEY).alias("sales"),
        F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_partkey").cast("string").alias("product"),
        F.when(F.col("l_returnflag") != "N", ((F.col("l_linenumber") - 2) * 15).cast("double")).alias("current_stock"),
    )


def stock_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"),
        ((F.col("p_size") - 1) * 10).cast("double").alias("current_stock"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events with their time of day."""
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.col("ts").alias("date"), F.col("value").cast(MONEY).alias("sales")
    )


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an all-text upload: dates in seven shapes with the day first, unreadable and missing values,
    a numeric column that is named like a product, and some very large amounts."""
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")

    def shaped(pattern: str):
        return F.date_format("l_shipdate", pattern)

    dates = (
        F.when((number == 7) & (flag == "N"), "unknown").when(number == 1, shaped("dd/MM/yyyy")).when(number == 2, shaped("dd-MM-yyyy HH:mm"))
        .when(number == 3, F.concat(shaped("d/M/yyyy"), F.lit(" 03:05 PM"))).when(number == 4, shaped("MMM d, yyyy"))
        .when(number == 5, shaped("d MMMM yyyy")).when(number == 6, shaped("d.M.yy")).otherwise(shaped("yyyy-MM-dd"))
    )
    large = (number == 1) & (F.col("l_orderkey") % 1000 == 1)
    return table(spark, sf_dir, "lineitem").select(
        dates.alias("order_date"),
        F.col("l_suppkey").cast("string").alias("item_price"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_code"),
        F.when((number == 6) & (flag == "A"), "n/a").when(large, "12345678901.557")
        .otherwise(F.col("l_extendedprice").cast(MONEY).cast("string")).alias("sale_amount"),
        F.when((number == 5) & (flag == "R"), "12d").when((number == 4) & (flag == "R"), F.lit(None))
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty"),
        F.when(number != 3, ((F.col("l_suppkey") % 50)).cast("string")).alias("stock_level"),
    )


# Wide enough for any amount that an upload may hold, with room for its decimals.
WIDE = "decimal(38,6)"

UPLOAD_MAPPING = {
    "date": "order_date", "sales": "sale_amount", "quantity": "qty", "product": "item_code", "current_stock": "stock_level",
}
