"""Table contracts shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SALES_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType(), False),
    T.StructField("sales", T.DoubleType(), False),
    T.StructField("quantity", T.DoubleType(), False),
    T.StructField("product", T.StringType(), False),
    T.StructField("current_stock", T.DoubleType(), True),
])

OPTIONAL_SALES_FIELDS = T.StructType([
    T.StructField("profit", T.DoubleType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("customer_id", T.StringType(), True),
])

STOCK_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("current_stock", T.DoubleType(), True),
])

FORECAST_SCHEMA = T.StructType([
    T.StructField("series_key", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("yhat", T.DoubleType(), True),
    T.StructField("yhat_lower", T.DoubleType(), True),
    T.StructField("yhat_upper", T.DoubleType(), True),
    T.StructField("model", T.StringType(), False),
])

INSIGHT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("recommendation", T.StringType(), True),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("impact", T.DoubleType(), True),
    T.StructField("type", T.StringType(), False),
])

PAGE_ALERT_SCHEMA = T.StructType([
    T.StructField("alert_date", T.TimestampNTZType(), True),
    T.StructField("type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("product", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("details", T.MapType(T.StringType(), T.StringType()), True),
])

# Columns every module-flavour alert can be read with; measures are added per alert kind.
MODULE_ALERT_CORE = T.StructType([
    T.StructField("alert_type", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("product_id", T.StringType(), True),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("rows_processed", T.LongType(), False),
    T.StructField("original_columns", T.ArrayType(T.StringType()), True),
    T.StructField("mapped_columns", T.MapType(T.StringType(), T.StringType()), True),
])


def require_columns(df: DataFrame, columns: Iterable[str], where: str = "") -> None:
    """Raise ``ValueError`` before any plan is built when a column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        place = f" in {where}" if where else ""
        raise ValueError(f"Missing required columns{place}: {missing}")


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed nulls."""
    from pyspark.sql import functions as F

    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(absent) if absent else df
