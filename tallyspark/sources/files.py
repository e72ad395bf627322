"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with every column as text, so that coercion stays with the ingest operators."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if df.isEmpty():
        raise ValueError(f"The file is empty: {path}")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by file extension (a folder without extension is read as Parquet)."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path)
    if name.endswith(".parquet") or "." not in name:
        df = spark.read.parquet(path)
        if df.isEmpty():
            raise ValueError(f"The file is empty: {path}")
        return df
    raise ValueError(f"Unsupported file type: {name}")


def export_safe(df: DataFrame, max_rows: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """Display table: dates as ``yyyy-MM-dd``, other non-numbers as text, first rows only."""
    def shown(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(col, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            return col
        return col.cast("string").alias(field.name)

    # Order before the projection, so that the limit plans as one TakeOrderedAndProject.
    rows = df.orderBy(*order_by) if order_by else df
    return rows.limit(max_rows).select(*[shown(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Recommendation tables as headed CSV; one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)
