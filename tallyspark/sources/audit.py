"""Upload audit log: one Parquet row per ingest, in a folder of its own.

A folder is named by the upload, and its files appear when the write is committed.  So an append that is repeated, or
tried again after a failure, leaves one row, and uploads that are logged at the same time do not meet.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import AUDIT_SCHEMA


def audit_entry(
    processed: DataFrame,
    filename: str,
    timestamp: dt.datetime | str,
    original_columns: list[str],
    mapped_columns: dict[str, str | None],
) -> DataFrame:
    """The log row of one ingest; the row count is taken when the row is written."""
    pairs = [F.lit(x) for k, v in mapped_columns.items() for x in (k, v if v is not None else "None")]
    return processed.agg(F.count(F.lit(1)).alias("rows_processed")).select(
        F.lit(filename).alias("filename"),
        F.lit(str(timestamp)).cast("timestamp_ntz").alias("timestamp"),
        F.col("rows_processed"),
        F.array(*[F.lit(c) for c in original_columns]).alias("original_columns"),
        F.create_map(*pairs).alias("mapped_columns"),
    )


def upload_key(entry: DataFrame) -> str:
    """The key of an entry: its file, time and columns, without the row count."""
    facts = [F.col("filename"), F.col("timestamp").cast("string"), F.to_json(F.struct("original_columns", "mapped_columns"))]
    return entry.select(F.sha2(F.concat_ws("|", *facts), 256).alias("key")).first().key


def append_audit(entry: DataFrame, path: str, upload_id: str | None = None) -> None:
    """Log an upload; with the same ``upload_id`` (default: the entry's own key) the row is written again, not added."""
    key = upload_id if upload_id is not None else upload_key(entry)
    folder = hashlib.sha256(key.encode()).hexdigest()
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/upload-{folder}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log in order of time, entries of all uploads."""
    return spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", "true").parquet(path).orderBy("timestamp", "filename")
