"""Distinct counts that merge: a sketch for each file and column, kept and united.

A column suits as a product list if it has more than two different values, and fewer than ``DISTINCT_RATE`` of its rows.
Its sketches tell this for a grown folder without reading old files again.  Where the estimate lies so near the border that
the sketch can't tell, the exact count of that column decides; so decisions are those of exact counts.

Nulls are no values, an empty string is one.  A table without rows has no suitable column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.ingest import DISTINCT_RATE
from tallyspark.schemas import require_columns

# 2^14 registers: a standard error of 0.8 % in about 16 KB a sketch.  An estimate within four of them of the border is not trusted.
LG_REGISTERS = 14
MARGIN = 4 * 1.04 / 2 ** (LG_REGISTERS / 2)
LEAST = 2

STORE_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("n_values", T.LongType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("file_key", T.StringType()),
])


def sketch_columns(df: DataFrame, columns: Sequence[str], part: Column | None = None) -> DataFrame:
    """``file_key, column_name, n_rows, n_values, sketch``: one row for each part and column, from one scan that combines on the map side."""
    require_columns(df, columns)
    measures = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(columns):
        # The mark in front makes the empty string a value; sketches leave it out otherwise.
        value = F.concat(F.lit("="), F.col(name).cast("string"))
        measures += [F.count(name).alias(f"v{i}"), F.hll_sketch_agg(value, LG_REGISTERS).alias(f"s{i}")]
    rows = [
        F.struct(F.lit(name).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"v{i}").alias("n_values"), F.col(f"s{i}").alias("sketch"))
        for i, name in enumerate(columns)
    ]
    parts = df.groupBy((F.lit("") if part is None else part).alias("file_key")).agg(*measures)
    return parts.select("file_key", F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_values, n_estimate`` over all parts."""
    return sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimate")
    )


def distinct_decisions(sketches: DataFrame, rows: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_values, n_estimate, counted, suits`` of each column of the sketches.

    One row a column is read back; ``rows`` is scanned for the columns near the border alone (``counted``), and not at all without them.
    """
    spark = sketches.sparkSession
    facts = merge_sketches(sketches).collect()
    near = [r.column_name for r in facts if abs(r.n_estimate - DISTINCT_RATE * r.n_rows) <= MARGIN * r.n_estimate]
    exact = rows.agg(*[F.count_distinct(name).alias(name) for name in near]).first() if near else {}
    out = []
    for r in facts:
        distinct = exact[r.column_name] if r.column_name in near else r.n_estimate
        out.append((r.column_name, r.n_rows, r.n_values, r.n_estimate, r.column_name in near, LEAST < distinct < DISTINCT_RATE * r.n_rows))
    return spark.createDataFrame(out, "column_name string, n_rows long, n_values long, n_estimate long, counted boolean, suits boolean")


def _file_key(path: Column, changed: str, size: str) -> Column:
    return F.sha2(F.concat_ws("|", path, F.unix_micros(F.col(changed)), F.col(size)), 256)


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """``path, file_key`` of the files under a path; contents are not read.  A replaced file has a new key."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", _file_key(F.col("path"), "modificationTime", "length").alias("file_key"))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The kept sketches; none while nothing has been written."""
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


def new_files(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The files without kept sketches."""
    return list_files(spark, path).join(read_store(spark, store).select("file_key").distinct(), "file_key", "left_anti")


def refresh_sketches(spark: SparkSession, path: str, store: str, columns: Sequence[str]) -> DataFrame:
    """Sketches of the files that are there now; only new or replaced files are read.

    Each file has a folder of its own in the store, which a repeated or retried run writes anew.  The names of the new files
    pass through the driver.  Files without rows have no sketch; those that are gone no longer count.
    """
    names = [r.path for r in new_files(spark, path, store).select("path").collect()]
    if names:
        # Here the path comes with percent signs for spaces and the like; a plus stands for itself.
        path_read = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        key = _file_key(path_read, "_metadata.file_modification_time", "_metadata.file_size")
        found = sketch_columns(spark.read.parquet(*names), columns, key)
        found.write.partitionBy("file_key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(store)
    wanted = read_store(spark, store).filter(F.col("column_name").isin(list(columns)))
    return wanted.join(list_files(spark, path).select("file_key"), "file_key", "left_semi")
