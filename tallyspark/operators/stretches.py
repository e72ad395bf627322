"""Windows over one long series in many tasks.

A window without keys would bring the whole series into one task.  Here the series is cut into stretches of
consecutive rows, and each stretch is sent the few rows before and after it that its frames reach.  Only the number of
rows (or the first day) of each span of days is gathered, one entry for every ``STRETCH`` days of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators.rollups import shared

STRETCH = 1024
# Rows without a date come first, as in an ordered window.
UNDATED = -(2**31)


def span_of(date: str, stretch: int) -> Column:
    days = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date"))
    return F.coalesce(F.floor(days / stretch).cast("int"), F.lit(UNDATED))


def windowed(
    rows: DataFrame, keys: Sequence[str], date: str, before: int, after: int, build: Callable[[WindowSpec], dict[str, Column]],
    stretch: int = STRETCH,
) -> DataFrame:
    """Rows with the columns that ``build`` makes over an ordered window; no frame reaches beyond ``before`` and ``after`` rows.

    With keys each series is one partition.  Without keys the stretches are, and results are the same as over the whole series.
    """
    if keys:
        return rows.withColumns(build(W.partitionBy(*keys).orderBy(date)))
    size = max(stretch, before, after)
    marked = shared(rows).withColumn("_span", span_of(date, stretch))
    sizes = marked.groupBy("_span").agg(F.count(F.lit(1)).alias("_n")).agg(F.collect_list(F.struct("_span", "_n")).alias("sizes")).scalar()
    earlier = F.aggregate(F.filter("_sizes", lambda s: s["_span"] < F.col("_span")), F.lit(0).cast("long"), lambda a, s: a + s["_n"])
    place = F.row_number().over(W.partitionBy("_span").orderBy(date)) - 1
    placed = marked.withColumn("_sizes", sizes).withColumn("_place", earlier + place).drop("_sizes", "_span")
    own, inside = F.floor(F.col("_place") / size), F.col("_place") % size
    targets = F.array_compact(F.array(own, F.when(inside >= size - before, own + 1), F.when(inside < after, own - 1)))
    spread = placed.withColumn("_stretch", F.explode(targets))
    return spread.withColumns(build(W.partitionBy("_stretch").orderBy("_place"))).filter(F.col("_stretch") == own).drop("_stretch", "_place")


def with_next_date(rows: DataFrame, keys: Sequence[str], date: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """Rows with the date of the next row of their series; null on the last."""
    if keys:
        return rows.withColumn(name, F.lead(date).over(W.partitionBy(*keys).orderBy(date)))
    marked = shared(rows).withColumn("_span", span_of(date, stretch))
    firsts = marked.groupBy("_span").agg(F.min(date).alias("_first")).agg(F.collect_list(F.struct("_span", "_first")).alias("firsts")).scalar()
    later = F.array_min(F.transform(F.filter("_firsts", lambda s: s["_span"] > F.col("_span")), lambda s: s["_first"]))
    inside = F.lead(date).over(W.partitionBy("_span").orderBy(date))
    return marked.withColumn("_firsts", firsts).withColumn(name, F.coalesce(inside, later)).drop("_firsts", "_span")


def count_rows(rows: DataFrame, keys: Sequence[str]) -> Column:
    """Number of rows of the series, on each of them: a window with keys, a scalar subquery without."""
    if keys:
        return F.count(F.lit(1)).over(W.partitionBy(*keys))
    return shared(rows).agg(F.count(F.lit(1)).alias("n")).scalar()
