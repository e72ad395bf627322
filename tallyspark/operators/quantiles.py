"""Exact quantiles of columns too large for one task.

``percentile`` holds every value of a group in one task.  Here each pass counts the values inside the bracket of a
wanted rank by ``CELLS`` cells, keeps the cell that holds the rank and shrinks the bracket to the least and greatest
value of that cell.  What reaches the driver is one row per cell and rank, whatever the number of values; a pass over
the table cuts a bracket about a thousandfold, and it always cuts off its ends, so it ends at one value.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1024
GREATEST = sys.float_info.max


def _cell(value: Column, low: float, high: float) -> Column:
    """The cell of a value in its bracket: never less for a greater value, so cells are in order."""
    infinity = float("inf")
    low, high = max(low, -GREATEST), min(high, GREATEST)
    # Halves keep the difference finite at the ends of the number range; infinite values have cells of their own.
    share = (value / 2 - low / 2) / (high / 2 - low / 2) if high > low else F.lit(0.0)
    inner = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
    return F.when(value == -infinity, -1).when(value == infinity, CELLS).otherwise(inner)


def ranked_values(df: DataFrame, value: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at some ranks (from 0) of the non-null values of a column, in ascending order."""
    values = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    # Rank, bracket, and how many values lie beneath the bracket.
    open_ = {r: (ends.low, ends.high, 0) for r in set(ranks)}
    found: dict[int, float] = {}
    while open_:
        found |= {r: low for r, (low, high, _) in open_.items() if low == high}
        open_ = {r: b for r, b in open_.items() if r not in found}
        if not open_:
            break
        brackets = sorted(set(open_.values()))
        cells = [
            F.when(F.col("v").between(low, high), F.struct(F.lit(i).alias("bracket"), _cell(F.col("v"), low, high).alias("cell"))) for i, (low, high, _) in enumerate(brackets)
        ]
        placed = values.select("v", F.explode(F.array_compact(F.array(*cells))).alias("at"))
        counted = placed.groupBy("at.bracket", "at.cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        rows = sorted(counted.collect(), key=lambda x: (x.bracket, x.cell))
        for r, bracket in list(open_.items()):
            beneath = bracket[2]
            for x in rows:
                if x.bracket != brackets.index(bracket):
                    continue
                if r < beneath + x.n:
                    open_[r] = (x.low, x.high, beneath)
                    break
                beneath += x.n
    return found


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """``share, quantile``: linear interpolation between neighbouring values, as ``percentile`` does; null without values."""
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie between 0 and 1")
    n = df.select(F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("n")).first().n
    places = {s: s * (n - 1) for s in shares}
    known = ranked_values(df, value, [f(p) for p in places.values() for f in (math.floor, math.ceil)]) if n else {}
    rows = []
    for s, p in places.items():
        low, high = known.get(math.floor(p)), known.get(math.ceil(p))
        rows.append((float(s), None if low is None else low + (high - low) * (p - math.floor(p))))
    return df.sparkSession.createDataFrame(rows, "share double, quantile double")


def raw_fences(df: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """The table with ``is_outlier``: beyond ``reach`` quartile distances of the quartiles of all its rows."""
    lower, upper = (r.quantile for r in exact_quantiles(df, value, (0.25, 0.75)).collect())
    if lower is None:
        return df.withColumn("is_outlier", F.lit(False))
    span = reach * (upper - lower)
    return df.withColumn("is_outlier", F.coalesce((F.col(value) < lower - span) | (F.col(value) > upper + span), F.lit(False)))
