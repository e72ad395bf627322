"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textkit import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``u > v``: links of each node move to the smallest of its neighbours."""
    if large:
        around = edges.union(edges.select("v", "u")).toDF("node", "other")
    else:
        around = edges.toDF("node", "other")
    low = around.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    moved = around.join(low, "node")
    if large:
        moved = moved.where("other > node").select(F.col("other").alias("u"), F.col("low").alias("v"))
    else:
        moved = moved.select(F.col("other").alias("u"), F.col("low").alias("v")).union(low.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node with a link; ``comp`` is the smallest node of the component.

    ``links`` holds two long columns ``a, b``. Each step is a partial aggregation and a join that adaptive
    execution can split, so a node with very many links is no bottleneck. Steps repeat until nothing
    moves, which takes about the logarithm of the longest chain.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == state or not row.n:
            break
        state = (row.n, row.s)
        edges = settle(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct()).groupBy("node").agg(F.min("comp").alias("comp"))
