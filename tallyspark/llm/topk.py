"""Exact top-k inner products by the three-phase uniform threshold.

Each vector is split into ``lists`` blocks of dimensions, and each block is a list of its own: it scores
every (query, vector) with the inner product of that block, and the score of a vector is the sum over the
lists. Lists are spread over shards of vectors; queries come in blocks. A cell is one (list, shard, block
of queries), the unit of work of one task, and is bounded by ``shard`` and ``block`` rows.

1. Every cell gives the ``heads`` best entries of each query, and the lowest score it has. Per query and
   list the lowest score is the floor; scores over their floor are never negative. The named vectors get
   their whole scores, and the k-th largest of these is a bound that the result reaches or passes.
2. The cutoff: a vector that stays below floor + (bound - sum of floors) / lists in every list cannot
   reach the bound. The cutoffs join the cells again, which give every entry that reaches its cutoff.
3. Entries of one vector are added up. With the cutoff as upper bound of a missing list, vectors that
   still cannot reach the bound go; the missing scores of the others are computed from their blocks, and
   the k best whole sums are the result.

Scores are integers: components are floored after scaling. Sums that might leave the exact range of
doubles are added as 64-bit integers; scores must fit those. Ties go to the smaller id. A vector without
an id, null, or with a null or non-finite component takes no part. Shorter vectors count as padded with
zeros. Repeated rows count once; of different vectors under one id the smallest in order takes part.
Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.textkit import settle

# Queries whose scores one numpy pass holds.
QUERIES = 64


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: one row an id, components floor(scale * x) as long; vectors that take no part are left out."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    floored = kept.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))
    return floored.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(rows: pd.Series) -> np.ndarray:
    size = rows.str.len().to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    out = np.zeros((len(rows), size.max(initial=0)), np.int64)
    if size.sum():
        out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(rows.to_list())
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices: as floats where they hold every sum, else as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if bound < 2.0**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 2.0**53:
        return a.astype(float) @ b.astype(float).T
    return a @ b.T


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, lists: int = 2, shard: int = 16384, block: int = 2048, heads: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other vectors for each query (ids divisible by ``every``)."""
    heads = max(heads, k)
    spark = vectors.sparkSession
    whole = settle(integers(vectors, scale))
    size = whole.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("d")).first()
    shards, blocks, width = -(-size.n // shard), -(-size.q // block), -(-(size.d or 0) // lists)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not shards or not blocks:
        return empty
    # Ids are dealt by hash, so that neither order nor gaps in them make a cell large.
    parts = F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda i: F.struct(i.alias("list"), F.slice("v", i * max(width, 1) + 1, max(width, 1)).alias("part")))
    pieces = settle(whole.select("vec_id", F.inline(parts)))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    queries = pieces.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    # Columns of their own: both sides of a cogroup come from one table.
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("list").alias("qlist"), F.col("part").alias("qpart"), "block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select("query_id", F.col("qlist").alias("list"), F.col("qpart").alias("part"), F.col("block").alias("block"), every_shard)
    offered = pieces.withColumn("shard", spread).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = ["list", "shard", "block"]

    def named(key, asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        ids = offered["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids)
        ids, right, left = ids[order], matrix(offered["part"])[order], matrix(asked["part"])
        out = []
        for at in range(0, len(asked), QUERIES):
            scores = product(left[at : at + QUERIES], right)
            for query, score in zip(asked["query_id"][at : at + QUERIES], scores, strict=True):
                mine = np.flatnonzero(ids != query)
                if not len(mine):
                    continue
                low, score = score[mine].min(), score[mine]
                best = np.argpartition(-score, heads)[:heads] if len(score) > heads else np.arange(len(score))
                out.append((key[0], query, ids[mine[best]].tolist(), score[best].astype(np.int64).tolist(), int(low)))
        return pd.DataFrame(out, columns=["list", "query_id", "ids", "scores", "low"])

    of_vector = pieces.select("vec_id", "list", F.col("part").alias("mine"))
    of_query = queries.select("query_id", F.col("qlist").alias("list"), F.col("qpart").alias("wanted"))
    dot = F.aggregate(F.zip_with("mine", "wanted", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    every_list = F.sequence(F.lit(0), F.lit(lists - 1))

    def resolved(lacking: DataFrame) -> DataFrame:
        """The scores of ``query_id, vec_id, list`` rows, added up."""
        both = lacking.join(of_vector, ["vec_id", "list"]).join(of_query, ["query_id", "list"])
        return both.groupBy("query_id", "vec_id").agg(F.sum(dot).alias("rest"))

    first = settle(asked.groupBy(*cell).cogroup(offered.groupBy(*cell)).applyInPandas(named, "list int, query_id long, ids array<long>, scores array<long>, low long"))
    floors = first.groupBy("query_id", "list").agg(F.min("low").alias("floor"))
    heard = first.select("query_id", "list", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    heard = heard.groupBy("query_id", "vec_id").agg(F.sum("score").alias("seen"), F.collect_set("list").alias("have"))
    rest = resolved(heard.select("query_id", "vec_id", F.explode(F.array_except(every_list, "have")).alias("list")))
    sums = heard.join(rest, ["query_id", "vec_id"], "left").select("query_id", (F.col("seen") + F.coalesce("rest", F.lit(0).cast("long"))).alias("known"))
    best = Window.partitionBy("query_id").orderBy(F.desc("known"))
    bound = sums.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("known").alias("bound"))
    # Whole numbers: an excess reaches its share if and only if it reaches the next whole number. Without k vectors nothing is cut.
    base = floors.groupBy("query_id").agg(F.sum("floor").alias("base"))
    share = F.col("bound") - F.col("base")
    cutoffs = settle(
        floors.join(base, "query_id").join(bound, "query_id", "left")
        .select("query_id", "list", "bound", (F.col("floor") + F.coalesce(share.try_cast("decimal(38,0)") / lists, F.lit(0))).alias("edge"))
        .select("query_id", "list", "bound", F.ceil("edge").cast("long").alias("cutoff"))
    )
    told = queries.join(cutoffs.select("query_id", F.col("list").alias("qlist"), "cutoff"), ["query_id", "qlist"]).select(
        "query_id", F.col("qlist").alias("list"), F.col("qpart").alias("part"), F.col("block").alias("block"), "cutoff", every_shard
    )

    def entries(key, asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, right, left = offered["vec_id"].to_numpy(np.int64), matrix(offered["part"]), matrix(asked["part"])
        cutoff = asked["cutoff"].to_numpy(np.int64)
        for at in range(0, len(asked) if len(ids) else 0, QUERIES):
            scores = product(left[at : at + QUERIES], right)
            enough = scores >= cutoff[at : at + QUERIES, None]
            for i, query in enumerate(asked["query_id"][at : at + QUERIES]):
                reach = np.flatnonzero(enough[i])
                reach = reach[ids[reach] != query]
                out.append((key[0], query, ids[reach].tolist(), scores[i][reach].astype(np.int64).tolist()))
        return pd.DataFrame(out, columns=["list", "query_id", "ids", "scores"])

    second = settle(
        told.groupBy(*cell).cogroup(offered.groupBy(*cell)).applyInPandas(entries, "list int, query_id long, ids array<long>, scores array<long>")
    )
    sent = second.select("query_id", "list", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    limits = cutoffs.groupBy("query_id").agg(F.max("bound").alias("bound"), F.map_from_entries(F.collect_list(F.struct("list", "cutoff"))).alias("limits"))
    partial = sent.groupBy("query_id", "vec_id").agg(F.sum("score").alias("seen"), F.collect_set("list").alias("have"))
    limited = partial.join(limits, "query_id").withColumn("missing", F.array_except(every_list, "have"))
    reach = F.aggregate("missing", F.col("seen"), lambda s, x: s + F.col("limits")[x] - 1)
    open_ = settle(limited.where(F.col("bound").isNull() | (reach >= F.col("bound"))).select("query_id", "vec_id", "seen", "missing"))
    rest = resolved(open_.select("query_id", "vec_id", F.explode("missing").alias("list")))
    total = open_.join(rest, ["query_id", "vec_id"], "left").select("query_id", "vec_id", (F.col("seen") + F.coalesce("rest", F.lit(0).cast("long"))).alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return total.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
