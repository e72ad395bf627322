"""SimHash near-duplicates through covering locality-sensitive hashing.

Position i of a fingerprint gets a nonzero vector m(i) of r + 1 bits. For each nonzero v of r + 1 bits, mask v
keeps the positions whose m(i) has an odd product with v. The at most r positions in which a pair differs give at
most r vectors, so some v is orthogonal to all of them: its mask drops exactly these positions and the pair meets
in bucket (v, masked fingerprint). No pair within the radius is lost.

Work is on distinct fingerprints. A bucket of two is compared by its smallest and largest member, one of up to
``cell`` members inside its group, and of these only links that join something leave the task. In a larger bucket
(only dense balls of near copies make one) each member names itself and its neighbours at one flip of a dropped
bit: two members are within two flips exactly if they name a point in common, so linking every member of a point
to the smallest one gives the same components from rows in proportion to the members. That form is for radius 2;
other radii split a larger bucket into blocks and compare all pairs of blocks.

Defined results: words are cut at ASCII white space and A-Z made small; fewer than three words make one shingle
of all; null, empty and blank texts have fingerprint zero and link like any other; repeated rows and equal ids are
rows of their own; the component of rows with null ids alone is null; empty tables give no rows; further columns
are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.textkit import settle, slices

BITS = 64
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end at white space, so that a long one is never held as a list of words."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end]
        start = end


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer."""
    counts = np.zeros(BITS, np.int64)
    total, carry = 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(text.lower()):
        words = carry + piece.split()
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends, at = [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *[e + 1 for e in ends]]
            hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
            for begin in range(0, len(hashes), 1 << 14):
                some = hashes[begin : begin + (1 << 14)]
                counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            words = words[len(words) - shingle + 1 :]
        carry = words
    if not total and carry:
        return digest(b" ".join(carry), seed)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(t, shingle, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks of a radius as signed 64-bit integers, 2^(r+1) - 1 of them."""
    size = 2 ** (radius + 1) - 1
    rows = [1 + i % size for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (rows[i] & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def joining(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs within the radius that join the members of one group: a spanning forest of all such pairs."""
    root = list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        a, b = top(i), top(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _compare(radius: int):
    """Links inside the buckets of partitions that are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys, done = _edges(table)
            rest = table.slice(keys[-1])
            yield _links(done, keys[:-1], keys[-1], radius)
        if rest is not None and rest.num_rows:
            keys, done = _edges(rest)
            yield _links(done, keys, rest.num_rows, radius)

    return run


def _edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    bucket = np.stack([table.column(c).to_numpy() for c in ("v", "key", "i", "j")])
    change = np.flatnonzero((bucket[:, 1:] != bucket[:, :-1]).any(axis=0)) + 1
    return np.r_[0, change], table.column("fp").to_numpy()


def _links(values: np.ndarray, starts: np.ndarray, end: int, radius: int) -> pa.RecordBatch:
    a, b = [], []
    for s, e in zip(starts.tolist(), [*starts.tolist()[1:], end]):
        group = values[s:e]
        for i, j in joining(group.view(np.uint64), radius):
            a.append(int(group[i]))
            b.append(int(group[j]))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(prints: DataFrame, radius: int = 2, cell: int = 64) -> DataFrame:
    """``a, b``: pairs of the distinct fingerprints ``fp`` within the radius that give its components."""
    cover = masks(radius)
    # Each mask comes with the single flips of the bits that it drops.
    family = [(v, m, [_signed(1 << i) for i in range(BITS) if not m >> i & 1]) for v, m in enumerate(cover)]
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m, _ in family])
    members = prints.select("fp", F.explode(tables).alias("b")).select("b.v", "b.key", "fp")
    buckets = settle(members.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    out = buckets.where("n = 2").where(near).select("a", "b")
    crowded = settle(members.join(buckets.where("n > 2").select("v", "key", "n"), ["v", "key"]))

    blocks = F.when(F.col("n") > cell, F.ceil(2 * F.col("n") / cell)).otherwise(1).cast("int")
    small = crowded if radius != 2 else crowded.where(F.col("n") <= cell)
    # Members of a larger bucket are dealt to blocks; each pair of blocks is a group of about ``cell`` members.
    own = F.pmod(F.xxhash64("fp", "v"), blocks).cast("int")
    small = small.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    small = small.select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    group = ["v", "key", "i", "j"]
    out = out.union(small.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(radius), "a long, b long"))
    if radius == 2:
        # The points that a member names: itself and its flips at the positions that its mask drops.
        flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x) for x in free]) for _, _, free in family]), F.col("v") + 1)
        named = crowded.where(F.col("n") > cell).select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
        lowest = named.groupBy("point").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
        out = out.union(named.join(lowest.select("point", "low"), "point").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct())
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, cell: int = 64) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``doc_id, text``."""
    prints = settle(fingerprints(docs, shingle, seed))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    comp = settle(components(links(nodes.select("fp"), radius, cell)))
    # Only linked fingerprints are named by a component other than themselves.
    linked = nodes.join(comp.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("comp").agg(F.min("low").alias("component_id"))
    placed = linked.join(lowest, "comp").select("fp", "component_id")
    labels = settle(nodes.join(placed.withColumn("moved", F.lit(True)), "fp", "left").select("fp", "n", F.when(F.col("moved"), F.col("component_id")).otherwise(F.col("low")).alias("component_id")))
    total = nodes.agg(F.sum("n").alias("n")).first().n or 0
    # A fingerprint with over a thousandth of all rows: at most 999 of these, so they can be sent everywhere.
    often = labels.where(F.col("n") * 1000 > total).select("fp", F.col("component_id").alias("sent"), F.lit(True).alias("hot"))
    named = prints.join(F.broadcast(often), "fp", "left")
    rare = named.where("hot is null").select("doc_id", "fp").join(labels.select("fp", "component_id"), "fp")
    both = named.where("hot").select("doc_id", "fp", F.col("sent").alias("component_id")).unionByName(rare.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(value: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
