"""Near duplicates by BagMinHash over multisets of word shingles, then exact multiset overlap.

Signatures. The weight axis of every shingle is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) ...
Each interval has a Poisson process of its own, seeded by shingle and interval, whose rate is the length
of the interval; each point carries a uniform position in the interval and a uniform register. A text
holds the points that lie below the weight of their shingle, so a shingle that occurs a thousand times
costs eleven processes and not a thousand. Each register keeps its earliest point: two texts agree in a
register with the probability of their weighted Jaccard similarity, without bias. Processes are followed
only to a horizon at which all registers of the text are expected to be filled, and further for the few
texts where one is not, so that work is in proportion to shingles plus registers.

Groups. Equal multisets collapse to one node first, so exact copies cost one row each. Nodes that agree
in all registers of a band meet in a bucket. Within a bucket the members are first compared with one of
them, not with each other; links between them are checked against the exact multiset Jaccard similarity
and joined to components. Buckets that still hold members of several components are then searched inside
their tasks, without a row for any pair: numpy compares the registers of all members of a cell, only
members close to one of another component go on (four standard deviations below the similarity; 0.003 %
of pairs at similarity 0.8 are further), and their exact overlaps, counted over posting lists, give the
links that join components. A cell has at most ``2 * cell`` members; larger buckets are cut into blocks,
and every pair of blocks is a cell. So no link between different texts is lost but by the signature.

A text of fewer than ``shingle`` words has one shingle of all its words. Texts without words (null or
empty ones included) resemble nothing and stay alone. Repeated rows belong to one class. The class id is
the smallest ``doc_id`` of the class; a class of which all ids are null has the id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.textkit import Words, mix, row_key, settle, shingles, slices

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, sorted by row and hash; short texts have one shingle of all words."""
    hashes, at = shingles(words.hash, words.doc, n)
    doc = words.doc[at]
    counts = np.bincount(words.doc, minlength=len(words.offsets) - 1)
    first = words.first()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            own[has] = mix(own[has] + words.hash[first[short[has]] + k] + _GOLD)
        hashes, doc = np.concatenate([hashes, own]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    return hashes[order], doc[order]


def signatures(hashes: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """(docs, registers) earliest times; infinite where a text has no shingle. Sorted input as of ``bags``."""
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | np.append(True, hashes[1:] != hashes[:-1])[: len(doc)])
    weight = np.diff(np.append(new, len(doc)))
    seed, owner = hashes[new], doc[new]
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # intervals beyond the first
    level = np.concatenate([np.zeros(len(new), np.int64), np.concatenate([np.full((top >= k).sum(), k) for k in range(1, int(top.max(initial=0)) + 1)] or [np.zeros(0, np.int64)])])
    which = np.concatenate([np.arange(len(new)), *[np.flatnonzero(top >= k) for k in range(1, int(top.max(initial=0)) + 1)]])
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    share = np.where(level == 0, 1.0, (weight[which] - rate) / rate)  # part of the interval below the weight
    state = mix(seed[which] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    owner = owner[which]
    total = np.bincount(doc, minlength=docs).astype(float)
    horizon = np.where(total > 0, registers * (np.log(registers) + 3) / np.maximum(total, 1), 0.0)
    out = np.full(docs * registers, np.inf)
    time = np.zeros(len(which))
    open_ = np.arange(len(which))
    while True:
        active = open_
        waiting = []
        while len(active):
            state[active] += _GOLD
            draw = mix(state[active])
            gap = -np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53) / rate[active]
            now = time[active] + gap
            late = now > horizon[owner[active]]
            state[active[late]] -= _GOLD  # that point is drawn again if the horizon moves
            waiting.append(active[late])
            active, now, draw = active[~late], now[~late], draw[~late]
            time[active] = now
            spot = mix(draw ^ np.uint64(0xA0761D6478BD642F))
            register = ((spot >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            held = (spot & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 < share[active]
            np.minimum.at(out, owner[active[held]] * registers + register[held], now[held])
        grid = out.reshape(docs, registers)
        more = np.isinf(grid).any(1) & (total > 0)
        if not more.any():
            return grid
        horizon[more] *= 2
        open_ = np.concatenate(waiting)
        open_ = open_[more[owner[open_]]]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of two sorted arrays."""
    values, counts_a = np.unique(a, return_counts=True)
    other, counts_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, other, assume_unique=True, return_indices=True)
    shared = np.minimum(counts_a[i], counts_b[j]).sum()
    return float(shared / (len(a) + len(b) - shared)) if len(a) + len(b) else 0.0


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, rk, bag, bands, registers`` of each row of ``doc_id, rk, text``: multiset key, band hashes, 16 bits a register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            hashes, doc = bags(Words(batch.column(2)), shingle)
            keys = np.zeros((n, 2), np.uint64)
            np.add.at(keys[:, 0], doc, mix(hashes + np.uint64(1)))
            np.add.at(keys[:, 1], doc, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
            grid = signatures(hashes, doc, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
            short = (mix(grid) & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, -1)
            registers = pa.array([r.tobytes() if h else None for r, h in zip(short, np.bincount(doc, minlength=n) > 0, strict=True)], pa.binary())
            folded = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
            for k in range(rows):
                folded = mix(folded * np.uint64(0x9E3779B97F4A7C55) + grid[:, :, k])
            has = np.bincount(doc, minlength=n) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(folded.view(np.int64).ravel()))
            keyed = pa.array([k.tobytes() if h else None for k, h in zip(keys, has, strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), keyed, lists, registers], names=["doc_id", "rk", "bag", "bands", "registers"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "rk", "text").mapInArrow(run, f"doc_id {kind}, rk binary, bag binary, bands array<long>, registers binary")


def payloads(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, bag``: the sorted shingle hashes of the wanted nodes."""
    rows = nodes.join(wanted.distinct(), "node").select("node", "rk")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, doc = bags(Words(batch.column(1)), shingle)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            payload = pa.array([hashes[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
            yield pa.record_batch([batch.column(0), payload], names=["node", "bag"])

    # A repeated row comes once for each time it is there: one of them is enough.
    texts = docs.join(rows, "rk").select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    return settle(texts.mapInArrow(shingled, "node long, bag binary"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose multisets reach the similarity."""
    bag = payloads(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, nodes, shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity for x, y in zip(left, right, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    both = pairs.join(bag.toDF("a", "bag_a"), "a").join(bag.toDF("b", "bag_b"), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(compare, "a long, b long")


def close_members(comp: np.ndarray, registers: np.ndarray, least: float) -> np.ndarray:
    """Which members agree in ``least`` registers with a member of another component."""
    out = np.zeros(len(comp), bool)
    for i in range(0, len(comp), 32):
        agree = (registers[i : i + 32, None, :] == registers[None]).sum(2)
        agree[comp[i : i + 32, None] == comp[None]] = 0
        out[i : i + 32] = agree.max(1) >= least
    return out


def joining_links(comp: np.ndarray, bag: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between members of different components, as many as it takes to join them."""
    size = np.array([len(x) for x in bag])
    owner = np.repeat(np.arange(len(bag)), size)
    hashes = np.concatenate(bag)
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    # The n-th occurrence of a shingle in a text meets the n-th in another: the shared ones are the multiset overlap.
    _, element = np.unique(mix(hashes + (np.arange(len(hashes)) - first).astype(np.uint64) * _GOLD), return_inverse=True)
    order = np.argsort(element, kind="stable")
    posting = owner[order]
    start = np.searchsorted(element[order], np.arange(element.max() + 2))
    begin = np.cumsum(size) - size
    group = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    out = []
    for i in range(len(bag)):
        mine = element[begin[i] : begin[i] + size[i]]
        counts = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(posting[at], minlength=len(bag))
        near = np.flatnonzero(shared >= similarity * (size[i] + size - shared))
        for j in near[near > i].tolist():
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b:
                group[a] = b
                out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 25, rows: int = 5, cell: int = 1024) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row of ``doc_id, text``."""
    plain = docs.select("doc_id", row_key().alias("rk"), F.lower("text").alias("text"))
    drawn = settle(sketch(plain, shingle, bands, rows))
    nodes = settle(
        drawn.where("bag is not null").groupBy("bag").agg(F.min("rk").alias("rk"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    plain = plain.select("rk", "text")
    members = nodes.select("node", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1")
    members = settle(members.join(crowded, "key").select("key", "node", "n", "a"))
    pairs = settle(members.where("node != a").select("a", F.col("node").alias("b")).distinct())
    links = settle(verified(pairs, plain, nodes, shingle, similarity))
    comp = components(links)

    # Members of buckets of two have been compared already.
    told = settle(members.where("n > 2").join(comp, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp")))
    mixed = told.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    blocks = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    open_ = told.join(mixed, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    open_ = open_.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp")
    least = bands * rows * similarity - 4 * (bands * rows * similarity * (1 - similarity)) ** 0.5

    def filtered(table: pa.Table) -> pa.Table:
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        return table.filter(pa.array(close_members(table.column("comp").to_numpy(), registers, least))).drop_columns(["registers"])

    def joined(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        found = joining_links(table.column("comp").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bag")], similarity)
        return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()), "b": pa.array([int(node[j]) for _, j in found], pa.int64())})

    cells = ["key", "i", "j"]
    close = open_.join(nodes.select("node", "registers"), "node").select(*cells, "node", "comp", "registers")
    close = settle(close.groupBy(*cells).applyInArrow(filtered, "key long, i int, j int, node long, comp long"))
    if not close.isEmpty():
        bag = payloads(close.select("node"), plain, nodes, shingle)
        more = close.join(bag, "node").select(*cells, "node", "comp", "bag").groupBy(*cells).applyInArrow(joined, "a long, b long")
        comp = components(links.union(settle(more)))
    labelled = nodes.select("node", "bag").join(comp, "node", "left").select("bag", F.coalesce("comp", "node").alias("comp"))
    placed = settle(drawn.where("bag is not null").select("doc_id", "bag").join(labelled, "bag").select("doc_id", "comp"))
    named = placed.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = drawn.where("bag is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return placed.join(named, "comp").select("doc_id", "class_id", "class_size").union(alone)
