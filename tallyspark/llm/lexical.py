"""Ranked lexical search: compact item vocabulary tiles times document impact tiles, in float64 BLAS products.

A scan turns each document into its length and the counts of those of its terms that may stand in an item; a
Bloom filter of fixed size, built by aggregation, tells which. Corpus counts (N, L, df) are sums over all of
these rows. Items are dealt to groups of bounded size. For each group, a task multiplies dense tiles of at most
``TILE_TERMS`` terms: item weights times document impacts. Every weight in a tile is at most ``MOST_WEIGHT`` and
every impact at most 10^6, so each partial sum is a whole number below 2^53 and exact in any order of addition;
partial sums are added as 64-bit integers.

Defined results: null and empty texts hold no term; items without terms, and documents with score 0, give no
row; a repeated row counts as a document (or item) of its own; equal scores go by ``doc_id``, null ids last;
empty tables give no rows; further columns are left aside. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.textkit import Words, mix, settle, slices, text_bytes

TILE_TERMS = 512
TILE_ITEMS = 1024
TILE_DOCS = 1024
# 512 weights of this size times impacts of 10^6 stay below 2^53.
MOST_WEIGHT = 2**53 // (TILE_TERMS * 10**6) - 1
# Bounds of a group of items that is sent to the tasks at once.
GROUP_ITEMS = 4096
GROUP_ENTRIES = 400_000
FILTER_WORDS = 1 << 17
PIECE_BYTES = 1 << 22

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(_SMALL[data]))])
    return Words(column)


def _counted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) pairs in order, with the number of their occurrences."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], doc[at], np.diff(np.append(at, len(key)))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between terms."""
    start = 0
    while start < len(data):
        end = min(len(data), start + PIECE_BYTES)
        while end < len(data):
            outside = np.flatnonzero(_outside(data[end : end + PIECE_BYTES]))
            if len(outside):
                end += int(outside[0])
                break
            end = min(len(data), end + PIECE_BYTES)
        yield data[start:end]
        start = end


def _outside(data: np.ndarray) -> np.ndarray:
    low = _SMALL[data]
    return (low < 128) & ~(((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)))


def _probes(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of the filter for each of two probes."""
    other = mix(key + np.uint64(0x632BE59BD9B4E019))
    return [((k >> np.uint64(6)) % np.uint64(FILTER_WORDS), k & np.uint64(63)) for k in (key, other)]


def term_counts(table: DataFrame, key: str, bits: np.ndarray | None = None) -> DataFrame:
    """``<key>, n, terms, tf``: terms of each text, distinct hashes (of the filter) and their counts; texts without terms go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            rows, parts = batch.num_rows, []
            n = np.zeros(rows, np.int64)
            pieces = [(0, data, offsets)] if len(data) <= PIECE_BYTES or rows > 1 else ((0, p, np.array([0, len(p)])) for p in _pieces(data))
            for _, part, cut in pieces:
                words = _terms(part, cut)
                n += np.bincount(words.doc, minlength=rows)
                hashes, doc = words.hash, words.doc
                if bits is not None and len(hashes):
                    hit = np.ones(len(hashes), bool)
                    for word, bit in _probes(hashes):
                        hit &= (bits[word] >> bit) & np.uint64(1) == 1
                    hashes, doc = hashes[hit], doc[hit]
                found = _counted(hashes, doc)
                parts.append(found)
            if len(parts) == 1:
                terms, doc, tf = parts[0]
            else:
                terms, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                weight = np.concatenate([p[2] for p in parts])
                order = np.argsort(terms, kind="stable")
                terms, weight = terms[order], weight[order]
                at = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
                tf = np.add.reduceat(weight, at) if len(at) else weight
                terms, doc = terms[at], np.zeros(len(at), np.int64)
            kept = np.flatnonzero(n > 0)
            edges = np.append(np.searchsorted(doc, kept), len(doc)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int64))) for x in (terms.view(np.int64), tf)]
            yield pa.record_batch([batch.column(0).take(pa.array(kept)), pa.array(n[kept]), *lists], names=[key, "n", "terms", "tf"])

    plain = table.select(key, F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"{key} {dict(plain.dtypes)[key]}, n long, terms array<long>, tf array<long>")


def _filter(vocabulary: DataFrame) -> np.ndarray:
    """Bloom filter of the item terms: at most ``FILTER_WORDS`` rows reach the driver, whatever the vocabulary."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            for word, bit in _probes(key):
                yield pa.record_batch([pa.array(word.astype(np.int32)), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])

    rows = vocabulary.select("term").mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


class Tiles:
    """The weights of one group of items, cut into compact tiles."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.items, row = np.unique(item, return_inverse=True)
        self.terms, col = np.unique(term, return_inverse=True)
        holders = np.bincount(col, minlength=len(self.terms))
        first = np.full(len(self.terms), len(self.items))
        np.minimum.at(first, col, row)
        # Terms of many items first; rare ones beside others of the same items, so that few items share a tile.
        order = np.lexsort((first, np.where(holders > 8, -holders, 0)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.tile, self.column = place // TILE_TERMS, place % TILE_TERMS
        self.parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        tile = self.tile[col]
        for t in range(int(self.tile.max(initial=-1)) + 1):
            mine = np.flatnonzero(tile == t)
            parts = []
            left = weight[mine].copy()
            while len(mine):
                # A weight above the bound is spread over further products of the same tile.
                now = np.minimum(left, MOST_WEIGHT)
                used = np.unique(row[mine])
                for begin in range(0, len(used), TILE_ITEMS):
                    block = used[begin : begin + TILE_ITEMS]
                    inside = (row[mine] >= block[0]) & (row[mine] <= block[-1])
                    parts.append((block, np.searchsorted(block, row[mine][inside]), self.column[col[mine][inside]], now[inside].astype(np.float64)))
                left = left - now
                mine, left = mine[left > 0], left[left > 0]
            self.parts.append(parts)

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Scores of ``docs`` documents for all items of the group (documents x items), exact."""
        out = np.zeros((docs, len(self.items)), np.int64)
        at = np.searchsorted(self.terms, term)
        known = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == term)
        at, doc, impact = at[known], doc[known], impact[known]
        tile = self.tile[at]
        order = np.argsort(tile, kind="stable")
        at, doc, impact, tile = at[order], doc[order], impact[order], tile[order]
        for t, parts in enumerate(self.parts):
            a, b = np.searchsorted(tile, [t, t + 1])
            if a == b:
                continue
            rows, local = np.unique(doc[a:b], return_inverse=True)
            impacts = np.zeros((len(rows), TILE_TERMS))
            impacts[local, self.column[at[a:b]]] = impact[a:b]
            for block, r, c, w in parts:
                weights = np.zeros((len(block), TILE_TERMS))
                weights[r, c] = w
                out[np.ix_(rows, block)] += (impacts @ weights.T).astype(np.int64)
        return out


class Best:
    """The running top k of each item: score, null id, doc_id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.none = np.ones((items, k), bool)
        self.doc = np.zeros((items, k), np.int64)

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """Rows of a tile must come in the order of ``(none, doc)``; of equal scores the first stay."""
        hot = np.flatnonzero(scores.max(axis=0, initial=0) >= np.maximum(self.score[:, -1], 1))
        if not len(hot):
            return
        s = scores[:, hot].T
        k = min(self.k, s.shape[1])
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, equal = s > least, s == least
        taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None]))
        item, at = np.nonzero(taken & (s > 0))
        row = np.concatenate([np.repeat(np.arange(len(hot)), self.k), item])
        score = np.concatenate([self.score[hot].ravel(), s[item, at]])
        null = np.concatenate([self.none[hot].ravel(), none[at]])
        ids = np.concatenate([self.doc[hot].ravel(), doc[at]])
        order = np.lexsort((ids, null, -score, row))
        start = np.searchsorted(row[order], np.arange(len(hot)))
        keep = order[start[:, None] + np.arange(self.k)]
        self.score[hot], self.none[hot], self.doc[hot] = score[keep], null[keep], ids[keep]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, for each entry."""
    if len(n) and 75 * int(n.max()) * documents >= 2**63:
        m = np.array([25 + 75 * x * documents // total for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n * documents // total
    return (10**9 * tf) // (1000 * tf + 8 * m)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, group_items: int = GROUP_ITEMS, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item of ``item_id, text``; ``doc_id`` is a long."""
    asked = settle(term_counts(items, "item_id").withColumn("item", F.monotonically_increasing_id()))
    entries = asked.select("item", F.explode(F.arrays_zip("terms", "tf")).alias("e")).select("item", F.col("e.terms").alias("term"), F.col("e.tf").alias("uses"))
    vocabulary = entries.select("term").distinct()
    known = settle(term_counts(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", _filter(vocabulary)))
    size = known.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    documents, total = size.N, size.L or 0
    frequency = known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(vocabulary, "term")
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = entries.join(frequency, "term").select("item", "term", (F.col("uses") * weight).alias("weight")).where("weight > 0")
    weighed = settle(weighed)
    bound = weighed.agg(F.count("*").alias("entries"), F.countDistinct("item").alias("items")).first()
    groups = max(1, -(-bound.entries // group_entries), -(-bound.items // group_items))
    dealt = weighed.withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(groups)))

    found = None
    # One round for each group of items, not for each item: a group is what tasks hold at once.
    for g in range(groups):
        rows = dealt.where(F.col("deal") == g).select("item", "term", "weight").toArrow()
        if not rows.num_rows:
            continue
        tiles = Tiles(*(rows.column(c).to_numpy() for c in ("item", "term", "weight")))
        best = known.select("doc_id", "n", "terms", "tf").mapInArrow(_searcher(tiles, k, documents, total), "item long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Partial winners meet in two steps, so an item's rows of all tasks never stand in one group.
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _searcher(tiles: Tiles, k: int, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(tiles.items), k)
        for whole in batches:
            for begin in range(0, whole.num_rows, TILE_DOCS):
                batch = whole.slice(begin, TILE_DOCS)
                none = np.asarray(batch.column(0).is_null())
                ids = batch.column(0).fill_null(0).to_numpy()
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                impact = impacts(tf, np.repeat(batch.column(1).to_numpy(), sizes), documents, total)
                order = np.lexsort((ids, none))
                scores = tiles.scores(doc, term, impact, batch.num_rows)[order]
                best.add(scores, ids[order], none[order])
        item, at = np.nonzero(best.score > 0)
        doc = pa.array(best.doc[item, at], mask=best.none[item, at])
        yield pa.record_batch([pa.array(tiles.items[item]), doc, pa.array(best.score[item, at])], names=["item", "doc_id", "score"])

    return run
