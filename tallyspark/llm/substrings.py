"""Removal of long repeated substrings, found by matching statistics over a run-length index.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same document
or another. Every window of that length has a key: the smallest hash of the ``gram``-byte strings in it.
Equal windows have equal keys, so neighbouring windows of one key form a context, and contexts meet only
those of their own key. Every window lies in exactly one context.

* A key with one context is done, unless its own string is there twice: nothing repeats.
* A context that occurs twice (same bytes) repeats as a whole, and no text has to travel for it.
* Contexts of a key that differ may still share windows. One copy of each goes to the index of its shard:
  a run-compressed Burrows-Wheeler transform over some megabytes of contexts, whose matching statistics
  tell which windows of single contexts start elsewhere too (see ``runindex``).
* Keys with more than ``crowd`` different contexts would gather in one task. Their windows are counted by
  digest instead, which combines on the map side: exact as well, and spread over all tasks.

Keys and digests are 64-bit hashes, windows of crowded keys 128-bit. Null and empty texts, and texts
shorter than ``length``, keep everything. Repeated rows repeat each other. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.runindex import matching_statistics
from tallyspark.llm.textkit import _CODES, hash_spans, mix, powers, row_key, settle, slices, text_bytes

INDEX_BYTES = 2 << 20


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, row, start, end byte of every context, and whether its key string is in it more than once.

    A context has at most ``length`` windows.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:n], out=total[1:])
    low = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    spot = np.arange(len(low), dtype=np.int32)  # the leftmost place of each minimum
    window, size = 1, length - gram + 1
    while window < size:  # minima over twice as many grams each time
        step = min(window, size - window)
        later = low[step:] < low[:-step]
        low = np.where(later, low[step:], low[:-step])
        spot = np.where(later, spot[step:], spot[:-step])
        window += step
    ends = offsets[1:]
    at = np.arange(len(low))
    row = np.searchsorted(offsets, at, side="right") - 1
    fits = at + length <= ends[row]
    at, low, row, spot = at[fits], low[fits], row[fits], spot[fits]
    if not len(at):
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - first) % length == 0
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return low[begin], row[begin], at[begin], at[last] + length, spot[begin] != spot[last]


def window_digests(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of the data."""
    start = np.arange(len(data) - length + 1)
    return hash_spans(data, start, start + length), hash_spans(data ^ np.uint8(0x5A), start, start + length)


def intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered bytes of windows at ascending starts, as merged (start, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def repeated_spans(rows: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """``rk, start, end``: byte spans of repeated strings in rows of ``rk, text``; spans may overlap."""

    def list_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            key, row, start, end, twice = contexts(data, offsets, length, gram)
            said = hash_spans(data, start, end) if len(start) else np.zeros(0, np.uint64)
            base = offsets[:-1][row] if len(row) else row
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(said.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array((start - base).astype(np.int64)), pa.array((end - start).astype(np.int32)), pa.array(twice)],
                names=["key", "said", "rk", "start", "size", "twice"],
            )

    found = settle(rows.select("rk", "text").mapInArrow(list_contexts, "key long, said long, rk binary, start long, size int, twice boolean"))
    several = found.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("key")
    met = settle(found.join(several, "key"))
    kinds = settle(met.groupBy("key", "said").agg(F.count("*").alias("copies"), F.max("twice").alias("twice")))
    whole = met.drop("twice").join(kinds.where("copies > 1"), ["key", "said"]).select("rk", "start", (F.col("start") + F.col("size")).alias("end"))
    crowded = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max((F.col("copies") == 1) & F.col("twice")).alias("inner")).where("kinds > 1 or inner").select("key", "kinds")
    # One place to take the text of each context from.
    place = met.join(crowded, "key").groupBy("key", "said").agg(F.count("*").alias("copies"), F.min("kinds").alias("kinds"), F.min(F.struct("rk", "start", "size")).alias("of"))
    orders = place.groupBy("of.rk").agg(F.collect_list(F.struct("key", "copies", "kinds", "of.start", "of.size")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            wanted = lists.flatten()
            start, size = np.asarray(wanted.field("start")), np.asarray(wanted.field("size"))
            raw = data.tobytes()
            texts = [raw[s : s + z] for s, z in zip((offsets[:-1][row] + start).tolist(), size.tolist(), strict=True)]
            yield pa.record_batch(
                [wanted.field("key"), wanted.field("copies"), wanted.field("kinds"), batch.column(0).take(pa.array(row)), wanted.field("start"), pa.array(texts, pa.binary())],
                names=["key", "copies", "kinds", "rk", "start", "context"],
            )

    schema = "key long, copies long, kinds long, rk binary, start long, context binary"
    # A repeated row would give its contexts again: one row of a key is enough.
    texts = rows.join(orders, "rk").select("rk", "text", "wanted").mapInArrow(cut, schema)
    texts = settle(texts.dropDuplicates(["key", "rk", "start"]))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rk", "start", "end"]

        def judge(held: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (_, copies, rk, start, _), told in zip(held, matching_statistics([h[4] for h in held]), strict=True):
                if copies == 1:
                    out += [(rk, start + a, start + b) for a, b in intervals(np.flatnonzero(told >= length), length)]
            return pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=names)

        held: list[tuple] = []
        held_bytes, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held_bytes >= INDEX_BYTES and row[0] != last:
                    yield judge(held)
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row[4])
                last = row[0]
        if held:
            yield judge(held)

    sharded = texts.where(F.col("kinds") <= crowd).select("key", "copies", "rk", "start", "context")
    matched = sharded.repartition("key").sortWithinPartitions("key").mapInArrow(indexed, "rk binary, start long, end long")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context", limit=1 << 18):
            low, high, row, at = [], [], [], []
            for i, context in enumerate(batch.column(3).to_pylist()):
                a, b = window_digests(np.frombuffer(context, np.uint8), length)
                low.append(a.view(np.int64)), high.append(b.view(np.int64))
                row.append(np.full(len(a), i)), at.append(np.arange(len(a)))
            row, at = np.concatenate(row), np.concatenate(at)
            starts = np.asarray(batch.column(2))[row] + at
            yield pa.record_batch(
                [pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(starts)],
                names=["low", "high", "copies", "rk", "start"],
            )

    many = texts.where(F.col("kinds") > crowd).select("copies", "rk", "start", "context")
    windows = settle(many.mapInArrow(digests, "low long, high long, copies long, rk binary, start long"))
    again = windows.groupBy("low", "high").agg(F.sum("copies").alias("n")).where("n > 1").select("low", "high")
    counted = windows.where("copies = 1").join(again, ["low", "high"]).select("rk", "start", (F.col("start") + length).alias("end"))
    return whole.union(matched).union(counted)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, crowd: int = 512, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, ``spans`` and, if asked for, ``kept`` of every row."""
    if not 0 < gram <= length:
        raise ValueError("gram must lie between 1 and length")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows, length, gram, crowd)
    spans = spans.groupBy("rk").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            data, offsets = text_bytes(batch.column(1))
            for i, spans in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                keep = np.ones(len(raw), bool)
                for a, b in merged:
                    keep[a:b] = False
                kept = raw[keep].tobytes() if merged else raw.tobytes()
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in merged], kept))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()][: 5 + keep_text]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.record_batch([batch.column(0), *(pa.array([o[j] for o in out], k) for j, k in enumerate(kinds))], names=names[: 6 + keep_text])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * keep_text
    return rows.join(spans, "rk", "left").select("doc_id", "text", "spans").mapInArrow(remove, schema)
