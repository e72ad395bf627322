"""Stupid-backoff scores of whole texts from the counts of all other texts.

The score of a word after its context is count(context + word) / count(context) for the longest context with which
it was seen elsewhere, times ``backoff`` for each word cut from the context; a word not seen elsewhere gets the share
1 / (words + 1). The result is the mean natural logarithm over the words of the text. It is a plain sum over n-grams:
each word starts from the share of an unseen word with its context cut away, and every n-gram seen elsewhere adds the
logarithm of its own ratio less that of the n-gram without its first word, which it stands in for. (Where the longer
one is seen elsewhere, so is the shorter one.) That takes the counts of the n-gram, of its context, of its rest (the
n-gram without its first word) and of its middle (without both ends), all without those of the text itself.

A scan explodes each text into its different n-grams, once each, with what the text holds of them and of their parts.
All four have the middle in common, so the n-grams are dealt out by the hash of their middle: where they meet, sums
over them are the four count tables, and each n-gram is matched with its counts at once, in one exchange. What the
n-grams add goes back to the texts and is summed for each of them. The n-grams travel as arrays, one row for each
block of texts and group of middles, and so do their sums. Trigrams, whose middle is one word, carry the pairs and words too;
a text's first and last word have neighbours that stand for its ends.

Nothing of the corpus meets in one task: a middle of more than ``crowd`` n-grams is dealt out by its context for what
contexts decide, and by its rest for what rests decide; these in turn, where they are as frequent, by the whole
n-gram, and that by text. The totals of frequent parts, at most some dozens for each ``crowd`` n-grams of the corpus,
are counted in a scan before and sent to the tasks, so that a frequent context or rest needs no place of its own. Middles are taken in ``passes`` portions of their hashes, one after
the other, and each portion's shuffle files are released when its sums are stored: the disk holds one portion of the
exchanged n-grams at a time.

N-grams are told apart by 64-bit hashes of lower-cased words. Null texts, and texts without words, have no words and
a null score. Repeated rows count as texts of their own and get equal scores. An empty table gives no rows; further
columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.textkit import Words, mix, settle, shingles, slices

# Words of one block of texts (a longer text is a block of its own), and the least count of a part in a block to be told.
BLOCK_WORDS = 1 << 20
TOLD = 16
# N-grams that one group holds about, and at most of one key; groups that one task counts in turn before their sums go back.
CROWD = 250_000
BUNDLE = 4

_SEEDS = np.random.default_rng(6).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LEFT, _RIGHT = 1, 2
_COUNTS = ("gram", "context", "rest", "middle")
_LISTS = {"text": pa.int32(), "middle": pa.int64(), "first": pa.int64(), "last": pa.int64(), **{f"own_{k}": pa.int32() for k in _COUNTS}}
FIELDS = "bundle int, grp int, n int, sides int, block long, " + ", ".join(f"{k} array<{'long' if v == pa.int64() else 'int'}>" for k, v in _LISTS.items())
_SUMS = ("unknown", "pairs", "matched")
SUMS = "row long, added double, unknown long, pairs long, matched long"
# Sums of a bundle of groups: the step from the text before, and what its n-grams add in units of 2 ** -32, whole and rest apart.
BLOCK_SUMS = "block long, step array<int>, whole array<int>, parts array<int>, unknown array<int>, pairs array<int>, matched array<int>"
_UNIT = float(1 << 32)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places that brings equal keys together, and where each key starts in it."""
    # Sorting values is several times as fast as sorting places: the high bits of the key with the place below them.
    bits = np.uint64(len(keys).bit_length())
    places = np.arange(len(keys), dtype=np.uint64)
    order = np.sort(keys >> bits << bits | places) & ((np.uint64(1) << bits) - np.uint64(1))
    at = keys[order]
    new = at[1:] != at[:-1]
    if (new != (at[1:] >> bits != at[:-1] >> bits)).any():  # keys that differ in the low bits alone
        order = np.argsort(keys)
        at = keys[order]
        new = at[1:] != at[:-1]
    return order.astype(np.int64), np.flatnonzero(np.append(len(at) > 0, new))


def _tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place the number, or the weight, of its key; and one place of each key."""
    order, starts = _runs(keys)
    lengths = np.diff(np.append(starts, len(order)))
    sums = lengths if weights is None or not len(order) else np.add.reduceat(weights[order], starts)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(sums, lengths)
    return out, order[starts]


def _parts(middle: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n-grams, of their contexts and of their rests, from their middles and end words."""
    context = mix(middle ^ (first * _SEEDS[1]))
    return mix(context ^ (last * _SEEDS[2])), context, mix(middle ^ (last * _SEEDS[3]))


class Frequent:
    """Totals of the frequent parts by hash."""

    def __init__(self, hashes: np.ndarray, totals: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.totals = hashes[order], totals[order]
        # Most hashes are told by their first bits.
        bits = max(16, (16 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.near = np.zeros(1 << bits, bool)
        self.near[self.hashes >> self.shift] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The total of each hash, 0 for those that are not frequent."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.near[hashes >> self.shift])
            at = np.searchsorted(self.hashes, hashes[maybe])
            at[at == len(self.hashes)] = 0
            out[maybe] = np.where(self.hashes[at] == hashes[maybe], self.totals[at], 0)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of ``row, text``: the first row, and for each word its hash and its text's row above the first."""
    block, hashes, texts = 0, [], []
    for batch in slices(batches):
        rows = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(rows >> 31) != 0) | (np.diff(rows) < 0)) + 1), len(rows)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            words = Words(batch.column(1).slice(start, end - start))
            if not len(words.hash):
                continue
            row = rows[start:end][words.doc]
            if hashes and (block >> 31 != row[0] >> 31 or row[0] < block or sum(map(len, hashes)) + len(row) > BLOCK_WORDS):
                yield block, np.concatenate(hashes), np.concatenate(texts)
                hashes, texts = [], []
            block = block if hashes else int(row[0])
            hashes.append(words.hash)
            texts.append(row - block)
    if hashes:
        yield block, np.concatenate(hashes), np.concatenate(texts)


def _grams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of each place of a middle of ``n - 2`` words: its hash, the words before and after it (0 at an end of the text), its text."""
    k = n - 2
    middle, at = (words, np.arange(len(words))) if k == 1 else shingles(words, text, k)
    padded, owner = np.concatenate([[np.uint64(0)], words, [np.uint64(0)]]), np.concatenate([[-1], text, [-1]])
    own = text[at]
    first = np.where(owner[at] == own, padded[at], np.uint64(0))
    last = np.where(owner[at + k + 1] == own, padded[at + k + 1], np.uint64(0))
    return mix(middle ^ _SEEDS[n]), first, last, own


def levels(order: int) -> range:
    """The lengths of n-grams that are dealt out: trigrams carry the shorter ones."""
    return range(3, max(order, 3) + 1)


def told(rows: DataFrame, order: int, least: int) -> DataFrame:
    """``row, hash, n``: the number of words of each text that has any, and counts of ``least`` and more of parts in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first_row, words, text in _blocks(batches):
            starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            counts = np.diff(np.append(starts, len(text)))
            yield pa.record_batch([pa.array(text[starts] + first_row), pa.nulls(len(starts), pa.int64()), pa.array(counts)], names=["row", "hash", "n"])
            for n in levels(order):
                middle, first, last, _ = _grams(words, text, n)
                found = [_often(middle, least)]
                keep = found[0][2] >= least
                gram, context, rest = _parts(middle[keep], first[keep], last[keep])
                found += [_often(context, least), _often(rest, least)]
                found.append(_often(gram[(found[1][2] >= least) & (found[2][2] >= least)], least))
                for hashes, counts, _ in found:
                    yield pa.record_batch([pa.nulls(len(hashes), pa.int64()), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["row", "hash", "n"])

    return rows.select("row", "text").mapInArrow(run, "row long, hash long, n long")


def _often(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes that come ``least`` times, their counts, and the count at each place."""
    counts, at = _tally(hashes)
    at = at[counts[at] >= least]
    return hashes[at], counts[at], counts


def totals(rows: DataFrame, order: int, hashes: np.ndarray) -> Frequent:
    """The exact totals of the given parts."""
    wanted = Frequent(hashes, np.arange(1, len(hashes) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(hashes) + 1, np.int64)
        for _, words, text in _blocks(batches):
            for n in levels(order):
                middle, first, last, _ = _grams(words, text, n)
                at = wanted.of(middle)
                counts += np.bincount(at, minlength=len(counts))
                keep = at > 0
                for part in _parts(middle[keep], first[keep], last[keep]):
                    counts += np.bincount(wanted.of(part), minlength=len(counts))
        at = np.flatnonzero(counts[1:])
        yield pa.record_batch([pa.array(hashes[at].view(np.int64)), pa.array(counts[1:][at])], names=["hash", "n"])

    if not len(hashes):
        return Frequent(hashes, np.zeros(0, np.int64))
    found = rows.select("row", "text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).toArrow()
    return Frequent(found.column("hash").to_numpy().view(np.uint64), found.column("n").to_numpy())


def grams(rows: DataFrame, order: int, frequent: Frequent, crowd: int, groups: int, part: int, passes: int) -> DataFrame:
    """The different n-grams of each text whose middle is in this portion of the hashes, as arrays for each group.

    ``sides`` tells what is decided where the n-grams go: what takes the counts of contexts, of rests, or both. Both is
    the rule; only n-grams whose middle is in some ``crowd`` n-grams, and neither context nor rest is frequent, go to two groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first_row, words, text in _blocks(batches):
            for n in levels(order):
                yield from dealt(first_row, words, text, n)

    def dealt(first_row: int, words: np.ndarray, text: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        middle, first, last, text = _grams(words, text, n)
        keep = (middle >> np.uint64(40)) % np.uint64(passes) == part
        middle, first, last, text = middle[keep], first[keep], last[keep], text[keep]
        gram, context, rest = _parts(middle, first, last)
        salt = mix(text.astype(np.uint64) * _SEEDS[4])
        own_gram, at = _tally(mix(gram ^ salt))
        own = [own_gram[at], *(_tally(mix(x ^ salt))[0][at] for x in (context, rest, middle))]
        middle, first, last, text, gram, context, rest = (x[at] for x in (middle, first, last, text, gram, context, rest))

        left, right, ends = middle.copy(), middle.copy(), np.zeros(len(middle), bool)
        crowded = np.flatnonzero(frequent.of(middle) >= crowd * 3 // 4)
        if len(crowded):
            gram, context, rest, salt = gram[crowded], context[crowded], rest[crowded], salt[at][crowded]
            ends[crowded] = end = last[crowded] == 0
            in_context, in_rest = frequent.of(context) > 0, frequent.of(rest) > 0
            whole = np.where(frequent.of(gram) > 0, mix(gram ^ salt), gram)
            left[crowded] = np.where(in_context, np.where(in_rest | end, whole, rest), context)
            right[crowded] = np.where(in_rest, np.where(in_context, whole, context), rest)
        columns = [text, middle, first, last, *own]
        for sides, route, of in ((_LEFT | _RIGHT, left, (left == right) & ~ends), (_LEFT, left, (left != right) | ends), (_RIGHT, right, (left != right) & ~ends)):
            chosen = np.flatnonzero(of)
            if len(chosen):
                yield lists(chosen, route[chosen], middle[chosen], columns, first_row, n, sides)

    def lists(chosen: np.ndarray, route: np.ndarray, middle: np.ndarray, columns: list[np.ndarray], first_row: int, n: int, sides: int) -> pa.RecordBatch:
        group = route % np.uint64(groups)
        # By group, and in it about by middle and by what the side takes, which packs well.
        bits, some = np.uint64(groups.bit_length()), np.uint64(20)
        order = _runs(group << np.uint64(64) - bits | middle >> np.uint64(64) - some << np.uint64(64) - bits - some | route >> bits + some)[0]
        chosen, group = chosen[order], group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        offsets = pa.array(np.append(starts, len(group)).astype(np.int32))
        same = [np.full(len(starts), x, t) for x, t in ((n, np.int32), (sides, np.int32), (first_row, np.int64))]
        values = [pa.array((x[chosen].view(np.int64) if t == pa.int64() else x[chosen].astype(np.int32)), t) for x, t in zip(columns, _LISTS.values(), strict=True)]
        return pa.record_batch(
            [pa.array((group[starts] // BUNDLE).astype(np.int32)), pa.array((group[starts] + np.uint64((n - 3) * groups)).astype(np.int32)), *map(pa.array, same), *(pa.ListArray.from_arrays(offsets, x) for x in values)],
            names=[f.split()[0] for f in FIELDS.split(", ")],
        )

    return rows.select("row", "text").mapInArrow(run, FIELDS)


def added(order: int, backoff: float, frequent: Frequent) -> Callable[[pa.Table], pa.Table]:
    """Of the n-grams of a bundle, by group: counts them and their parts, matches each with its counts, and sums what they add by text."""
    cut = float(np.log(backoff))

    def run(table: pa.Table) -> pa.Table:
        blocks, block = np.unique(table.column("block").to_numpy(), return_inverse=True)
        table = table.append_column("at", pa.array(block))
        found = [group(table.filter(pc.equal(table.column("grp"), g))) for g in pc.unique(table.column("grp"))]
        (block, text), sums = _by_text(*(np.concatenate(x) for x in list(zip(*found, strict=True))[:2]), [np.concatenate(x) for x in list(zip(*found, strict=True))[2:]])
        starts = np.searchsorted(block, np.arange(len(blocks) + 1))
        step = np.diff(text, prepend=np.int32(0))
        step[starts[:-1]] = text[starts[:-1]]
        units = np.rint(sums[0] * _UNIT).astype(np.int64)
        lists = [x.astype(np.int32) for x in (step, units >> 32, units & 0xFFFFFFFF, *sums[1:])]
        return pa.table([pa.array(blocks), *(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x)) for x in lists)], names=[f.split()[0] for f in BLOCK_SUMS.split(", ")])

    def group(table: pa.Table) -> tuple[np.ndarray, ...]:
        n = table.column("n")[0].as_py()
        lengths = pc.list_value_length(table.column("text")).to_numpy()
        sides = np.repeat(table.column("sides").to_numpy(), lengths)
        values = {k: pc.list_flatten(table.column(k)).to_numpy() for k in _LISTS}
        middle, first, last = (values[k].view(np.uint64) for k in ("middle", "first", "last"))
        gram, context, rest = _parts(middle, first, last)
        left, right, times = (sides & _LEFT) > 0, (sides & _RIGHT) > 0, values["own_gram"].astype(np.int64)
        seen, log = {}, {}
        # An n-gram that came here twice, once for each side, counts once for each.
        for k, keys, weights in (("gram", gram ^ _SEEDS[60 + sides], times), ("context", context, times * left), ("rest", rest, times * right), ("middle", middle, times)):
            total = frequent.of(gram if k == "gram" else keys)
            others = np.where(total > 0, total, _tally(keys, weights)[0]) - values[f"own_{k}"]
            seen[k], log[k] = others > 0, np.log(np.maximum(others, 1))
        begun, ended = first != 0, last != 0
        whole = begun & ended & seen["gram"] & (order >= 3)
        adds = np.where(whole & left, log["gram"] - log["context"], 0.0) + np.where(whole & right, log["middle"] - log["rest"] - cut, 0.0)
        unknown = pairs = np.zeros(len(times), bool)
        if n == 3:
            unknown = left & ~seen["middle"]
            adds += np.where(left & seen["middle"], log["middle"], 0.0)
            if order > 1:
                pairs = left & begun & seen["context"]
                adds -= np.where(pairs, log["middle"] + cut, 0.0)
                adds += np.where(right & ended & seen["rest"], log["rest"] - log["middle"], 0.0)
        matched = pairs if order == 2 else (whole & left & (n == order)) | (right & ~begun & ended & seen["rest"] & (n <= order))

        (block, text), sums = _by_text(np.repeat(table.column("at").to_numpy(), lengths), values["text"], [x * times for x in (adds, unknown, pairs, matched)])
        return block, text, *sums

    return run


def _by_text(block: np.ndarray, text: np.ndarray, values: list[np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
    """The different pairs of block and text in their order, and the sums of the values for each."""
    keys = block.astype(np.uint64) << np.uint64(32) | text.astype(np.uint64)
    order = np.argsort(keys)
    starts = np.flatnonzero(np.append(len(keys) > 0, keys[order[1:]] != keys[order[:-1]]))
    at = order[starts]
    return (block[at], text[at]), [np.add.reduceat(x[order], starts) if len(starts) else x for x in values]


def summed(table: pa.Table) -> pa.Table:
    """Of the sums of one block from all groups: sums by text."""
    values = {f.split()[0]: pc.list_flatten(table.column(f.split()[0])).to_numpy().astype(np.int64) for f in BLOCK_SUMS.split(", ")[1:]}
    lengths = pc.list_value_length(table.column("step")).to_numpy()
    ends = np.cumsum(lengths)
    steps = np.append(0, np.cumsum(values["step"]))
    text = steps[1:] - np.repeat(steps[ends - lengths], lengths)
    adds = values["whole"] + (values["parts"] & 0xFFFFFFFF) / _UNIT
    (_, text), sums = _by_text(np.zeros(len(text), np.int64), text, [adds, *(values[k] for k in _SUMS)])
    return pa.table([pa.array(text + table.column("block")[0].as_py()), *map(pa.array, sums)], names=["row", "added", *_SUMS])


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within go when their query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, crowd: int = CROWD, passes: int = 6) -> DataFrame:
    """``doc_id, n_words, n_backoff, lm_score`` of every row of ``doc_id, text``.

    ``n_backoff`` counts the words whose longest possible context, of up to ``order - 1`` words, was not seen with
    them elsewhere; the first word of a text has none. ``crowd`` and ``passes`` change the work of a task and the
    disk that is used, not the result.
    """
    spark = docs.sparkSession
    with _released(spark):
        rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")))
        first = settle(told(rows, order, max(1, min(TOLD, crowd // 16))))
        size = first.where("row is not null").select("row", F.col("n").alias("words"))
        words = size.agg(F.sum("words").alias("n")).first().n or 0
        often = first.where("row is null").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= crowd // 8).select("hash").toArrow()
        frequent = totals(rows, order, often.column("hash").to_numpy().view(np.uint64))
        passes = max(1, min(passes, words // crowd))  # a portion holds a group at least
        groups = max(1, -(-words // (passes * crowd)))
        portions = []
        for part in range(passes):
            dealt = grams(rows, order, frequent, crowd, groups, part, passes).groupBy("bundle").applyInArrow(added(order, backoff, frequent), BLOCK_SUMS)
            portions.append(settle(dealt.groupBy("block").applyInArrow(summed, SUMS)))
    sums = reduce(DataFrame.unionByName, portions).groupBy("row").agg(*(F.sum(k).alias(k) for k in ("added", *_SUMS)))

    n = F.col("words")
    others = F.lit(words) - n
    cuts = F.when(n <= order, n * (n - 1) / 2).otherwise(order * (order - 1) / 2 + (n - order) * (order - 1))
    start = -n * F.ln(others + 1.0) + cuts * F.ln(F.lit(float(backoff)))
    # A word seen elsewhere, and a pair that stands in for one, takes its share of the other texts' words.
    shares = F.when(others > 0, (n - F.col("unknown")) * (F.ln(others + 1.0) - F.ln(others)) + F.col("pairs") * F.ln(others)).otherwise(F.lit(0.0))
    out = rows.select("row", "doc_id").join(size, "row", "left").join(sums, "row", "left")
    possible = F.greatest(n - 1, F.lit(0)) if order > 1 else F.lit(0)
    return out.select(
        "doc_id", F.coalesce(n, F.lit(0).cast("long")).alias("n_words"),
        F.coalesce(possible - F.coalesce("matched", F.lit(0)), F.lit(0)).cast("long").alias("n_backoff"),
        ((start + F.coalesce(F.col("added") + shares, F.lit(0.0))) / n).alias("lm_score"),
    )
