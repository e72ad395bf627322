"""Benchmark passages in documents, re-parameterised copies included, by template canonicalisation.

Tokens are the words of a text (runs of letters, digits and marks in Unicode's sense; a point or comma
between digits belongs to the number). Each character of a script without spaces is a word of its own. A template replaces three kinds of token by typed placeholders:
numbers (digits, or one of NUMBER_WORDS), units (one of UNITS after a number) and names (a capitalised
word with small letters). Case is folded for ASCII and Latin-1 letters.

Whether a capitalised word that opens a sentence is a name cannot be seen, so each window has three forms:
names only inside sentences; names wherever they stand, but for the words of OPENERS; and the literal one, of
the folded words themselves. The last two do not depend on what stands before a word.

Windows of ``window`` tokens are hash-joined with those of the benchmark, form by form; template windows with
fewer literals than half of their tokens are left out, as they say nothing, and found by their literal form. Benchmark items shorter than the
window count as one window of their own length. Items of fewer than ``passage`` words stand in many clean texts by chance, so they
are found where they are the whole text: by the folded words of all of it.

Joined windows of one text and one item that lie on one alignment and follow each other form a run, whatever
their forms; literal windows also form runs of their own. The
slots of an alignment must be consistent: one benchmark value stands for one document value throughout, and two
benchmark values never for the same one. A run of ``evidence`` words, or the whole item if it is shorter,
makes the document contaminated by that item; ``exact`` tells whether all slot values are the same.

Null and empty texts are never contaminated; repeated rows have equal results; an empty benchmark finds
nothing. Null item ids count as an item of their own. Further columns are left aside. A Bloom filter of the benchmark's window hashes
(at most ``filter_words`` words of 64 bits) travels to the tasks and spares the join most other windows, whatever the size of the benchmark.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import bloom
from tallyspark.llm.textkit import _BASE, _IS_WORD, hash_spans, mix, row_key, settle, slices, text_bytes

# Tokens that read as numbers or, after a number, as units.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = (
    "mm cm m km kilometers kilometres meters metres miles mile feet foot ft inches inch yards g kg kilograms grams lb lbs pounds ounces oz "
    "ml l liters litres gallons s sec seconds minutes minute min hours hour h days day weeks week months month years year "
    "dollars dollar cents euros euro usd eur percent degrees kmh mph"
).split()
# Words that open sentences in capitals and are no names.
OPENERS = (
    "a an the this that these those there here it its he she we you they i his her their our your my one some any each every all both no not "
    "what when where which who whom whose why how if in on at by for from to of with without as after before during while until since because although though "
    "and or but so then thus hence let given find suppose assume compute calculate determine explain describe write is are was were do does did can could "
    "will would should has have had question answer solution problem"
).split()
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x11D5A7F3C6B40E29, 0x25E1B97D3A6F8C43, 0x39B3D1F5E7C2A86B))
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:;\n|"]] = True

# First and last code points of scripts that put no spaces between words: Thai and Lao, Myanmar, Khmer, Japanese, Chinese.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@functools.cache
def _classes() -> np.ndarray:
    """For each code point 0 if it parts words, 1 if words hold it, 2 if it is a word."""
    out = np.array([unicodedata.category(chr(c))[0] in "LNM" or unicodedata.category(chr(c)) in ("Co", "Cn", "Cs") for c in range(0x110000)], np.uint8)
    for a, b in _UNSPACED:
        out[a : b + 1] *= 2
    return out


def _beyond_ascii(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes characters that part words out of ``inside``; first and last bytes of those that are words."""
    lead = np.flatnonzero(raw >= 0xC0)
    size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
    whole = lead + size <= len(raw)
    lead, size = lead[whole], size[whole]
    code = raw[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in range(1, 4):
        more = size > k
        code[more] = (code[more] << 6) | (raw[lead[more] + k] & 0x3F)
    kind = _classes()[np.minimum(code, 0x10FFFF)]
    for k in range(4):
        inside[lead[(kind == 0) & (size > k)] + k] = False
    alone = kind == 2
    return lead[alone], lead[alone] + size[alone] - 1


def _set(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.sort(hash_spans(data, ends - [len(w) for w in words], ends))


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Templates:
    """Tokens of a batch of texts: value hash, row, and (hash, slot) of each form."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = text_bytes(column)
        n = len(raw)
        data = raw.copy()
        upper = (raw >= 65) & (raw <= 90)
        data[upper] += 32
        latin = np.zeros(n, bool)
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        data[latin] += 32
        digit = (raw >= 48) & (raw <= 57)
        inside = _IS_WORD[raw]
        first, last = _beyond_ascii(raw, inside)
        if n > 2:
            inside[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
        head = self.offsets[:-1][np.diff(self.offsets) > 0]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[head] = inside[head]
        closes[head[head > 0] - 1] = inside[head[head > 0] - 1]
        opens[first] = closes[last] = True
        before, after = first[first > 0] - 1, last[last < n - 1] + 1
        closes[before] = inside[before]
        opens[after] = inside[after]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(self.offsets, start, side="right") - 1
        self.value = hash_spans(data, start, end)
        follows = np.zeros(len(start), bool)
        follows[1:] = self.doc[1:] == self.doc[:-1]
        counted = np.concatenate([[0], np.cumsum(_SENTENCE_END[raw])])
        stops = np.zeros(len(start), bool)
        stops[1:] = counted[start[1:]] > counted[end[:-1]]
        plain = np.concatenate([[0], np.cumsum(~digit & (raw != 46) & (raw != 44))])
        number = (plain[end] == plain[start]) | _within(self.value, _set(NUMBER_WORDS))
        capital = upper[start]
        if n:
            after = np.minimum(start + 1, n - 1)
            capital |= (raw[start] == 0xC3) & latin[after]
        unit = np.zeros(len(start), bool)
        unit[1:] = number[:-1] & follows[1:] & _within(self.value, _set(UNITS))[1:]
        small = np.concatenate([[0], np.cumsum(((raw >= 97) & (raw <= 122)) | ((raw >= 0x80) & (raw != 0xC3) & ~latin))])
        capital &= (small[end] > small[start]) & ~number & ~unit
        self.forms = []
        for name in (capital & follows & ~stops, capital & ~_within(self.value, _set(OPENERS))):
            token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, self.value)))
            self.forms.append((token, number | unit | name))
        self.forms.append((self.value, np.zeros(len(start), bool)))

    def windows(self, n: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n tokens of a form with enough literals, and their first tokens."""
        token, slot = self.forms[form]
        if len(token) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = len(token) - n + 1
        out = np.full(size, np.uint64(n + (form << 32)))
        for k in range(n):
            out = out * _BASE + token[k : k + size]
        slots = np.concatenate([[0], np.cumsum(slot)])
        at = np.flatnonzero((self.doc[:size] == self.doc[n - 1 :]) & (2 * (slots[n:] - slots[:-n]) <= n))
        return mix(out[at]), at


_LITERAL = 2
_HIT = "array<struct<hash:long,width:int,form:int,at:int,value:array<long>,slot:array<boolean>>>"


def _windows(rows: DataFrame, sizes: list[int], whole: bool, passage: int, known: np.ndarray | None) -> DataFrame:
    """``id, n_tokens, hits`` of each row of ``id, text``; only windows that the filter holds if there is one."""
    kind = dict(rows.dtypes)["id"]
    shared = None if known is None else rows.sparkSession.sparkContext.broadcast(known)
    widest = max(sizes, default=0)
    struct = pa.struct([("hash", pa.int64()), ("width", pa.int32()), ("form", pa.int32()), ("at", pa.int32()), ("value", pa.list_(pa.int64())), ("slot", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Templates(batch.column(1))
            first = np.searchsorted(words.doc, np.arange(batch.num_rows + 1))
            counts = np.diff(first)
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n, form in [(n, form) for n in sizes for form in range(len(words.forms)) if n >= passage or form == _LITERAL]:
                hashes, at = words.windows(n, form)
                if (whole and n < widest) or n < passage:  # a short item is one window; the shortest ones are whole texts
                    keep = counts[words.doc[at]] == n
                    hashes, at = hashes[keep], at[keep]
                if shared is not None:
                    keep = bloom.holds(shared.value, hashes)
                    hashes, at = hashes[keep], at[keep]
                slot = words.forms[form][1]
                for h, i in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True):
                    d = words.doc[i]
                    hits[d].append({"hash": h, "width": n, "form": form, "at": i - int(first[d]), "value": words.value[i : i + n].view(np.int64).tolist(), "slot": slot[i : i + n].tolist()})
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(struct))], names=["id", "n_tokens", "hits"])

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, hits {_HIT}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 8, evidence: int = 13, passage: int = 5, filter_words: int = bloom.MOST_WORDS) -> DataFrame:
    """``doc_id, rk, contaminated, n_items, n_exact, item_ids`` for every row of ``doc_id, text``."""
    if not 0 < passage <= window <= evidence:
        raise ValueError("expected passage <= window <= evidence")
    sizes = list(range(1, window + 1))
    items = settle(_windows(benchmark.select(F.col("item_id").alias("id"), "text"), sizes, True, passage, None))
    marks = settle(items.select(F.col("id").alias("item"), "n_tokens", F.inline("hits")).select("item", "n_tokens", F.col("hash"), "width", "form", F.col("at").alias("item_at"), F.col("value").alias("item_value"), "slot").distinct())
    per_size = {r.width: r.n for r in marks.groupBy("width").agg(F.count("*").alias("n")).collect()}  # one row a width
    known = bloom.build(marks.select("hash"), bloom.words_for(sum(per_size.values()), filter_words))
    rows = docs.select("doc_id", row_key().alias("rk"), "text")
    found = _windows(rows.select(F.struct("doc_id", "rk").alias("id"), "text"), [n for n in sizes if n in per_size], False, passage, known)
    found = settle(found.select("id.doc_id", "id.rk", "hits"))
    hits = found.where(F.size("hits") > 0).dropDuplicates(["rk"]).select("rk", F.inline("hits")).drop("slot", "form").withColumnRenamed("at", "doc_at")
    aligned = hits.join(marks, ["hash", "width"]).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    pair = F.transform(F.filter(F.arrays_zip("item_value", F.col("value").alias("value"), "slot"), lambda x: x["slot"]), lambda x: F.struct(x["item_value"].alias("item"), x["value"].alias("doc")))
    # Literal windows count twice: in runs with the others, and in runs of their own, which no other slot can spoil.
    kinds = F.when(F.col("form") == _LITERAL, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    aligned = aligned.withColumn("pairs", pair).withColumn("literal", F.explode(kinds))
    key = ["rk", "item", "n_tokens", "shift", "width", "literal"]
    starts = aligned.groupBy(*key, "item_at").agg(F.flatten(F.collect_set("pairs")).alias("pairs"))
    runs = starts.withColumn("run", F.col("item_at") - F.row_number().over(Window.partitionBy(*key).orderBy("item_at")))
    runs = runs.groupBy(*key, "run").agg(
        (F.count("*") + F.col("width") - 1).alias("words"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    runs = runs.groupBy("rk", "item", "n_tokens", "shift", "literal").agg(F.max("words").alias("words"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    one_way = F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"]))) == F.size("pairs")
    back = F.size(F.array_distinct(F.transform("pairs", lambda x: x["doc"]))) == F.size("pairs")
    runs = runs.where((F.col("words") >= F.least(F.lit(evidence), F.col("n_tokens"))) & one_way & back)
    per_item = runs.groupBy("rk", "item").agg(F.max(F.forall("pairs", lambda x: x["item"] == x["doc"])).alias("exact"))
    flagged = per_item.groupBy("rk").agg(F.count("*").alias("n_items"), F.count_if("exact").alias("n_exact"), F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = found.select("doc_id", "rk").join(flagged, "rk", "left")
    return out.select(
        "doc_id", "rk", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("n_exact", F.lit(0).cast("long")).alias("n_exact"),
        F.coalesce("item_ids", F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>")).alias("item_ids"),
    )
