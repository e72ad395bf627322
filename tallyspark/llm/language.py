"""Language of whole texts: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Training counts hashed letter trigrams (with word edges) and letters by script for every language of the
labelled rows; all rows count, nothing is sampled. The model that reaches the driver has a fixed size for
each language: 65,536 trigram cells and one number for each script.

Prediction scores each word by its trigrams. A language is a candidate for a word only if the script of
the word's first letter makes up a thousandth of its training letters at least; a word in a script that
no language has is evidence for none. Viterbi over the words of a text, with a penalty for each switch,
labels every word; the text gets the language with most letters, and the score is that language's share
of letters. All texts of a batch run in lockstep over blocks of words, so that a text of any length costs
numpy steps in proportion to one block and not to its words.

Null texts and texts without letters get ``und`` and score 0. Ties go to the language that sorts first.
Without any labelled row every text gets ``und``. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textkit import SLICE_BYTES, slices

UNKNOWN = "und"
CELLS = 1 << 16
BLOCK = 256

# First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_TABLES: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """For each code point: 0 no letter, 1 a letter of another script, 2 and up the scripts above."""
    if not _TABLES:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
        for number, ranges in enumerate(SCRIPTS.values(), 2):
            for low, high in ranges:
                table[low : high + 1] *= number
        _TABLES.append(table)
    return _TABLES[0]


class Letters:
    """Letters of a batch of lower-cased texts, and the words that they form."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.script = script_table()[code]
        inside = self.script > 0
        edge = np.diff(inside, prepend=False, append=False)
        bounds = np.flatnonzero(edge)
        self.start, self.end = bounds[::2], bounds[1::2]
        self.first_char = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.searchsorted(self.first_char, self.start, side="right") - 1
        letter = np.where(inside, code, 0).astype(np.uint64)
        at = np.flatnonzero(inside)  # a letter is never first or last: a line feed ends the batch
        before = letter[np.maximum(at - 1, 0)] * (at > 0)
        key = before * np.uint64(0x9E3779B97F4A7C15) + letter[at] * np.uint64(0xC2B2AE3D27D4EB4F) + letter[at + 1] * np.uint64(0x165667B19E3779F9)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        self.cell = (key >> np.uint64(48)).astype(np.int64)
        self.letters = at
        self.size = self.end - self.start


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (cell, language) and permitted (script, language) of ``text, lang`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            words = Letters([t.lower() for t in batch.column(0).to_pylist()])
            doc = np.searchsorted(words.first_char, words.letters, side="right") - 1
            for lang in sorted(set(langs)):
                mine = (langs == lang)[doc]
                both = np.concatenate([words.cell[mine], CELLS + words.script[words.letters[mine]].astype(np.int64)])
                cells[lang] = cells.get(lang, 0) + np.bincount(both, minlength=CELLS + 32)
        for lang, counted in cells.items():
            at = np.flatnonzero(counted)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counted[at])], names=["lang", "cell", "n"])

    rows = (
        labelled.where("lang is not null and text is not null").select("text", "lang")
        .mapInArrow(count, "lang string, cell int, n long")
        .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((CELLS + 32, len(langs)))
    counts[rows["cell"], [langs.index(x) for x in rows["lang"]]] = rows["n"]
    cells, scripts = counts[:CELLS], counts[CELLS:]
    logs = np.log((cells + 0.1) / (cells.sum(0) + 0.1 * CELLS)).astype(np.float32)
    return langs, logs, scripts >= np.maximum(scripts.sum(0) / 1000, 1)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: ``scores`` (word, language), ``doc`` the ascending text number of each word.

    The words of a text are cut into blocks of BLOCK words. For every block and every language before it the
    best score of ending in each language is found for all blocks at once; a short walk over the blocks of
    each text then fixes where each block starts and ends, and a second pass labels the words.
    """
    n, langs = scores.shape
    if not n or langs == 1:
        return np.zeros(n, np.int64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, n))
    blocks = -(-length // BLOCK)
    block_doc = np.repeat(np.arange(len(first)), blocks)
    within = np.arange(len(block_doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[block_doc] + within * BLOCK
    size = np.minimum(BLOCK, length[block_doc] - within * BLOCK)
    order = np.argsort(-size, kind="stable")
    begin, size, block_doc, within = begin[order], size[order], block_doc[order], within[order]
    active = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")  # blocks with more than t words
    move = np.where(np.eye(langs, dtype=bool), 0.0, -penalty)

    def step(value: np.ndarray, add: np.ndarray) -> np.ndarray:
        stay = np.maximum(value, value.max(-1, keepdims=True) - penalty)
        return stay + add

    # Pass 1: (block, language before, language after); a first block has no switch to pay.
    value = np.repeat(move[None], len(begin), 0)
    value[within == 0] = 0.0
    for t in range(BLOCK):
        k = active[t]
        if not k:
            break
        add = scores[begin[:k] + t][:, None, :]
        value[:k] = value[:k] + add if t == 0 else step(value[:k], add)
    # Walk over the blocks of each text, all texts at once.
    at = np.empty(len(order), np.int64)
    at[np.lexsort((within, block_doc))] = np.arange(len(order))
    by = np.argsort(at)  # blocks in reading order
    head = np.cumsum(blocks) - blocks
    entry = np.zeros((len(order), langs))
    best_before = np.zeros((len(order), langs), np.int64)
    state = np.zeros((len(first), langs))
    most = int(blocks.max())
    for b in range(most):
        docs = np.flatnonzero(blocks > b)
        here = by[head[docs] + b]
        entry[here] = state[docs]
        reach = state[docs][:, :, None] + value[here]
        best_before[here] = reach.argmax(1)
        state[docs] = reach.max(1)
    last = np.zeros(len(order), np.int64)
    ending = state.argmax(1)
    for b in range(most - 1, -1, -1):
        docs = np.flatnonzero(blocks > b)
        here = by[head[docs] + b]
        last[here] = ending[docs]
        ending[docs] = best_before[here, ending[docs]]
    # Pass 2: forward from the true entry with back pointers, then backward.
    point = np.zeros((BLOCK, len(order), langs), np.min_scalar_type(langs - 1))
    now = (entry[:, :, None] + np.where((within == 0)[:, None, None], 0.0, move[None])).max(1)
    for t in range(BLOCK):
        k = active[t]
        if not k:
            break
        if t:
            top = now[:k].argmax(1)
            jump = now[:k].max(1)[:, None] - penalty > now[:k]
            point[t, :k] = np.where(jump, top[:, None], np.arange(langs))
            now[:k] = step(now[:k], scores[begin[:k] + t])
        else:
            now[:k] += scores[begin[:k]]
    out = np.zeros(n, np.int64)
    state_now = last.copy()
    for t in range(BLOCK - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        out[begin[:k] + t] = state_now[:k]
        if t:
            state_now[:k] = point[t, np.arange(k), state_now[:k]]
    return out


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], penalty: float = 12.0, spans: bool = True, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The kept columns of each row, ``lang_pred, score`` and, if asked for, ``spans`` (start, end in characters, lang).

    Offsets are those of the lower-cased text, which has another length in a few letters only.
    """
    langs, logs, permitted = model
    names = np.array([*langs, UNKNOWN], object)
    shared = docs.sparkSession.sparkContext.broadcast((logs, permitted))  # 65,568 cells a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES // max(1, len(langs) ** 2 // 256)):  # blocks hold languages squared
            logs, permitted = shared.value
            words = Letters([(t or "").lower() for t in batch.column(at).to_pylist()])
            n = batch.num_rows
            best, share, found = np.full(n, len(langs)), np.zeros(n), [[] for _ in range(n)]
            if langs and len(words.start):
                scores = np.add.reduceat(logs[words.cell], np.searchsorted(words.letters, words.start), axis=0).astype(np.float64)
                allowed = permitted[words.script[words.start]]
                scores[~allowed & allowed.any(1)[:, None]] = -1e6
                scores[~allowed.any(1)] = 0.0
                label = viterbi(scores, words.doc, penalty)
                letters = np.bincount(words.doc * len(langs) + label, weights=words.size, minlength=n * len(langs)).reshape(n, -1)
                total = letters.sum(1)
                best = np.where(total > 0, letters.argmax(1), len(langs))
                share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
                if spans:
                    new = np.flatnonzero((np.diff(words.doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                    ends = np.append(new[1:], len(label)) - 1
                    for i, j in zip(new, ends, strict=True):
                        base = words.first_char[words.doc[i]]
                        found[words.doc[i]].append({"start": int(words.start[i] - base), "end": int(words.end[j] - base), "lang": names[label[i]]})
            columns = [*batch.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(share, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.record_batch(columns, names=[*keep, "lang_pred", "score", "spans"][: len(columns)])

    columns = list(dict.fromkeys([*keep, "text"]))
    at = columns.index("text")
    plain = docs.select(*columns)
    schema = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return plain.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text leaves no rest by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
