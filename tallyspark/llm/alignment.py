"""Cross-tokenizer alignment with corpus-wide pair counts through external spill counting.

Words. A single space between two non-blank characters always starts a token of both vocabularies: the byte-level
pattern cuts there, and no piece of the other vocabulary holds a space after another character (tested when it is
loaded; without that, texts are encoded whole). So tokens, groups and links of a text are those of its words in
order, and a word that was met before is not encoded again.

Counting. A task writes a run for every few megabytes of text: the distinct pairs of token ids with the number of
the run's documents that hold them, dealt by the last bits of the A id to ``RADIX`` parts, in order of (A, B), as
zstd frames; and the pair-document records behind them as one zstd blob. Runs of a part are merged by a k-way heap
merge, ``FAN`` at a time, level by level. In the last merge all B of one A come together, so its highest count is
known when it ends. The counts then go back to the runs, part by part, and meet the records there: a pair of a
third of all documents travels once for each run, never once for each document.

Bounds: a task holds one run and its memo, or ``FAN`` runs of a part as frames with one open frame each, or the
counts of one part, whose pairs cannot outnumber the product of the vocabularies over ``RADIX``.

Defined results: texts that are null or empty, or that one of the tokenizers does not give back byte for byte, have
no tokens; repeated rows are documents of their own; null ids pass through; empty tables give no rows; further
columns are left aside.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textkit import settle, slices

RADIX = 128
FAN = 128
FRAME = 8192
RUN_BYTES = 4 << 20
PIECE_CHARS = 1 << 20
MEMO_WORDS = 400_000
LEARN = 1 << 14
MEMO_LENGTH = 64

# A space between two characters that are not blank.
CUT = re.compile(r" (?<=\S )(?=\S)")
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one zstd frame, byte planes apart."""
    table = np.stack([np.asarray(c, np.int64) for c in columns])
    planes = table.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(frame: bytes, columns: int) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    return np.ascontiguousarray(data.reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies and the bytes they stand for: printable ones as they are, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and a memo of aligned words."""

    def __init__(self, path_a: str, path_b: str):
        # One task, one thread.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_level()
        self.bytes_a: dict[int, bytes] = {}
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.bytes_b, pieces = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            pieces.append(piece)
            code = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode())
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, entry in self.bytes_a.items():
            self.size_a[i] = len(entry)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # An id as it stands inside a group, and as its last on that side.
        self.told = [f"{i}{mark}" for i in range(len(self.size_a)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.size_b)) for mark in ",;"]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.facts = np.zeros((0, 5), np.int64)  # of each word: n_a, n_b, groups, links, whether it comes back whole
        self.groups: list[str] = []
        self.links = np.zeros(0, np.int64)  # of all words, one after the other

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time."""
        if not self.cuts:
            yield [text]
            return
        start = 0
        while start < len(text):
            stop = CUT.search(text, start + PIECE_CHARS) if len(text) > start + PIECE_CHARS else None
            part = text[start : stop.start()] if stop else text[start:]
            plain = part.split(" ")
            # The same list for any white space: all separators are single spaces.
            yield plain if plain == part.split() else CUT.split(part)
            start = stop.end() if stop else len(text)

    def learn(self, words: list[str]) -> None:
        """Align new words: all at once, as one long text whose cuts include the ends of the words."""
        for begin in range(0, len(words), LEARN):
            some = words[begin : begin + LEARN]
            left = [e.ids for e in self.a.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]
            right = self.b.encode(some, num_threads=1)
            self.memo.update(zip(some, range(len(self.groups), len(self.groups) + len(some))))
            self._align([(" " + w).encode() for w in some], left, right)

    def _align(self, wholes: list[bytes], left: list[list[int]], right: list[list[int]]) -> None:
        n = len(wholes)
        good = np.ones(n, bool)
        flat = [list(chain.from_iterable(x)) for x in (left, right)]
        target = b"".join(wholes)
        if any(b"".join(map(table.__getitem__, ids)) != target for ids, table in zip(flat, (self.bytes_a, self.bytes_b))):
            for i, whole in enumerate(wholes):
                good[i] = b"".join(map(self.bytes_a.__getitem__, left[i])) == whole == b"".join(map(self.bytes_b.__getitem__, right[i]))
        word = [np.repeat(np.arange(n), list(map(len, x))) for x in (left, right)]
        ids = [np.array(x, np.int64) for x in flat]
        ids_a, ids_b = (i[good[w]] for i, w in zip(ids, word))
        word_a, word_b = (w[good[w]] for w in word)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        # Between two neighbouring ends lies one token of each side: each such piece is one link.
        ends = np.union1d(ends_a, ends_b)
        in_a = np.searchsorted(ends_a, ends)
        links = ids_a[in_a] << 32 | ids_b[np.searchsorted(ends_b, ends)]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = common[group_a] == ends_a, common[group_b] == ends_b
        codes = np.concatenate([2 * ids_a + last_a, 2 * (ids_b + len(self.size_a)) + last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        told = list(map(self.told.__getitem__, codes[order].tolist()))
        edges = np.searchsorted(np.concatenate([word_a, word_b])[order], np.arange(n + 1)).tolist()
        self.groups += ["".join(told[s:e]) for s, e in zip(edges, edges[1:])]
        counts = [np.bincount(w, minlength=n) for w in (word_a, word_b, word_a[last_a], word_a[in_a])]
        self.facts = np.concatenate([self.facts, np.stack([*counts, good], axis=1).astype(np.int64)])
        self.links = np.concatenate([self.links, links])

    def _portions(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """Words with the number of their text, for about ``PIECE_CHARS`` characters at a time."""
        held, size = [], 0
        for d, text in enumerate(texts):
            for words in self.words(text):
                held.append((d, words))
                size += min(len(text), PIECE_CHARS)
                if size >= 4 * PIECE_CHARS:
                    yield held
                    held, size = [], 0
        yield held

    def run(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and group digests of each text; the distinct pairs of all; records (pair, text, times) in order."""
        if len(self.memo) > MEMO_WORDS or len(self.groups) > 2 * MEMO_WORDS or len(self.links) > 10 * MEMO_WORDS:
            self.forget()
        n, none = len(texts), np.zeros(0, np.int64)
        digests, empty = [hashlib.sha256() for _ in texts], [True] * n
        doc_of, word_of, uses = [none], [none], [none]
        for portion in self._portions(texts):
            new = {w for _, words in portion for w in words if w not in self.memo}
            self.learn(list(new))
            index = []
            for d, words in portion:
                mine = list(map(self.memo.__getitem__, words))
                # Each group ends with a semicolon; the last one of a text does not count.
                digests[d].update(("" if empty[d] else ";").encode() + "".join(map(self.groups.__getitem__, mine))[:-1].encode())
                empty[d] = False
                index += mine
            for w in new:
                if len(w) > MEMO_LENGTH:
                    del self.memo[w]
            doc = np.repeat([d for d, _ in portion], [len(words) for _, words in portion]).astype(np.int64)
            key, times = np.unique(doc * len(self.groups) + np.array(index, np.int64), return_counts=True)
            doc_of.append(key // max(1, len(self.groups)))
            word_of.append(key % max(1, len(self.groups)))
            uses.append(times)
        doc, word, use = np.concatenate(doc_of), np.concatenate(word_of), np.concatenate(uses)
        good = np.ones(n, bool)
        good[doc[self.facts[word, 4] == 0]] = False
        keep = good[doc]
        doc, word, use = doc[keep], word[keep], use[keep]
        numbers = np.stack([np.bincount(doc, weights=self.facts[word, c] * use, minlength=n) for c in range(4)], axis=1).astype(np.int64)
        told = [h.hexdigest() if g and not e else "" for h, g, e in zip(digests, good.tolist(), empty)]

        used, word = np.unique(word, return_inverse=True)
        sizes = self.facts[used, 3]
        first = np.cumsum(self.facts[:, 3]) - self.facts[:, 3]
        start = np.cumsum(sizes) - sizes
        pairs, local = np.unique(self.links[np.repeat(first[used] - start, sizes) + np.arange(sizes.sum())], return_inverse=True)
        # Side-major order inside each part: by the last bits of A, then A, then B.
        order = np.lexsort((pairs, radix(pairs)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counts = sizes[word]
        at = np.repeat(start[word] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        record = place[local[at]] * n + np.repeat(doc, counts)
        by_record = np.argsort(record)
        record, times = record[by_record], np.repeat(use, counts)[by_record]
        begin = np.flatnonzero(np.diff(record, prepend=-1))
        times = np.add.reduceat(times, begin) if len(begin) else none
        record = record[begin]
        return numbers, told, pairs[order], record // max(1, n), record % max(1, n), times


def radix(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> 32) % RADIX


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _entries(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    for frame in frames:
        pairs, counts = unpack(frame, 2)
        yield from zip(pairs.tolist(), counts.tolist())


def _frames(rows: Iterator[tuple[int, ...]], columns: int) -> list[bytes]:
    out, open_ = [], []
    for row in rows:
        open_.append(row)
        if len(open_) == FRAME:
            out.append(pack(*np.array(open_, np.int64).T))
            open_ = []
    if open_:
        out.append(pack(*np.array(open_, np.int64).T.reshape(columns, -1)))
    return out


def merged(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Pairs of several runs in order, each with the sum of its counts."""
    current, total = None, 0
    for pair, count in heapq.merge(*map(_entries, runs)):
        if pair != current:
            if current is not None:
                yield current, total
            current, total = pair, 0
        total += count
    if current is not None:
        yield current, total


def with_maxima(rows: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Adds whether a count is the highest of its A id; only the pairs of one A are held."""
    side, held = None, []

    def told() -> Iterator[tuple[int, int, int]]:
        high = max((c for _, c in held), default=0)
        return ((p, c, int(c == high)) for p, c in held)

    for pair, count in rows:
        if pair >> 32 != side:
            yield from told()
            side, held = pair >> 32, []
        held.append((pair, count))
    yield from told()


def _write_runs(path_a: str, path_b: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=size):
            numbers, digests, pairs, record, doc, times = both.run(batch.column(1).to_pylist())
            rows = batch.num_rows
            at = np.bincount(record, minlength=len(pairs))
            part = radix(pairs)
            parts = []
            for r in np.unique(part).tolist():
                mine = np.flatnonzero(part == r)
                cuts = range(0, len(mine), FRAME)
                parts.append((r, [pack(pairs[mine[c : c + FRAME]], at[mine[c : c + FRAME]]) for c in cuts]))
            # Records of a pair follow each other; documents are stored as steps.
            steps = np.diff(doc, prepend=0)
            blobs = [pack(at), pack(steps, times)]
            kinds = len(parts) + 1 + rows
            none = [None] * kinds
            head, tail = [None] * (kinds - rows), slice(kinds - rows, None)
            columns: dict[str, pa.Array] = {"run": pa.array([number] * kinds, pa.int64())}
            columns["part"] = pa.array([r for r, _ in parts] + [-1] + [None] * rows, pa.int32())
            columns["frames"] = pa.array([f for _, f in parts] + [blobs] + [None] * rows, pa.list_(pa.binary()))
            columns["at"] = pa.array(head + list(range(rows)), pa.int32())
            columns["doc_id"] = pa.concat_arrays([pa.nulls(kinds - rows, batch.column(0).type), batch.column(0)])
            for c, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
                values = list(none)
                values[tail] = numbers[:, c].tolist()
                columns[name] = pa.array(values, pa.int64())
            columns["groups_sha256"] = pa.array(head + digests, pa.string())
            yield pa.RecordBatch.from_pydict(columns)
            number += 1

    return run


def _merge(last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = merged(table.column("frames").to_pylist())
        frames = _frames(with_maxima(rows), 3) if last else _frames(rows, 2)
        return pa.table({"part": [key[0].as_py()], "deal": [key[1].as_py()], "frames": pa.array([frames], pa.list_(pa.binary()))}, schema=_MERGED)

    return run


_MERGED = pa.schema([("part", pa.int32()), ("deal", pa.int64()), ("frames", pa.list_(pa.binary()))])


def _back(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """The counts of one part for the pairs of each of its runs."""
    out = []
    if runs.num_rows:
        known = np.concatenate([unpack(f, 3) for f in counts.column("frames")[0].as_py()], axis=1)
        for frames in runs.column("frames").to_pylist():
            pairs = np.concatenate([unpack(f, 2)[0] for f in frames])
            found = known[:, np.searchsorted(known[0], pairs)]
            out.append(pack(found[1], found[2]))
    return pa.table({"run": runs.column("run"), "part": runs.column("part"), "counts": pa.array(out, pa.binary())})


def _sums(records: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of a run: links at the highest count of their A, and the sum of counts."""
    if not records.num_rows or not counts.num_rows:
        return pa.table({"run": [], "at": [], "n_best": [], "count_sum": []}, schema=_SUMMED)
    sizes, rest = records.column("frames")[0].as_py()
    holders = unpack(sizes, 1)[0]
    steps, times = unpack(rest, 2)
    doc = np.cumsum(steps)
    order = np.argsort(counts.column("part").to_numpy())
    blobs = counts.column("counts").to_pylist()
    count, best = np.concatenate([unpack(blobs[i], 2) for i in order.tolist()], axis=1)
    count, best = np.repeat(count, holders), np.repeat(best, holders)
    n = int(doc.max()) + 1
    total = np.zeros(n, np.int64)
    # Sums of doubles below 2^53 are exact, so counts go in three parts.
    for shift in (0, 20, 40):
        total += np.bincount(doc, weights=(count >> shift & 0xFFFFF) * times, minlength=n).astype(np.int64) << shift
    links = np.bincount(doc, weights=best * times, minlength=n).astype(np.int64)
    run = records.column("run")[0].as_py()
    return pa.table({"run": np.full(n, run), "at": np.arange(n), "n_best": links, "count_sum": total}).cast(_SUMMED)


_SUMMED = pa.schema([("run", pa.int64()), ("at", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def align(docs: DataFrame, path_a: str, path_b: str, run_bytes: int = RUN_BYTES, fan: int = FAN) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``doc_id, text``.

    ``path_a`` is a byte-level BPE file of the tokenizers library, which reads a space and the text; ``path_b`` a
    sentencepiece model that adds this space itself.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    schema = f"run long, part int, frames array<binary>, at int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    written = settle(plain.mapInArrow(_write_runs(path_a, path_b, run_bytes), schema))
    heads = written.where("part >= 0").select("run", "part", "frames")
    records = written.where("part = -1").select("run", "frames")
    count = records.count()

    deals = max(1, -(-count // fan))
    dealt = heads.withColumn("deal", F.pmod(F.xxhash64("run"), F.lit(deals)))
    level = dealt.select("part", "deal", "frames")
    width = deals
    while True:
        last = width == 1
        level = level.groupBy("part", "deal").applyInArrow(_merge(last), "part int, deal long, frames array<binary>")
        if last:
            break
        width = -(-width // fan)
        level = level.withColumn("deal", F.pmod(F.xxhash64("deal"), F.lit(width)))
    totals = settle(level.select("part", "frames"))
    # Counts of a part go to each group of its runs, never to all rows.
    copies = totals.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    back = dealt.groupBy("part", "deal").cogroup(copies.groupBy("part", "deal")).applyInArrow(_back, "run long, part int, counts binary")
    sums = records.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(_sums, "run long, at int, n_best long, count_sum long")
    out = written.where("at is not null").join(sums, ["run", "at"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
