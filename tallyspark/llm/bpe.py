"""Byte-level BPE of whole texts with content-defined chunk reuse, and the way back.

Chunks. A rolling hash over 32 bytes cuts every text where its content says so, so a passage that many
documents share is cut alike in all of them. The core of a chunk runs from its first to its last safe
place. A safe place is a space between two letters or digits: the pre-tokeniser always starts a token
there, whatever stands further left or right, so the tokens of a text are those of the part before the
place and of the part after it.

Reuse. Cores are counted by a 128-bit digest. Cores that occur more than once are encoded once in all and
their tokens joined back to the documents. Between two cores lies a join: the end of one chunk and the
start of the next. It is encoded anew from safe place to safe place, and where a chunk has no core the
join widens over it, to the whole text if need be; there both sides agree exactly with the encoding
of the whole text.

Texts without shared cores are finished in the pass that finds them; only the others are shuffled, by a
key of the row. Null and empty texts have no tokens. Special strings in a text are treated as the
library's default does. Repeated rows give repeated results; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import bloom
from tallyspark.llm.textkit import row_key, settle, slices

_GEAR = np.random.default_rng(32).integers(0, 2**32, 256, dtype=np.uint32)
# The space comes first in the pattern, so that the search runs from space to space.
_SAFE = re.compile(r" (?<=[^\W_] )(?=[^\W_])")
_CODECS: dict[str, Codec] = {}
MEMO = 120_000
TOGETHER = 4096
# The pre-tokeniser's pattern, a fixed value, and the letters on which all libraries agree about its classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_END = "\u0250"


def byte_of_char() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file, with a bounded memory of segments between safe places."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        back = byte_of_char()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = []
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            known = all(c in back for c in token)
            self.table.append(bytes(back[c] for c in token) if known else token.encode())
        self.sizes = np.array([len(t) for t in self.table], np.int64)
        self.quick = self.ranked(path)
        self.proved = 0
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def alone(self, segment: str) -> tuple[bytes, bytes]:
        ids = self.tokenizer.encode(segment, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), b"".join([self.table[i] for i in ids])

    def ranked(self, path: str):
        """The same merges by rank, for a library that is faster on new words, or None if ids do not follow merges."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"].get("merges", [])]
        vocabulary = model["model"].get("vocab", {})
        if any(vocabulary.get(m.replace(" ", "", 1)) != 256 + i for i, m in enumerate(merges)) or len(vocabulary) < 256 + len(merges):
            return None
        if model["normalizer"] or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        self.special = [t["content"] for t in model["added_tokens"]]
        ranks = {self.table[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def cut_apart(self, part: list[str], ids: list[int]) -> bool:
        """Deal the ids of neighbouring segments to them; false if a token reaches over a border."""
        ends = np.cumsum(self.sizes[ids])
        sizes = map(len, part) if "".join(part).isascii() else (len(s.encode()) for s in part)
        wanted = np.cumsum(np.fromiter(sizes, np.int64, len(part)))
        cut = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
        if not len(ends) or (ends[cut] != wanted).any():
            return False
        # All ids are decoded at once, and the bytes dealt like the ids.
        raw, decoded = np.array(ids, "<u4").tobytes(), b"".join([self.table[i] for i in ids])
        start = begin = 0
        for segment, end, stop in zip(part, (4 * (cut + 1)).tolist(), wanted.tolist(), strict=True):
            self.memo[segment] = (raw[start:end], decoded[begin:stop])
            start, begin = end, stop
        return True

    def learn(self, segments: list[str]) -> None:
        """Segments that may stand next to each other are encoded as one text and cut apart where they meet.

        Those of Latin letters go by rank, the first thousands of each task process also by the library itself.
        """
        joint = [s for s in segments if len(s) > 1 and s[0] == " " and s[1].isalnum() and s[-1].isalnum()]
        quick = [s for s in joint if s.isascii() or max(s) < LATIN_END] if self.quick else []
        if quick and any(t in "".join(quick) for t in self.special):
            quick = [s for s in quick if not any(t in s for t in self.special)]
        for at in range(0, len(quick), TOGETHER):
            part = quick[at : at + TOGETHER]
            ids = self.quick.encode_ordinary("".join(part))
            if self.proved < 4:
                self.proved += 1
                if ids != self.tokenizer.encode("".join(part), add_special_tokens=False).ids:
                    self.quick = None
                    break
            self.cut_apart(part, ids)
        joint = [s for s in joint if s not in self.memo]
        for at in range(0, len(joint), TOGETHER):
            part = joint[at : at + TOGETHER]
            self.cut_apart(part, self.tokenizer.encode("".join(part), add_special_tokens=False).ids)
        for segment in segments:
            if segment not in self.memo:
                self.memo[segment] = self.alone(segment)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and decoded bytes of each text."""
        cut = [split(t) for t in texts]
        if len(self.memo) > MEMO:  # what is still in use comes back from the older half
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        unseen = {s for segments in cut for s in segments if s not in memo}
        for s in unseen & older.keys():
            memo[s] = older[s]
        self.learn([s for s in unseen if s not in memo])
        out = []
        for segments in cut:
            got = [memo[s] for s in segments]
            out.append((b"".join([x[0] for x in got]), b"".join([x[1] for x in got])))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join([self.table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def split(text: str) -> list[str]:
    """The text cut before every safe place."""
    parts = _SAFE.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if text else []


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def cuts(data: np.ndarray, mask: int, least: int) -> list[int]:
    """Byte positions at which chunks start, 0 included: after windows of 32 bytes whose hash has the mask's bits 0."""
    if len(data) <= 2 * least:
        return [0]
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    out, last = [0], 0
    for at in (np.flatnonzero((rolled[31:] & np.uint32(mask << 16)) == 0) + 32).tolist():
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= least and len(data) - at >= least:
            out.append(at)
            last = at
    return out


def pieces(text: str, mask: int, least: int) -> list[tuple[bool, str]]:
    """The text as (is a core, part) from left to right; parts that are no cores are joins."""
    raw = text.encode()
    at = cuts(np.frombuffer(raw, np.uint8), mask, least)
    out: list[tuple[bool, str]] = []
    join = ""
    for start, end in zip(at, [*at[1:], len(raw)], strict=True):
        chunk = raw[start:end].decode()
        first = _SAFE.search(chunk)
        begin = first.start() if first else len(chunk)
        end_ = begin
        place = chunk.rfind(" ")
        while place > begin:
            if chunk[place - 1].isalnum() and chunk[place + 1 : place + 2].isalnum():
                end_ = place
                break
            place = chunk.rfind(" ", 0, place)
        if end_ - begin < least // 4:
            join += chunk
            continue
        out += [(False, join + chunk[:begin]), (True, chunk[begin:end_])]
        join = chunk[end_:]
    return [*out, (False, join)]


def digest(core: str) -> bytes:
    return hashlib.blake2b(core.encode(), digest_size=16).digest()


def _first_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def _digest_keys(column: pa.Array) -> np.ndarray:
    return _first_words(column.to_pylist())


def finish(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    try:
        decoded.decode()
    except UnicodeDecodeError:
        decoded = decoded.decode("utf-8", "replace").encode()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode(docs: DataFrame, tokenizer: str, keep_ids: bool = True, mask: int = 0x3FF, least: int = 256, filter_words: int = bloom.MOST_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if kept, ``ids`` (32-bit little-endian) of every row.

    ``mask`` sets the mean chunk (one cut in mask + 1 bytes), ``least`` the smallest. The digests of shared
    cores go to the tasks as a Bloom filter of at most ``filter_words`` words of 64 bits, whatever their number.
    A core that passes it by chance is dropped by the join. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text"))

    def list_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[digest(p) for is_core, p in pieces(t, mask, least) if is_core] for t in batch.column(1).to_pylist()]
            keys = [k for k, f in zip(batch.column(0).to_pylist(), found, strict=True) for _ in f]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([d for f in found for d in f], pa.binary())], names=["rk", "digest"])

    # A repeated row counts once for each time; what matters is only whether a core is there twice.
    occurrences = settle(rows.select("rk", "text").mapInArrow(list_cores, "rk binary, digest binary"))
    shared = settle(occurrences.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    known = docs.sparkSession.sparkContext.broadcast(bloom.build(shared, bloom.words_for(shared.count(), filter_words), _digest_keys))

    def is_known(found: list[bytes]) -> list[bool]:
        return bloom.holds(known.value, _first_words(found)).tolist() if found else []

    def emit_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cores = {digest(p): p for t in batch.column(0).to_pylist() for is_core, p in pieces(t, mask, least) if is_core}
            digests = list(cores)
            digests = [d for d, keep in zip(digests, is_known(digests), strict=True) if keep]
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array([cores[d] for d in digests], pa.string())], names=["digest", "core"])

    def encode_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(tokenizer)
        for batch in slices(batches, "core"):
            done = [x[0] for x in model.encode(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(done, pa.binary())], names=["digest", "ids"])

    once = rows.select("text").mapInArrow(emit_cores, "digest binary, core string").groupBy("digest").agg(F.first("core").alias("core"))
    dictionary = settle(once.join(shared, "digest", "left_semi").mapInArrow(encode_cores, "digest binary, ids binary"))

    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    schema = f"doc_id {kind}, rk binary, text string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def result(batch: pa.RecordBatch, texts: list[str | None], done: list[tuple | None]) -> pa.RecordBatch:
        told = [(None, None, None, None) if d is None else (*finish(*d), d[0]) for d in done]
        arrays = [pa.array([t[i] for t in told], kind_) for i, kind_ in enumerate((pa.int64(), pa.string(), pa.string(), pa.binary()))]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *arrays[: len(columns)]], names=["doc_id", "rk", "text", *columns])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(tokenizer)
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            cores = [[digest(p) for is_core, p in pieces(t, mask, least) if is_core] for t in texts]
            # One look at the filter for the whole batch: a text waits if it has a core that may be shared.
            among = iter(is_known([d for found in cores for d in found]))
            waits = [any([next(among) for _ in found]) for found in cores]
            ready = iter(model.encode([t for t, w in zip(texts, waits, strict=True) if not w]))
            yield result(batch, [t if w else None for t, w in zip(texts, waits, strict=True)], [None if w else next(ready) for w in waits])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(tokenizer)
        for batch in slices(batches):
            done = []
            for text, reuse in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held = {r["digest"]: r["ids"] for r in reuse or ()}
                parts = [(p, held.get(digest(p)) if is_core else None) for is_core, p in pieces(text, mask, least)]
                fresh = iter(model.encode([p for p, ids in parts if ids is None]))
                both = [next(fresh) if ids is None else (ids, b"".join([model.table[i] for i in np.frombuffer(ids, "<u4").tolist()])) for _, ids in parts]
                done.append((b"".join([x[0] for x in both]), b"".join([x[1] for x in both])))
            yield result(batch, [None] * batch.num_rows, done)

    first = settle(rows.mapInArrow(first_pass, schema))
    waiting = first.where("text is not null").select("doc_id", "rk", "text")
    packed = dictionary.select("digest", F.struct("digest", "ids").alias("core"))
    reuse = occurrences.join(packed, "digest").groupBy("rk").agg(F.collect_set("core").alias("cores"))
    rest = waiting.join(reuse, "rk", "left").select("doc_id", "rk", "text", "cores").mapInArrow(second_pass, schema)
    return first.where("text is null").union(rest).select("doc_id", *columns)


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of every row of ``doc_id, ids``; null ids read as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(tokenizer)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
