"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded at once. A longer one is encoded as overlapping chunks
with token offsets. Two neighbouring chunks are spliced at a boundary inside their overlap that

* is a token boundary in both encodings, and
* is proven stable: a space after a non-space. No piece of the vocabulary holds a space after another
  character (checked when the model loads), so no merge crosses such a place, and the tokens on either
  side do not depend on the other side.

Where an overlap holds no such boundary it is widened, twice as wide each time, up to the whole chunk,
and then the chunk itself grows. So memory beside the text itself stays bounded by ``chunk`` as long as
the text has boundaries, and the count always equals that of the whole text.

Null and empty texts have no bytes and no tokens. Repeated rows give repeated results; other columns are
left aside; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textkit import slices, text_bytes

SPACE = "▁"
_MODELS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts pieces of a sentencepiece BPE model."""

    def __init__(self, path: str, chunk: int, overlap: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.stable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.bytes = np.array([1 if self.sp.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def encode(self, text: str) -> np.ndarray | None:
        """Byte offsets at which tokens end, or None where they do not account for every byte of the text."""
        ids = np.array(self.sp.encode(text, num_threads=1), np.int64)
        ends = np.cumsum(self.bytes[ids]) - 1  # the model puts one space in front
        return ends if len(ends) and ends[-1] == len(text.encode()) else None

    def splice(self, text: str, low: int, high: int) -> Iterator[int]:
        """Stable places between two characters, from the right."""
        at = text.rfind(" ", low + 1, high)
        while at > low:
            if text[at - 1] != " ":
                yield at
            at = text.rfind(" ", low + 1, at)

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.stable:
            return len(self.sp.encode(text, num_threads=1))
        total, begin, start, size, wide = 0, 0, 0, self.chunk, self.overlap
        current = self.encode(text[:size])
        while True:
            end = begin + size
            if current is None:  # the model rewrites the text, so offsets mean nothing
                return len(self.sp.encode(text, num_threads=1))
            done = len(text[begin:start].encode()) if start else -1  # the space put in front counts once, before any splice
            if end >= len(text):
                return total + int((current > done).sum())
            following = None
            while following is None:
                low = max(start, end - wide)
                tail = self.encode(text[low : low + self.chunk])
                if tail is None:
                    return len(self.sp.encode(text, num_threads=1))
                for at in self.splice(text, low, end):
                    left, right = len(text[begin:at].encode()), len(text[low:at].encode())
                    if current[np.searchsorted(current, left) % len(current)] == left and tail[np.searchsorted(tail, right) % len(tail)] == right:
                        following = (low, at, left, tail)
                        break
                if following is None:
                    if low == start:
                        break
                    wide *= 2
            if following is None:  # no boundary in the whole chunk: let it grow
                size = (end - begin) * 2
                current = self.encode(text[begin : begin + size])
                wide = self.overlap
                continue
            low, at, left, tail = following
            total += int(((current > done) & (current <= left)).sum())
            begin, start, size, wide, current = low, at, self.chunk, self.overlap, tail


def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    key = f"{path}|{chunk}|{overlap}"
    if key not in _MODELS:
        _MODELS[key] = PieceCounter(path, chunk, overlap)
    return _MODELS[key]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``doc_id, text``."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must lie between 0 and chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model, chunk, overlap)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = np.zeros(len(texts), np.int64)
            if short:
                counts[short] = [len(x) for x in pieces.sp.encode([texts[i] for i in short], num_threads=1)]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = pieces.count(t)
            sizes = np.diff(text_bytes(batch.column(1))[1])
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {dict(plain.dtypes)['doc_id']}, n_bytes long, n_tokens long"
    return plain.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
