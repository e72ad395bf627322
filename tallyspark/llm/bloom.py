"""Bloom filters of 64-bit hashes, built by aggregation.

A filter spares a join the rows that can't match; the join itself decides.  Its size follows the number of keys up to
``MOST_WORDS`` words of 64 bits (32 MB).  Beyond some 16 million keys it lets more and more rows pass, and results stay
the same.  The driver sees the words of the filter, never the keys.  An empty filter holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textkit import mix

LEAST_WORDS = 1 << 10
MOST_WORDS = 1 << 22
PROBES = 4
BITS_A_KEY = 16


def words_for(keys: int, most: int = MOST_WORDS) -> int:
    """Words of a filter of so many keys: a power of two."""
    wanted = max(LEAST_WORDS, keys * BITS_A_KEY // 64)
    return min(most, 1 << (wanted - 1).bit_length())


def probes(key: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of each probe of the keys."""
    step = mix(key + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for _ in range(PROBES):
        yield ((key >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), key & np.uint64(63)
        key = key + step


def signed(column: pa.Array) -> np.ndarray:
    """Keys of a column of longs."""
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def build(keys: DataFrame, words: int, read: Callable[[pa.Array], np.ndarray] = signed) -> np.ndarray:
    """The filter of the keys that ``read`` makes of the only column."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, bit in probes(read(batch.column(0)), words):
                yield pa.record_batch([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])

    # At most `words` rows, whatever the number of keys.
    rows = keys.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def holds(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key; never false for a key of it."""
    hit = np.ones(len(key), bool)
    for word, bit in probes(key, len(table)):
        hit &= (table[word] >> bit) & np.uint64(1) == 1
    return hit
