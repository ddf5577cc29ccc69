"""Hashes of words in a block of text, and a filter of bounded size for hashes that are known to matter.

Both only save traffic: whatever passes the filter is compared word by word later, so that equal hashes of different
words cost time but change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import mix64

#: The filter has at least so many bits an entry, as long as it stays under MAX_BITS (32 MB, broadcast once).
BITS_AN_ENTRY = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
_SLICES = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_SPAN = 1 << 16
_WORDS_AT_ONCE = 1 << 18
_UP = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SPAN - 1, _STEP)]), dtype=np.uint64)


def word_edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of True start and end."""
    padded = np.zeros(len(inside) + 2, dtype=np.int8)
    padded[1:-1] = inside
    edge = np.diff(padded)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word block[start:end]; the words are in order and do not touch."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), _WORDS_AT_ONCE):
        s, e = starts[k:k + _WORDS_AT_ONCE], ends[k:k + _WORDS_AT_ONCE]
        lengths = e - s
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        values = (block[within + np.repeat(s, lengths)].astype(np.uint64) + np.uint64(1)) * _UP[within & (_SPAN - 1)]
        out[k:k + _WORDS_AT_ONCE] = np.add.reduceat(values, first)
    return mix64(out)


def hash_grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words, from the hashes of the words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out *= _NEXT
        out += words[k:len(words) - n + 1 + k]
    return mix64(out)


def hash_filter(hashes: DataFrame, column: str) -> Broadcast:
    """A bit for each value of a long column of distinct hashes, broadcast.

    Its size follows the number of hashes up to MAX_BITS. Beyond that it lets more and more others pass. It is filled by
    slices on the executors; the driver gets only the finished bits.
    """
    entries = hashes.count()
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_AN_ENTRY * entries):
        bits *= 2
    size = bits // _SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = _slot(batch.column("h").to_numpy().view(np.uint64), bits)
            for k in np.unique(slot // size):
                part = own.setdefault(int(k), np.zeros(size, dtype=bool))
                part[slot[slot // size == k] % size] = True
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()],
                                                                                    pa.binary())], names=["slice", "bits"])

    cut = hashes.select(F.col(column).alias("h")).withColumn("s", F.shiftrightunsigned("h", 58)).repartition("s").drop("s")
    table = np.zeros((_SLICES, size // 8), dtype=np.uint8)
    for row in cut.mapInArrow(fill, "slice int, bits binary").collect():  # _SLICES rows, MAX_BITS in all at most
        table[row["slice"]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(65 - int(bits).bit_length())).astype(np.int64)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter: all that are, and few others."""
    slot = _slot(h, 8 * len(table))
    return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
