"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from revspark.session import shared_path, ship_package, table_path

#: Rows of a task's Arrow batch are worked on in slices of about this many text bytes.
SLICE_BYTES = 4_000_000

#: Bytes of a word in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z, every byte of a
#: character outside ASCII.
WORD = rb"[0-9a-z\x80-\xff]+"
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: ASCII white space: what `bytes.split()` cuts at, the complement of `[^\x20\x09-\x0D]`.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: cuts the lineage, survives lost executors."""
    ship_package(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def word_bounds(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a lower-cased text start and end."""
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = IS_WORD[np.frombuffer(low, dtype=np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over unsigned 64-bit integers (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def struct_array(fields: list[tuple[str, pa.DataType, list | np.ndarray]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v, type=t) for _, t, v in fields], names=[n for n, _, _ in fields])


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream of batches that is sorted by `key` into tables of whole groups, several groups to a table."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = held.column(key).to_numpy()
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()
