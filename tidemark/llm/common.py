"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> Iterator[str]:
    """The column's strings one at a time, null as empty."""
    for value in column:
        yield value.as_py() or ""


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; row i is bytes[offsets[i]:offsets[i + 1]]."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1] \
        if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes, so that what a worker makes of a whole one isn't held together."""
    for b in batches:
        rows = max(1, b.num_rows * size // max(b.nbytes, 1))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def blocks_of(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``size`` bytes together (one longer row stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def crc_mod(id_col: str, k: int):
    """crc32 of the id written as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(k)
