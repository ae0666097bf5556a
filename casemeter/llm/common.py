"""What several operators share: tables by path, written intermediate tables, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemeter.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared store and read it back.

    This cuts the lineage so that lost executors cost at most the unfinished stage. Nothing reads the shuffles of the write after it, so they are
    deleted at its end instead of filling the disk until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    folder, before = f"{shared_folder(df.sparkSession)}/table", conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Cells, as a power of two, of the table that tells ``without`` which rows may go: 2 MiB of bits.
_CELLS = 24


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` does not stand in ``gone``; keys are not null.

    Where few rows go, few are shuffled: a broadcast table of bits, of bounded size whatever ``gone`` has, lets most rows that stay pass where they are.
    Only rows with a marked cell are joined, which decides. ``docs`` is read twice.
    """
    word, bits, other = "_casemeter_word", "_casemeter_bits", "_casemeter_gone"
    gone = written(gone.select(F.col(key).alias(other)).distinct())

    def place(column: str) -> tuple[Column, Column]:
        cell = F.shiftrightunsigned(F.xxhash64(column), 64 - _CELLS)
        return F.shiftright(cell, 6), cell.bitwiseAND(F.lit(63)).cast("int")

    at, bit = place(other)
    marks = gone.groupBy(at.alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits))
    at, bit = place(key)
    met = docs.join(F.broadcast(marks), at == F.col(word), "left")
    marked = F.coalesce(F.getbit(bits, bit), F.lit(0)) == 1
    unsure = met.where(marked).drop(word, bits).join(gone, F.col(key) == F.col(other), "left_anti")
    return met.where(~marked).drop(word, bits).union(unsure)


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offset of each text in them; nulls count as empty. Nothing is copied."""
    column = one_array(column)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``size`` bytes of text; a longer text stands alone and stays whole."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
