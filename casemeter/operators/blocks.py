"""Sums of numeric blocks that tasks make: each task adds what it sees, each block meets once more in a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "block long, data binary"


def emit(blocks: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    """Blocks of doubles as one batch of :data:`SCHEMA`."""
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([np.ascontiguousarray(x).tobytes() for x in blocks.values()], pa.binary())], names=["block", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
            part = np.frombuffer(data.as_buffer(), np.float64)
            total[block] = total[block] + part if block in total else part.copy()
    yield emit(total)


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums on the driver. Callers bound the blocks' number and size; the rows of a partition are added as they come."""
    return {r["block"]: np.frombuffer(bytes(r["data"]), np.float64) for r in parts.repartition("block").mapInArrow(_added, SCHEMA).collect()}
