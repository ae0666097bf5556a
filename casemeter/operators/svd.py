"""Truncated SVD of sparse rows by randomised block power iteration.

Each round multiplies a block of directions by A and by its transpose in one pass over the rows (Arrow batches, matrix
products); the sums of the tasks meet in blocks of features. The directions are then orthogonalised; singular values come from a
tall-skinny QR of A times the directions, in which every task and every merge keeps one small triangle. The driver holds
``width x (rank + oversample)`` numbers, which :data:`MAX_ENTRIES` bounds, and no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks

#: Most numbers of one block of directions; 8 bytes each.
MAX_ENTRIES = 16 << 20
_PIECE = 1 << 15
_FEATURES = 256
_MERGES = 16


class Factors(NamedTuple):
    values: np.ndarray  # singular values, falling
    components: np.ndarray  # width x rank, orthonormal columns


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, index and value of the entries of some rows at a time; rows count from the piece's first."""
    lists = batch.column("indices")
    at = lists.offsets.to_numpy().astype(np.int64)
    index = lists.values.to_numpy()
    value = batch.column("values").values.to_numpy()
    shift = batch.column("values").offsets[0].as_py() - int(at[0])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE, "right")) - 1)
        row = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
        yield row, index[at[first] : at[last]], value[at[first] + shift : at[last] + shift], last - first
        first = last


def _times(row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int, directions: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, directions.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(value[:, None] * directions[index], starts, axis=0)
    return out


def _turned(directions: np.ndarray):
    """The transpose of A times A times ``directions`` over a task's rows, in blocks of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros_like(directions), np.zeros(len(directions), bool)
        for batch in batches:
            for row, index, value, rows in _pieces(batch):
                if not len(row):
                    continue
                product = _times(row, index, value, rows, directions)
                order = np.argsort(index, kind="stable")
                starts = np.flatnonzero(np.diff(index[order], prepend=-1))
                at = index[order][starts]
                total[at] += np.add.reduceat(value[order][:, None] * product[row[order]], starts, axis=0)
                met[at] = True
        yield blocks.emit({b: total[b * _FEATURES : (b + 1) * _FEATURES] for b in np.unique(np.flatnonzero(met) // _FEATURES).tolist()})

    return run


def gram_times(rows: DataFrame, directions: np.ndarray) -> np.ndarray:
    """Transpose of A times A times ``directions`` for the rows A (``indices``, ``values``)."""
    out = np.zeros_like(directions)
    for block, data in blocks.summed(rows.select("indices", "values").mapInArrow(_turned(directions), blocks.SCHEMA)).items():
        out[block * _FEATURES : (block + 1) * _FEATURES] = data.reshape(-1, directions.shape[1])
    return out


def _triangle(directions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = directions.shape[1]
        kept = np.zeros((0, size))
        for batch in batches:
            for row, index, value, rows in _pieces(batch):
                kept = np.linalg.qr(np.vstack([kept, _times(row, index, value, rows, directions)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["data"])

    return run


def _merged(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, size))
        for batch in batches:
            for data in batch.column("data"):
                kept = np.linalg.qr(np.vstack([kept, np.frombuffer(data.as_buffer(), np.float64).reshape(-1, size)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["data"])

    return run


def triangle(rows: DataFrame, directions: np.ndarray) -> np.ndarray:
    """R of the QR factors of A times ``directions``: of each task, then of a few merges, then of those."""
    size = directions.shape[1]
    parts = rows.select("indices", "values").mapInArrow(_triangle(directions), "data binary").repartition(_MERGES)
    found = parts.mapInArrow(_merged(size), "data binary").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(bytes(r["data"]), np.float64).reshape(-1, size) for r in found]), mode="r")


def fit(rows: DataFrame, width: int, rank: int, oversample: int = 32, rounds: int = 6, seed: int = 0) -> Factors:
    """The ``rank`` largest singular values and right vectors of ``rows``, uncentred; at most min(rows, width) - 1 of them.

    Directions start as Gaussian draws. Of each component the entry of largest size is positive.
    """
    rank = max(1, min(rank, min(rows.count(), width) - 1))
    size = min(width, rank + oversample)
    if width * size > MAX_ENTRIES:
        raise ValueError(f"{width} features x {size} directions; at most {MAX_ENTRIES} numbers")
    directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(rounds):
        directions = np.linalg.qr(gram_times(rows, directions))[0]
    _, values, turn = np.linalg.svd(triangle(rows, directions), full_matrices=False)
    components = directions @ turn[:rank].T
    components *= np.sign(components[np.abs(components).argmax(0), np.arange(components.shape[1])])
    return Factors(values[:rank], components)


def project(rows: DataFrame, components: np.ndarray, out: str = "svd", indices: str = "indices", values: str = "values") -> DataFrame:
    """Add the coordinates of each row as an array; the components travel with the tasks."""
    keep = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_times(*piece, components) for piece in _pieces(batch.rename_columns([{indices: "indices", values: "values"}.get(n, n) for n in batch.schema.names]))]
            flat = np.concatenate(done) if done else np.zeros((0, components.shape[1]))
            at = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * components.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(at, pa.array(flat.ravel()))], names=[*keep, out])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep).mapInArrow(run, f"{schema}, `{out}` array<double>")


def residuals(rows: DataFrame, factors: Factors) -> np.ndarray:
    """Length of what A's Gram matrix leaves off each component's own line, as a share of the largest eigenvalue."""
    turned = gram_times(rows, factors.components)
    return np.linalg.norm(turned - factors.components * factors.values**2, axis=0) / factors.values[0] ** 2


def centre(rows: DataFrame, column: str, rank: int) -> DataFrame:
    """One row ``mean, sd`` of arrays: means and population deviations of a vector column, zero deviation as one."""
    each = rows.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    each = each.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean", "sd"))).alias("s")  # one entry for each of ``rank`` places
    return each.where(F.col("at") < rank).agg(ordered).select(F.col("s.mean").alias("mean"), F.col("s.sd").alias("sd"))


def scale(rows: DataFrame, column: str, fitted: DataFrame, out: str) -> DataFrame:
    """Subtract the means and divide by the deviations of :func:`centre`, whose one row joins every row."""
    parts = F.zip_with(F.zip_with(F.col(column), F.col("_fit.mean"), lambda x, m: x - m), F.col("_fit.sd"), lambda x, d: x / d)
    return rows.crossJoin(F.broadcast(fitted.select(F.struct("mean", "sd").alias("_fit")))).withColumn(out, parts).drop("_fit")
