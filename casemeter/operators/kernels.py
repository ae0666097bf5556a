"""Kernel features by landmarks (Nyström): a linear model on them is a kernel machine.

Landmarks are the training rows with the smallest draws. The root of the inverse of their kernel matrix travels with the tasks, and a row's features are
the kernel of the row and the landmarks times that root: one matrix product for an Arrow batch. Inner products of the features equal the kernel exactly where
one of the rows is a landmark, and approximately elsewhere. The driver holds ``landmarks x (dims + landmarks)`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.keys import draw
from .boosting import matrix

#: Most landmarks of one map.
MAX_LANDMARKS = 5_000
#: Eigenvalues under this share of the largest count as zero.
_FLOOR = 1e-12


class Landmarks(NamedTuple):
    ids: list
    rows: np.ndarray
    root: np.ndarray
    gamma: float


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - y|^2) for all pairs of rows."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(square, 0.0))


def fit(train: DataFrame, row_id: str, vector: str, dims: int, gamma: float, count: int = 300, seed: int = 0) -> Landmarks:
    """``count`` landmarks, or all training rows if there are fewer. Rows without a vector, or with a missing component, are none."""
    if not 1 <= count <= MAX_LANDMARKS:
        raise ValueError(f"1 to {MAX_LANDMARKS} landmarks")
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rows = train.where(whole).select(row_id, F.col(vector).cast("array<double>").alias("v")).orderBy(draw(seed, row_id), row_id).limit(count).collect()
    if not rows:
        raise ValueError("no training row to take landmarks from")
    points = np.array([r["v"] for r in rows])
    if points.shape[1] != dims:
        raise ValueError(f"a row has not {dims} features")
    values, vectors = np.linalg.eigh(rbf(points, points, gamma))
    scale = np.where(values > _FLOOR * values[-1], 1 / np.sqrt(np.maximum(values, _FLOOR * values[-1])), 0.0)
    return Landmarks([r[row_id] for r in rows], points, (vectors * scale) @ vectors.T, gamma)


def transform(landmarks: Landmarks, df: DataFrame, vector: str, out: str = "kernel") -> DataFrame:
    """Add the features of each row as an array; a row without a vector, or with a missing component, gets null."""
    dims = landmarks.rows.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(vector), dims)
            known = np.isfinite(x).all(1)
            z = rbf(x[known], landmarks.rows, landmarks.gamma) @ landmarks.root
            at = np.concatenate([[0], np.cumsum(known)]).astype(np.int32) * z.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(z.ravel()), mask=pa.array(~known))
            yield batch.append_column(out, lists)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` array<double>")


def kernel_of(left: str, right: str):
    """The inner product of two feature columns."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
