"""Gradient boosting of many classes over binned features, with early stopping.

Every round grows one tree per class on the softmax gradients. A level costs one pass: each task adds its rows to histograms
of gradient, curvature and count by (class, node, feature, bin), and the tasks' histograms are summed in a shuffle. The driver
holds one level's histograms, which :data:`MAX_ENTRIES` bounds, and chooses the splits.

Gradients are whole multiples of 2**-20, so sums are exact in any order and a split does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpointed
from . import blocks

#: Most numbers of one level's histograms on the driver, and of the fine grid that bins are cut from.
MAX_ENTRIES = 16 << 20
#: Cells of a feature's range; bins are unions of neighbouring cells with about equal counts.
CELLS = 1024
_UNIT = float(1 << 20)
#: Gains are compared after rounding to so many digits, the smaller feature and bin win ties.
_DIGITS = 6
_SCORES = -1


@dataclass(frozen=True)
class Bins:
    """Range of each feature and the bin of each of its cells; bin 0 is for missing values."""

    low: np.ndarray
    high: np.ndarray
    of_cell: np.ndarray  # features x CELLS
    count: int

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for f in range(x.shape[1]):
            known = np.isfinite(x[:, f])
            out[known, f] = self.of_cell[f, _cells(x[known, f], self.low[f], self.high[f])]
        return out


def _cells(x: np.ndarray, low: float, high: float) -> np.ndarray:
    if not high > low:
        return np.zeros(len(x), np.int64)
    return np.clip(np.floor((x - low) / (high - low) * CELLS), 0, CELLS - 1).astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column as a matrix; null components and rows are missing values."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.full((len(lists), dims), np.nan)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != dims * (len(lists) - lists.null_count):
        raise ValueError(f"a row has not {dims} features")
    out[~lists.is_null().to_numpy(zero_copy_only=False)] = flat.reshape(-1, dims)
    return out


def fit_bins(train: DataFrame, features: str, dims: int, count: int = 32) -> Bins:
    """Two passes over the training rows: ranges, then counts of the cells."""
    if not 2 <= count <= 254 or dims * CELLS > MAX_ENTRIES:
        raise ValueError("2 to 254 bins, and at most 16,384 features")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.inf), np.full(dims, -np.inf)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            known = np.isfinite(x)
            low = np.minimum(low, np.where(known, x, np.inf).min(0, initial=np.inf))
            high = np.maximum(high, np.where(known, x, -np.inf).max(0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], names=["f", "low", "high"])

    found = train.select(features).mapInArrow(ranges, "f long, low double, high double").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("f")
    low, high = found["low"].to_numpy(), found["high"].to_numpy()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, CELLS))
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for f in range(dims):
                total[f] += np.bincount(_cells(x[np.isfinite(x[:, f]), f], low[f], high[f]), minlength=CELLS)
        yield blocks.emit({f: total[f] for f in range(dims)})

    cells = np.stack([x for _, x in sorted(blocks.summed(train.select(features).mapInArrow(counts, blocks.SCHEMA)).items())])
    before = np.cumsum(cells, 1) - cells
    return Bins(low, high, 1 + np.floor(before * count / np.maximum(cells.sum(1, keepdims=True), 1)).astype(np.uint8), count)


@dataclass
class Tree:
    """Nodes in heap order: feature and last bin of the left side, or -1 and a value."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches within so many levels."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            at[inner] = 2 * at[inner] + 1 + (bins[inner, f[inner]] > self.split[at[inner]])
        return at


@dataclass
class Boosted:
    """Priors and rounds of trees, one for each class."""

    bins: Bins
    prior: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def scores(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        out = np.tile(self.prior, (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds[first:]:
            for c, tree in enumerate(trees):
                out[:, c] += tree.value[tree.nodes(bins, self.depth)]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each node that some training row reached."""
        rows = [
            (r, c, n, int(t.feature[n]), int(t.split[n]), float(t.gain[n]), float(t.value[n]), int(t.rows[n]))
            for r, trees in enumerate(self.rounds) for c, t in enumerate(trees) for n in range(len(t.feature)) if t.rows[n]
        ]
        return spark.createDataFrame(rows, "round bigint, class bigint, node bigint, feature bigint, split bigint, gain double, value double, rows bigint")


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * _UNIT + 0.5)


def _level(model: Boosted, growing: list[Tree], level: int, state_rounds: int):
    """Histograms (gradient, curvature, count) of the level's nodes by class, and at the root the loss of the validation rows."""
    dims, size, classes = len(model.bins.low), model.bins.count + 1, len(model.prior)
    first, width = (1 << level) - 1, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, width, 3, dims * size))
        loss = np.zeros(2)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, dims)
            label, held = batch.column("label").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            start = matrix(batch.column("scores"), classes)
            p = _softmax(model.scores(bins, start, state_rounds))
            if level == 0:
                loss += -np.log(np.maximum(p[held, label[held]], 1e-15)).sum(), held.sum()
            bins, label, p = bins[~held], label[~held], p[~held]
            for c, tree in enumerate(growing):
                g, h = _whole((label == c) - p[:, c]), _whole(p[:, c] * (1 - p[:, c]))
                at = tree.nodes(bins, level) - first
                on = np.flatnonzero(at >= 0)
                place = ((at[on] * dims)[:, None] + np.arange(dims)) * size + bins[on]
                for k, w in enumerate((g[on], h[on], np.ones(len(on)))):
                    total[c, :, k] += np.bincount(place.ravel(), np.repeat(w, dims), width * dims * size).reshape(width, -1)
        out = {c * width + n: total[c, n] for c in range(classes) for n in range(width) if total[c, n].any()}
        yield blocks.emit(out | ({_SCORES: loss} if level == 0 else {}))

    return run


def best_split(hist: np.ndarray, dims: int, size: int, penalty: float, min_rows: int) -> tuple[float, int, int, np.ndarray]:
    """Gain, feature and last left bin of a node's best split, and its sums, from (3, features x bins) sums."""
    left = np.cumsum(hist.reshape(3, dims, size), 2)
    whole = left[:, 0, -1]
    right = whole[:, None, None] - left
    part = lambda s: s[0] * s[0] / (s[1] + penalty * _UNIT)
    gain = (part(left) + part(right) - part(whole)) / _UNIT
    gain = np.where((left[2] >= min_rows) & (right[2] >= min_rows), np.round(gain, _DIGITS), -np.inf)
    best = int(gain.argmax())
    return float(gain.flat[best]), best // size, best % size, whole


def fit(
    rows: DataFrame, features: str, label: str, classes: int, dims: int, rounds: int = 100, depth: int = 3, rate: float = 0.1, penalty: float = 1.0, min_rows: int = 5,
    bins: int = 32, held: str | None = None, patience: int = 10, refresh: int = 25,
) -> Boosted:
    """Boosted trees of the rows where ``held`` is false; with ``held`` rows, rounds end once their log loss has not fallen for ``patience`` rounds.

    What the rows need is written once: bins, label and scores; the scores are written anew every ``refresh`` rounds. Labels run from 0 to
    ``classes - 1``; a class without training rows keeps a prior of one row.
    """
    if classes * (1 << (depth - 1)) * dims * (bins + 1) * 3 > MAX_ENTRIES:
        raise ValueError("too many classes, nodes, features and bins for one level's histograms")
    flag = F.lit(False) if held is None else F.col(held)
    rows = rows.select(F.col(features).alias("features"), F.col(label).cast("int").alias("label"), flag.alias("held"))
    cut = fit_bins(rows.where("not held"), "features", dims, bins)
    n = np.ones(classes)
    for r in rows.where("not held").groupBy("label").count().collect():
        n[r["label"]] = r["count"]
    model = Boosted(cut, np.log(n / n.sum()), depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([b.tobytes() for b in cut.place(matrix(batch.column("features"), dims))], pa.binary())
            start = pa.array(np.tile(model.prior, (batch.num_rows, 1)).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([data, batch.column("label"), batch.column("held"), start], names=["bins", "label", "held", "scores"])

    schema = "bins binary, label int, held boolean, scores array<double>"
    state, state_rounds = checkpointed(rows.mapInArrow(placed, schema)), 0
    best = (np.inf, 0)
    for number in range(rounds + (held is not None)):
        growing = [Tree.empty(depth) for _ in range(classes)]
        for level in range(depth):
            found = blocks.summed(state.mapInArrow(_level(model, growing, level, state_rounds), blocks.SCHEMA))
            if level == 0 and held is not None:
                loss, count = found.pop(_SCORES)
                model.losses.append(float(loss / max(count, 1)))
                best = min(best, (model.losses[-1], number))
                if number == rounds or number - best[1] >= patience:
                    model.rounds = model.rounds[: best[1]]
                    return model
            found.pop(_SCORES, None)
            for key, data in found.items():
                c, node = key >> level, (key & ((1 << level) - 1)) + (1 << level) - 1
                _decide(growing[c], node, data.reshape(3, -1), dims, bins + 1, penalty, min_rows, rate)
        model.rounds.append(growing)
        if len(model.rounds) - state_rounds >= refresh:
            state, state_rounds = checkpointed(state.mapInArrow(_rescored(model, state_rounds, dims), schema)), len(model.rounds)
    return model


def _decide(tree: Tree, node: int, hist: np.ndarray, dims: int, size: int, penalty: float, min_rows: int, rate: float) -> None:
    """Split ``node`` or leave it a leaf; its children get the values of leaves until they are split themselves."""
    gain, feature, split, whole = best_split(hist, dims, size, penalty, min_rows)
    tree.rows[node] = int(whole[2])
    value = lambda s: rate * s[0] / (s[1] + penalty * _UNIT)
    tree.value[node] = value(whole)
    if gain <= 10.0**-_DIGITS:
        return
    tree.feature[node], tree.split[node], tree.gain[node] = feature, split, gain
    left = hist.reshape(3, dims, size)[:, feature, : split + 1].sum(1)
    for child, sums in ((2 * node + 1, left), (2 * node + 2, whole - left)):
        tree.value[child], tree.rows[child] = value(sums), int(sums[2])


def _rescored(model: Boosted, done: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, dims)
            scores = model.scores(bins, matrix(batch.column("scores"), len(model.prior)), done)
            yield batch.set_column(3, "scores", pa.array(scores.tolist(), pa.list_(pa.float64())))

    return run


def predict(model: Boosted, rows: DataFrame, features: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, raw class (the smallest on ties) and probabilities."""
    dims = len(model.bins.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _softmax(model.scores(model.bins.place(matrix(batch.column(features), dims))))
            out = [pa.array(p.argmax(1).astype(np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=[*keep, "raw", "probabilities"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, features])).mapInArrow(run, f"{schema}, raw int, probabilities array<double>")
