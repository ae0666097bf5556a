"""Extremely randomised trees, grown level by level: one random cut for each (tree, node, feature), one pass over the rows a level.

A node looks at ``tried`` features, those with the smallest digests of (seed, tree, node, feature); the same digest places the cut
within the node's interval of the feature, which starts as the range of the training rows and shrinks with the cuts above. So a level's cuts
are known before its rows are read, each task counts its rows by (tree, node, feature tried, side, class), and the tasks' counts
are summed in a shuffle. Counts are whole numbers: trees do not depend on the partitioning. The driver holds one level's counts,
which :data:`~.boosting.MAX_ENTRIES` bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blocks
from .boosting import MAX_ENTRIES, matrix

#: Impurity decreases are compared after rounding to so many digits; the smaller feature wins ties.
_DIGITS = 9


@dataclass
class Node:
    """A node with class counts, and its cut once it has one: rows with a value up to ``cut`` or a missing one go left."""

    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    feature: int = -1
    cut: float = 0.0
    decrease: float = 0.0


@dataclass
class Forest:
    classes: int
    dims: int
    trees: list[dict[int, Node]]  # by heap number

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t, n, node.feature, float(node.cut), float(node.decrease), [int(x) for x in node.counts])
            for t, tree in enumerate(self.trees) for n, node in sorted(tree.items())
        ]
        return spark.createDataFrame(rows, "tree bigint, node bigint, feature bigint, cut double, decrease double, counts array<bigint>")

    def arrays(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Feature, cut and class shares of each tree's nodes, in heap order."""
        out = []
        for tree in self.trees:
            size = max(tree) + 1
            feature, cut, share = np.full(size, -1), np.zeros(size), np.zeros((size, self.classes))
            for n, node in tree.items():
                feature[n], cut[n], share[n] = node.feature, node.cut, node.counts / max(node.counts.sum(), 1)
            out.append((feature, cut, share))
        return out


def drawn(seed: int, tree: int, node: int, feature: int) -> tuple[str, float]:
    """The digest that orders the features of a node, and where in the interval it cuts."""
    hexed = hashlib.sha256(f"{seed}|{tree}|{node}|{feature}".encode()).hexdigest()
    return hexed, int(hexed[:13], 16) / float(1 << 52)


def _plan(forest: Forest, level: int, tried: int, seed: int, min_rows: int) -> list[dict[int, tuple[list[int], np.ndarray]]]:
    """Features and cuts that each open node of a level tries; pure and small nodes are closed."""
    out = []
    for t, tree in enumerate(forest.trees):
        plan = {}
        for n in range((1 << level) - 1, (1 << (level + 1)) - 1):
            if n not in tree or (tree[n].counts > 0).sum() < 2 or tree[n].counts.sum() < 2 * min_rows:
                continue
            node = tree[n]
            draws = {f: drawn(seed, t, n, f) for f in range(forest.dims)}
            features = sorted(sorted(draws, key=lambda f: draws[f][0])[:tried])
            plan[n] = features, np.array([node.low[f] + draws[f][1] * (node.high[f] - node.low[f]) for f in features])
        out.append(plan)
    return out


def _reached(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(levels):
        inner = np.flatnonzero(feature[at] >= 0)
        at[inner] = 2 * at[inner] + 1 + (x[inner, feature[at[inner]]] > cut[at[inner]])
    return at


def _counted(forest: Forest, plans: list[dict], level: int, features: str, label: str):
    trees, classes, dims = forest.arrays(), forest.classes, forest.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [{n: np.zeros((len(fs), 2, classes)) for n, (fs, _) in plan.items()} for plan in plans]
        for batch in batches:
            x, y = matrix(batch.column(features), dims), batch.column(label).to_numpy()
            for (feature, cut, _), plan, sums in zip(trees, plans, total):
                at = _reached(x, feature, cut, level)
                for n, (fs, cuts) in plan.items():
                    here = np.flatnonzero(at == n)
                    side = x[here][:, fs] > cuts
                    place = (np.arange(len(fs)) * 2 + side) * classes + y[here][:, None]
                    sums[n] += np.bincount(place.ravel(), minlength=len(fs) * 2 * classes).reshape(-1, 2, classes)
        yield blocks.emit({(t << 32) | n: x for t, sums in enumerate(total) for n, x in sums.items() if x.any()})

    return run


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times rows."""
    n = counts.sum(-1)
    return n - (counts * counts).sum(-1) / np.maximum(n, 1)


def fit(rows: DataFrame, features: str, label: str, classes: int, dims: int, trees: int = 100, depth: int = 8, tried: int | None = None, min_rows: int = 1, seed: int = 0) -> Forest:
    """A forest on all rows, whose labels run from 0 to ``classes - 1``. ``tried`` defaults to the root of the number of features.

    A node is cut where the impurity falls most and both sides keep ``min_rows`` rows.
    """
    tried = min(dims, tried or max(1, isqrt(dims)))
    if trees * (1 << (depth - 1)) * tried * 2 * classes > MAX_ENTRIES:
        raise ValueError("too many trees, nodes, features and classes for one level's counts")
    rows = rows.select(features, F.col(label).cast("int").alias(label))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full(dims, np.inf), np.full(dims, -np.inf), np.zeros(classes, np.int64)
        for batch in batches:
            x = matrix(batch.column(features), dims)
            known = np.isfinite(x)
            low = np.minimum(low, np.where(known, x, np.inf).min(0, initial=np.inf))
            high = np.maximum(high, np.where(known, x, -np.inf).max(0, initial=-np.inf))
            count += np.bincount(batch.column(label).to_numpy(), minlength=classes)
        place = [*range(dims), *(-1 - c for c in range(classes))]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([*low, *[0.0] * classes]), pa.array([*high, *[0.0] * classes]), pa.array([*[0] * dims, *count.tolist()], pa.int64())], names=["f", "low", "high", "n"])

    found = rows.mapInArrow(roots, "f long, low double, high double, n long").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    by = {r["f"]: r for r in found}
    counts = np.array([by[-1 - c]["n"] if by else 0 for c in range(classes)], np.int64)
    bound = lambda name: np.array([by[f][name] if by and np.isfinite(by[f][name]) else 0.0 for f in range(dims)])
    forest = Forest(classes, dims, [{0: Node(counts, bound("low"), bound("high"))} for _ in range(trees)])
    for level in range(depth):
        plans = _plan(forest, level, tried, seed, min_rows)
        if not any(plans):
            break
        for key, data in blocks.summed(rows.mapInArrow(_counted(forest, plans, level, features, label), blocks.SCHEMA)).items():
            t, n = key >> 32, key & 0xFFFFFFFF
            tried_features, cuts = plans[t][n]
            sides = data.reshape(-1, 2, classes).astype(np.int64)
            node = forest.trees[t][n]
            fall = np.round((_impurity(sides.sum(1)) - _impurity(sides).sum(1)) / sides.sum((1, 2)), _DIGITS)
            fall = np.where((sides.sum(2) >= min_rows).all(1), fall, -1.0)
            best = int(fall.argmax())
            if fall[best] <= 0:
                continue
            f, cut = tried_features[best], float(cuts[best])
            node.feature, node.cut, node.decrease = f, cut, float(fall[best])
            for side, child in enumerate((2 * n + 1, 2 * n + 2)):
                low, high = node.low.copy(), node.high.copy()
                (high if side == 0 else low)[f] = cut
                forest.trees[t][child] = Node(sides[best, side], low, high)
    return forest


def predict(forest: Forest, rows: DataFrame, features: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, raw class (the smallest on ties) and the mean of the trees' class shares."""
    trees, depth = forest.arrays(), max(max(t).bit_length() for t in forest.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(features), forest.dims)
            p = sum(share[_reached(x, feature, cut, depth)] for feature, cut, share in trees) / len(trees)
            out = [pa.array(np.round(p, 12).argmax(1).astype(np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=[*keep, "raw", "probabilities"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, features])).mapInArrow(run, f"{schema}, raw int, probabilities array<double>")
