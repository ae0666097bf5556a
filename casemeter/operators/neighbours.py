"""Exact k-nearest-neighbour join without a cross join, and the vote over it.

Training vectors are divided among pivots (Voronoi cells). The triangle inequality bounds
how far each query's k-th neighbour can be, so a query visits only the cells that can hold
one (after Lu, Shen, Chen and Ooi, "Efficient processing of k nearest neighbor joins using
MapReduce", 2012). Cells and their visitors are cut into blocks of bounded size, a block
pair is compared with NumPy, and only ``k`` rows per query leave it. The bound is
conservative: pruning never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.keys import draw

BLOCK_ROWS = 4096
MAX_PIVOTS = 256
_SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences (exact for equal vectors), in slices of bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, 8_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(-1))
    return out


def _closest(a: np.ndarray, b: np.ndarray, k: int, allowed: np.ndarray | None = None, column: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the ``k`` nearest rows of ``b`` for each row of ``a``, ties by place: exactly those that :func:`_distances` gives.

    Inner products find all rows that rounding can leave among the nearest; only their distances are taken by differences. ``allowed[i, column[j]]``
    tells which rows ``j`` count for row ``i``.
    """
    rows, columns, found = [], [], []
    size_a, size_b = (a * a).sum(1), (b * b).sum(1)
    top = size_b.max() if len(b) else 0.0
    step = max(1, 2_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        with np.errstate(over="ignore", invalid="ignore"):
            square = size_a[at : at + step, None] + size_b[None, :] - 2 * (part @ b.T)
        finite = bool(np.isfinite(square).all())
        near = square if finite else np.zeros_like(square)  # numbers that products cannot hold: all are compared
        open_ = None if allowed is None else allowed[at : at + step][:, column]
        if open_ is not None:
            near = np.where(open_, near, np.inf)
        n = min(k, len(b))
        reach = np.partition(near, n - 1, axis=1)[:, n - 1] + (_SLACK * (size_a[at : at + step] + top) if finite else 0.0)
        hit = near <= reach[:, None]
        i, j = np.nonzero(hit if open_ is None else hit & open_)
        exact = np.empty(len(i))
        pairs = max(1, 4_000_000 // max(1, a.shape[1]))
        for x in range(0, len(i), pairs):
            some = slice(x, x + pairs)
            exact[some] = np.sqrt(((part[i[some]] - b[j[some]]) ** 2).sum(-1))
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows.append(i[kept] + at), columns.append(j[kept]), found.append(exact[kept])
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (columns, np.int64), (found, float)))


def _cells(train: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    schema = StructType([*train.schema.fields, StructField("cell", IntegerType()), StructField("radius", DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_matrix(batch[vector]), pivots)
                cell = d.argmin(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), radius=d[np.arange(len(d)), cell])

    return train.mapInPandas(assign, schema)


def _visits(queries: DataFrame, vector: str, pivots: np.ndarray, cells: np.ndarray, largest: np.ndarray, nearest: list[np.ndarray], k: int) -> DataFrame:
    """Each query with the cells that may hold one of its ``k`` neighbours."""
    schema = StructType([*queries.schema.fields, StructField("cells", ArrayType(IntegerType()))])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            step = max(1, 2_000_000 // max(1, k * len(cells)))
            for batch in (whole.iloc[at : at + step] for at in range(0, len(whole), step)):
                d = _distances(_matrix(batch[vector]), pivots)
                # d(query, pivot) + d(pivot, member) bounds the distance to that member from above.
                upper = np.concatenate([d[:, [c]] + nearest[i][None, :] for i, c in enumerate(cells)], axis=1)
                reach = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
                possible = d[:, cells] - largest[None, :] <= reach[:, None] * (1 + _SLACK) + _SLACK
                yield batch.assign(cells=[cells[p].astype(np.int32).tolist() for p in possible])

    return queries.mapInPandas(visit, schema)


def _slot(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def nearest(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, train_id, distance, rank`` of the exact ``k`` nearest training vectors.

    Ties go to the smaller training id. The driver holds at most ``MAX_PIVOTS`` vectors and,
    per pivot, a count, a radius and ``k`` distances.
    """
    train, queries = train.select(train_id, vector), queries.select(query_id, vector)
    total = train.count()
    # Small cells prune little that products do not compare faster, and cost a row for each query.
    wanted = min(MAX_PIVOTS, max(1, min(int(total**0.5), -(-total // block_rows)) if pivots is None else pivots))
    chosen = train.orderBy(draw("pivot", train_id)).limit(wanted).collect()
    centres = np.array([r[vector] for r in chosen], dtype=np.float64)
    assigned = _cells(train, vector, centres)
    closest = Window.partitionBy("cell").orderBy("radius")
    near = assigned.select("cell", "radius").withColumn("_r", F.row_number().over(closest)).where(F.col("_r") <= k)
    near = near.groupBy("cell").agg(F.sort_array(F.collect_list("radius")).alias("near"))
    stats = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("far")).join(near, "cell").orderBy("cell").collect()
    cells = np.array([r["cell"] for r in stats])
    far = np.array([r["far"] for r in stats])
    visits = _visits(queries, vector, centres, cells, far, [np.array(r["near"]) for r in stats], k)
    sent = visits.select(query_id, vector, F.explode("cells").alias("cell"))
    asked = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [(int(r["cell"]), -(-r["n"] // block_rows), -(-asked.get(r["cell"], 1) // block_rows)) for r in stats]
    return compare_cells(sent, assigned, sizes, query_id, train_id, vector, k)


def compare_cells(sent: DataFrame, members: DataFrame, sizes: list[tuple[int, int, int]], query_id: str, train_id: str, vector: str, k: int) -> DataFrame:
    """``query_id, train_id, distance, rank``: the ``k`` nearest members of the cells that each query is sent to.

    ``sizes`` has (cell, blocks of members, blocks of queries); two blocks of a cell are compared at a time and give ``k`` rows a query.
    Where ``sent`` has a column ``parts``, a query only meets the members whose ``part`` of the cell is among them.
    """
    own, part = (["parts"], ["part"]) if "parts" in sent.columns else ([], [])
    blocks = F.broadcast(sent.sparkSession.createDataFrame(sizes, "cell int, train_blocks int, query_blocks int"))
    spots = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sent.join(blocks, "cell").withColumn("query_block", _slot(query_id, F.col("query_blocks"))).withColumn("train_block", spots("train_blocks"))
    right = members.join(blocks, "cell").withColumn("train_block", _slot(train_id, F.col("train_blocks"))).withColumn("query_block", spots("query_blocks"))
    keys = ["cell", "train_block", "query_block"]
    schema = StructType([sent.schema[query_id], members.schema[train_id], StructField("distance", DoubleType())])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({query_id: [], train_id: [], "distance": []})
        if not len(a) or not len(b):
            return empty
        b = b.sort_values(train_id, ignore_index=True)
        allowed = place = None
        if own:
            parts, place = np.unique(b["part"].to_numpy(), return_inverse=True)
            wanted, asking = np.concatenate(a["parts"].tolist()), np.repeat(np.arange(len(a)), [len(x) for x in a["parts"]])
            at = np.minimum(np.searchsorted(parts, wanted), len(parts) - 1)
            allowed = np.zeros((len(a), len(parts)), bool)
            allowed[asking[parts[at] == wanted], at[parts[at] == wanted]] = True
        row, column, distance = _closest(_matrix(a[vector]), _matrix(b[vector]), k, allowed, place)
        return pd.DataFrame({query_id: a[query_id].to_numpy()[row], train_id: b[train_id].to_numpy()[column], "distance": distance})

    local = left.select(*keys, query_id, vector, *own).groupBy(*keys).cogroup(right.select(*keys, train_id, vector, *part).groupBy(*keys)).applyInPandas(compare, schema)
    final = Window.partitionBy(query_id).orderBy("distance", train_id)
    return local.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame, query_id: str, train_id: str, label: str, weights: str = "distance") -> DataFrame:
    """Weighted class vote; with distance weights, neighbours at distance zero win outright."""
    joined = neighbours.join(labels.select(train_id, label), train_id)
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(query_id)) == 1
    inverse = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    weighted = joined.withColumn("_w", inverse if weights == "distance" else F.lit(1.0))
    per_class = weighted.groupBy(query_id, label).agg(F.sum("_w").alias("_w"))
    best = F.max_by(F.struct(label, "_w"), F.struct("_w", (-F.col(label)).alias("low")))
    out = per_class.groupBy(query_id).agg(best.alias("_b"), F.sum("_w").alias("_t"))
    return out.select(query_id, F.col(f"_b.{label}").alias("prediction"), (F.col("_b._w") / F.col("_t")).alias("score"))
