"""Nearest neighbours by an inverted file: coarse cells, kept as a table bucketed by cell, some of which a query probes.

Centres come from a few rounds of k-means on a bounded sample of the training rows; every row is in the file. A query is compared exactly, in blocks of
bounded size, with the rows of the ``probes`` cells whose centres are nearest. With as many probes as cells the result is exact; with fewer, :func:`recall`
says what is lost. The exact join of ``neighbours`` has no such choice, but in many dimensions its bounds prune little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.keys import draw
from ..session import shared_folder
from .neighbours import BLOCK_ROWS, _matrix, compare_cells, nearest

#: Most cells of a file, and rows that its centres are fitted on.
MAX_CELLS, SAMPLE = 4096, 65_536
_ROUNDS = 8


def centres_of(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from rows of the sample; a centre that loses its rows stays where it was."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    for _ in range(_ROUNDS):
        own = _nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The nearest centres of each row, nearest first, ties by place; in slices of bounded memory."""
    out = []
    step = max(1, 4_000_000 // max(1, len(centres)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = (part * part).sum(1)[:, None] - 2 * part @ centres.T + (centres * centres).sum(1)
        out.append(np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :count])
    return np.concatenate(out) if out else np.zeros((0, count), np.int64)


class InvertedFile:
    """A file of the rows of ``train``: its centres, sizes of cells, and a table (cell, id, vector) bucketed and sorted by cell."""

    def __init__(self, train: DataFrame, train_id: str, vector: str, cells: int | None = None, seed: int = 0, buckets: int | None = None):
        spark = self.spark = train.sparkSession
        self.train_id, self.vector = train_id, vector
        train = train.where(F.col(vector).isNotNull()).select(train_id, F.col(vector).cast("array<double>").alias(vector))
        total = train.count()
        sample = train.orderBy(draw(seed, train_id), train_id).limit(SAMPLE).select(vector).toPandas()
        self.centres = centres_of(_matrix(sample[vector]), min(MAX_CELLS, max(1, int(total**0.5) if cells is None else cells)), seed) if total else np.zeros((0, 0))
        folder = f"{shared_folder(spark)}/cells"
        self.name = f"inverted_file_{hashlib.md5(folder.encode()).hexdigest()}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._placed(train, 1).withColumn("cell", F.col("cells")[0]).drop("cells").write.bucketBy(buckets, "cell").sortBy("cell").option("path", folder).saveAsTable(self.name)
        self.sizes = {r["cell"]: r["n"] for r in self.table().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _placed(self, rows: DataFrame, count: int) -> DataFrame:
        centres, vector = self.centres, self.vector

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(cells=[c.astype(np.int32).tolist() for c in _nearest(_matrix(batch[vector]), centres, count)])

        return rows.mapInPandas(place, StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))]))

    def search(self, queries: DataFrame, query_id: str, k: int, probes: int) -> DataFrame:
        """``query_id, train_id, distance, rank``: up to ``k`` neighbours from the nearest ``probes`` cells that hold rows. Queries without a vector have none."""
        rows = queries.where(F.col(self.vector).isNotNull()).select(query_id, F.col(self.vector).cast("array<double>").alias(self.vector))
        bins = self._bins()
        count = min(probes, max(1, len(self.centres)))
        zipped = F.explode(F.arrays_zip("bins", "parts")).alias("_v")
        sent = self._sent(rows, count, bins).select(query_id, self.vector, zipped).select(query_id, self.vector, F.col("_v.bins").alias("cell"), F.col("_v.parts").alias("parts"))
        asked = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        held: dict[int, int] = {}
        for c, n in self.sizes.items():
            held[bins[c]] = held.get(bins[c], 0) + n
        sizes = [(b, -(-n // BLOCK_ROWS), -(-asked.get(b, 1) // BLOCK_ROWS)) for b, n in held.items()]
        places = F.broadcast(self.spark.createDataFrame([(int(c), b) for c, b in bins.items()], "part int, cell int"))
        return compare_cells(sent, self.table().withColumnRenamed("cell", "part").join(places, "part"), sizes, query_id, self.train_id, self.vector, k)

    def _bins(self) -> dict[int, int]:
        """Cells that hold rows are compared together in bins of about a block of rows: the bin of each."""
        out, bin_, rows = {}, 0, 0
        for c in sorted(self.sizes):
            if rows and rows + self.sizes[c] > BLOCK_ROWS:
                bin_, rows = bin_ + 1, 0
            out[c], rows = bin_, rows + self.sizes[c]
        return out

    def _sent(self, rows: DataFrame, count: int, bins: dict[int, int]) -> DataFrame:
        """``rows`` with the bins that hold their nearest ``count`` cells, and the cells in each."""
        centres, vector = self.centres, self.vector
        bin_of = np.full(len(centres), -1, np.int64)
        bin_of[list(bins)] = list(bins.values())

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    found = []
                    for cells in np.sort(_nearest(_matrix(batch[vector]), centres, count), axis=1):
                        cells = cells[bin_of[cells] >= 0].astype(np.int32)
                        own, first = np.unique(bin_of[cells], return_index=True)
                        found.append((own.astype(np.int32).tolist(), [x.tolist() for x in np.split(cells, first[1:])] if len(cells) else []))
                    yield batch.assign(bins=[f[0] for f in found], parts=[f[1] for f in found])

        whole = ArrayType(IntegerType())
        return rows.mapInPandas(send, StructType([*rows.schema.fields, StructField("bins", whole), StructField("parts", ArrayType(whole))]))

    def drop(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def recall(file: InvertedFile, queries: DataFrame, query_id: str, train: DataFrame, k: int, probes: int) -> DataFrame:
    """One row ``neighbours, found``: exact neighbours of the queries, and how many of them the probed cells gave."""
    exact = nearest(queries, train, query_id, file.train_id, file.vector, k).select(query_id, file.train_id)
    got = file.search(queries, query_id, k, probes).select(query_id, file.train_id, F.lit(1).alias("_hit"))
    return exact.join(got, [query_id, file.train_id], "left").agg(F.count(F.lit(1)).alias("neighbours"), F.count("_hit").alias("found"))
