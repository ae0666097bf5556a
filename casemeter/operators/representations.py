"""What each model family reads of a text, fitted on training rows only.

One object holds the fitted parts; a family names a representation and gets a frame with the sparse columns ``indices`` and ``values``
or the dense column ``vector``. Parts are fitted when first asked for, so a family pays for what it reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed, small_table
from . import sparse_text as st, svd, text_features as tf

#: Representation of each family.
FAMILIES = {
    "logistic_regression": "linear", "linear_svm": "linear", "naive_bayes": "word", "decision_tree": "tree", "random_forest": "tree", "randomised_forest": "tree",
    "rbf_svm": "dense", "gradient_boosting": "dense", "nearest_neighbours": "knn",
}


def sparse_entries(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per entry: ``term`` (the index) and ``weight``."""
    return rows.select(*keep, F.explode(F.arrays_zip("indices", "values")).alias("e")).select(*keep, F.col("e.indices").alias("term"), F.col("e.values").alias("weight"))


def _selected(places: np.ndarray, keep: list[str]):
    """Entries at ``places`` (sorted), renumbered in that order."""

    def run(batches):
        for batch in batches:
            lists, values = batch.column("indices"), batch.column("values")
            row, index = np.asarray(pa.compute.list_parent_indices(lists)), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(places, index), max(len(places) - 1, 0))
            hit = places[at] == index if len(places) else np.zeros(len(index), bool)
            bounds = pa.array(np.searchsorted(row[hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            out = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at[hit].astype(np.int32), values.flatten().to_numpy()[hit])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=[*keep, "indices", "values"])

    return run


def take_features(rows: DataFrame, places: np.ndarray, keep: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "indices", "values").mapInArrow(_selected(np.sort(places), list(keep)), f"{schema}, indices array<int>, values array<double>")


class TextRepresentations:
    """Representations of the column ``text``, fitted on ``train`` (with ``doc_id`` and ``label`` columns)."""

    def __init__(self, train: DataFrame, doc_id: str, text: str, label: str, words: int = 12_000, chars: int = 12_000, selected: int = 500, rank: int = 64, seed: int = 0):
        self.train, self.doc_id, self.text, self.label = train, doc_id, text, label
        self.words, self.chars, self.selected, self.rank, self.seed = words, chars, selected, rank, seed

    @cached_property
    def word_block(self):
        terms = st.word_terms(F.col(self.text))
        return terms, st.fit_vocabulary(self.train, terms, self.words)

    @cached_property
    def char_block(self):
        terms = st.char_terms(F.col(self.text))
        return terms, st.fit_vocabulary(self.train, terms, self.chars)

    def _words(self, docs: DataFrame, keep: Sequence[str]) -> DataFrame:
        return st.encode(docs, [self.word_block], keep)

    @cached_property
    def _train_words(self) -> DataFrame:
        return checkpointed(self._words(self.train, [self.doc_id, self.label]))

    @cached_property
    def chosen(self) -> np.ndarray:
        """The terms of the largest chi-square, ties by term."""
        scores = tf.chi_square(sparse_entries(self._train_words, self.doc_id), self._train_words, self.doc_id, self.label)
        top = scores.orderBy(F.round("chi2", 9).desc(), "term").limit(self.selected)
        return np.array([r["term"] for r in small_table(top.select("term"), self.selected).collect()], np.int64)

    @cached_property
    def factors(self) -> svd.Factors:
        return svd.fit(self._train_words, len(self.word_block[1]), self.rank, seed=self.seed)

    @cached_property
    def centres(self) -> DataFrame:
        return svd.centre(svd.project(self._train_words, self.factors.components), "svd", len(self.factors.values))

    def width(self, representation: str) -> int:
        word = len(self.word_block[1])
        if representation == "linear":
            return word + len(self.char_block[1])
        return {"word": lambda: word, "tree": lambda: len(self.chosen)}.get(representation, lambda: len(self.factors.values))()

    def transform(self, docs: DataFrame, representation: str, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns and the representation of each row of ``docs``."""
        if representation == "linear":
            return st.encode(docs, [self.word_block, self.char_block], keep)
        if representation == "word":
            return st.encode(docs, [self.word_block], keep, counts=True)
        rows = self._words(docs, keep)
        if representation == "tree":
            return take_features(rows, self.chosen, keep)
        dense = svd.project(rows, self.factors.components).drop("indices", "values")
        if representation == "dense":
            return svd.scale(dense, "svd", self.centres, "vector").drop("svd")
        if representation == "knn":
            norm = F.sqrt(F.aggregate("svd", F.lit(0.0), lambda a, x: a + x * x))
            return dense.withColumn("_n", norm).withColumn("vector", F.transform("svd", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))).drop("svd", "_n")
        raise ValueError(f"unknown representation {representation!r}")

    def for_family(self, docs: DataFrame, family: str, keep: Sequence[str]) -> DataFrame:
        return self.transform(docs, FAMILIES[family], keep)
