"""Suffix-array dedup on sparse suffixes.

Only suffixes that start at a minimiser (the smallest run hash among ``PICK`` neighbouring runs of ``RUN`` words) are retained. A repeat of ``size`` words
contains a minimiser within its first words, chosen by content and so the same in both places, from which at least ``size - PICK - RUN + 1``
words are common. Suffixes are sorted by the hash of that many words and compared with their neighbours; equal
neighbours are extended left and right on the texts in ``repeats``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from casemeter.llm import repeats
from casemeter.llm.words import windows

RUN, PICK = 4, 12


def minimisers(words: np.ndarray) -> np.ndarray:
    """Places of the smallest of every ``PICK`` neighbouring runs, the first one on ties."""
    grams = windows(words, RUN)
    if len(grams) < PICK:
        return np.zeros(0, np.int64)
    rolling = np.lib.stride_tricks.sliding_window_view(grams, PICK)
    return np.unique(rolling.argmin(1) + np.arange(len(rolling)))


def _suffixes(common: int, words: np.ndarray, _) -> np.ndarray:
    keys, at = windows(words, common), minimisers(words)
    return np.unique(keys[at[at < len(keys)]])


def _reach(common: int, size: int, words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Distinct hashes of the windows that hold the common part of a retained suffix that has an equal neighbour."""
    keys, whole = windows(words, common), windows(words, size)
    hit = np.concatenate(([0], np.cumsum(np.isin(keys, hits))))
    at = np.arange(len(whole))
    return np.unique(whole[hit[at + size - common + 1] > hit[at]])


def _propose(common: int, long: DataFrame) -> DataFrame:
    suffixes = long.mapInArrow(repeats._per_document(partial(_suffixes, common)), "hash long, doc long")
    order = Window.partitionBy("hash").orderBy("doc")
    near = suffixes.select("hash", "doc", F.lag("doc").over(order).alias("before"), F.lead("doc").over(order).alias("after"))
    return near.where("before is not null or after is not null").select("hash", "doc")


def deduplicate(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``repeats.remove``, for repeats of at least ``size`` words (more than ``RUN + PICK``)."""
    common = size - PICK - RUN + 1
    return repeats.remove(docs, size, partial(_propose, common), common, partial(_reach, common, size), id_col, text_col)
