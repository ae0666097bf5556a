"""Substring dedup by fixed-block anchors.

Non-overlapping blocks of every document, half a window long, form the index; any window holds one whole block of its own document, so
probing with every rolling run of that length finds each repeat. Hits are extended to maximal repeats in ``repeats``.

There is a probe for nearly every word, so probes travel packed: 50 bits of a run's hash, of which the first name the group where it meets its equals, and the
document's place within a stretch of 65,536. That is 7 bytes a probe. Runs that agree in those bits alone cost a look at some windows and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casemeter.llm import repeats
from casemeter.llm.common import slices
from casemeter.llm.words import U, split, windows

#: Bits that name a probe's group, bits of its hash that travel in the group, and bits of a document's place in its stretch.
GROUP, REST, STRETCH = 11, 39, 16
#: Probes that are packed together.
PACK = 1 << 20


def _runs(block: int, words: np.ndarray) -> np.ndarray:
    """The bits by which the rolling runs are known, with the lowest bit free."""
    return windows(words, block) >> U(64 - GROUP - REST) << U(1)


def _probes(block: int, words: np.ndarray) -> np.ndarray:
    """Distinct rolling runs; the lowest bit tells whether one of them is a block of the index."""
    runs = _runs(block, words)
    return np.concatenate((np.unique(runs[::block]) | U(1), np.setdiff1d(runs, runs[::block])))


def _packed(block: int):
    """Rows (part, base, at, runs) of the probes of many documents: one for each group and stretch of places."""

    def pack(probes: list[np.ndarray], places: list[int]) -> Iterator[pa.RecordBatch]:
        runs, place = np.concatenate(probes), np.repeat(np.array(places, np.int64), [len(x) for x in probes])
        part, base = (runs >> U(REST + 1)).astype(np.int64), place >> STRETCH
        order = np.lexsort((part, base))
        runs, place, part, base = runs[order], place[order], part[order], base[order]
        rest = (runs & U((1 << REST + 1) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (REST + 1) // 8]
        at = (place & (1 << STRETCH) - 1).astype(np.uint16)
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(base) != 0)) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(runs)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[first], pa.int32()), pa.array(base[first]), pa.array([at[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
             pa.array([rest[a:b].tobytes() for a, b in zip(first, last)], pa.binary())],
            names=["part", "base", "at", "runs"],
        )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, places, n = [], [], 0
        for batch in batches:
            for piece in slices([batch], "text"):
                words = split(piece.column("text"))
                for place, first, last in zip(piece.column("doc").to_pylist(), words.bounds[:-1], words.bounds[1:]):
                    probes.append(_probes(block, words.hashes[first:last]))
                    places.append(place)
                    n += len(probes[-1])
                if n >= PACK:
                    yield from pack(probes, places)
                    probes, places, n = [], [], 0
        if n:
            yield from pack(probes, places)

    return go


def _live(group: pa.Table) -> pa.Table:
    """(hash, doc) of the runs of one group that several documents have, one of them as a block."""
    runs = np.frombuffer(b"".join(group.column("runs").to_pylist()), np.uint8).reshape(-1, (REST + 1) // 8)
    wide = np.zeros((len(runs), 8), np.uint8)
    wide[:, : runs.shape[1]] = runs
    known = wide.view("<u8").ravel()
    at = group.column("at").to_pylist()
    place = np.repeat(group.column("base").to_numpy() << STRETCH, [len(x) // 2 for x in at]) + np.frombuffer(b"".join(at), np.uint16)
    order = np.argsort(known)
    known, place = known[order], place[order]
    run = known >> U(1)
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.concatenate((first, [len(run)])))
    live = np.repeat((sizes > 1) & (np.maximum.reduceat(known & U(1), first) > 0), sizes)
    part = U(group.column("part")[0].as_py())
    return pa.table({"hash": pa.array((run[live] | part << U(REST)).view(np.int64)), "doc": pa.array(place[live])})


def _reach(block: int, size: int, words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Distinct hashes of the windows that hold a hit."""
    runs, whole = _runs(block, words) >> U(1), windows(words, size)
    hit = np.concatenate(([0], np.cumsum(np.isin(runs, hits))))
    at = np.arange(len(whole))
    return np.unique(whole[hit[at + size - block + 1] > hit[at]])


def _propose(block: int, long: DataFrame) -> DataFrame:
    packed = long.mapInArrow(_packed(block), "part int, base long, at binary, runs binary")
    return packed.groupBy("part").applyInArrow(_live, "hash long, doc long")


def deduplicate(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``repeats.remove``: words covered by a window of ``size`` words that also starts earlier are removed."""
    block = size // 2
    return repeats.remove(docs, size, partial(_propose, block), block, partial(_reach, block, size), id_col, text_col)
