"""Ranked lexical search over a frequent-pattern tree of documents, by branch and bound.

Documents are reduced to the terms of the items: (term, tf) in the order of falling document frequency, written once. Each task puts its
documents into tries in which vectors share the paths of their first terms. A node knows the largest tf of each term below it and the
smallest length factor m; a score rises with tf and falls with m, so both bound every score below. For each item the trie is searched depth
first, best bounds first; a branch is cut when its bound does not reach the item's last place. Runs of at most ``LEAF`` documents at the end
of a path are scored exactly. The last places stay while a task goes through its tries; its best of each item then meet those of other tasks.

Weights and scores are integers, div rounds down. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casemeter.llm.common import one_array, slices, written
from casemeter.llm.words import PUNCTUATION, split

#: Documents that are scored one by one at the end of a path; those of one trie; bytes of a trie's largest tf by node and term.
LEAF = 64
TRIE = 1 << 14
_TRIE_BYTES = 48 << 20
#: Bytes of item texts in one block; each block is searched by itself.
ITEM_BYTES = 1 << 20
_UNIT = 1_000_000_000


def _restricted(vocabulary: np.ndarray):
    """doc_id, n, and the number and tf of each term of ``vocabulary`` (sorted hashes) in every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split(batch.column("text"), PUNCTUATION, fold=True)
            place = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
            known = vocabulary[place] == words.hashes
            doc = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))[known]
            pair, tf = np.unique(doc * len(vocabulary) + place[known], return_counts=True)
            at = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(vocabulary)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pair % len(vocabulary), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.bounds)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Trie:
    """Documents sorted by their paths, and the nodes above runs of them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, bounds: np.ndarray, size: int):
        """``terms`` are ranks, rising within each document; document k has those from ``bounds[k]`` to ``bounds[k + 1]``."""
        length = np.diff(bounds)
        big = terms.astype(">u4").tobytes()
        paths = [big[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        order = np.array(sorted(range(len(ids)), key=lambda k: (paths[k], m[k], ids[k])))
        place = np.repeat(bounds[order], length[order]) + np.arange(len(terms)) - np.repeat(np.cumsum(length[order]) - length[order], length[order])
        self.ids, self.m, self.terms, self.tfs = ids[order], m[order], terms[place], tfs[place]
        self.bounds = np.concatenate([[0], np.cumsum(length[order])])
        self.gain = (_UNIT * self.tfs) // (1000 * self.tfs + 20 * np.repeat(self.m, length[order]))
        self.children: list[list[int]] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self._grow(self._shared())
        self.most = np.zeros((len(self.low), size), np.int32)
        self.least = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high)])
        self.first = np.array([self.ids[a:b].min() for a, b in zip(self.low, self.high)])
        for node in reversed(range(len(self.low))):
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max(0)
            else:
                a, b = self.bounds[self.low[node]], self.bounds[self.high[node]]
                by = np.lexsort((self.tfs[a:b], self.terms[a:b]))
                self.most[node, self.terms[a:b][by]] = self.tfs[a:b][by]  # of equal places the last, largest one stays

    def _shared(self) -> np.ndarray:
        """How many first terms each document shares with the next."""
        shared = np.zeros(max(len(self.ids) - 1, 0), np.int64)
        length = np.diff(self.bounds)
        alive, depth = np.arange(len(shared)), 0
        while len(alive):
            alive = alive[np.minimum(length[alive], length[alive + 1]) > depth]
            alive = alive[self.terms[self.bounds[alive] + depth] == self.terms[self.bounds[alive + 1] + depth]]
            shared[alive] += 1
            depth += 1
        return shared

    def _add(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _grow(self, shared: np.ndarray) -> None:
        """Nodes from the root down. Branches of under ``LEAF`` documents that stand side by side make one leaf; equal vectors are cut by number."""
        open_ = [self._add(0, len(self.ids))]
        while open_:
            node = open_.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            inner = shared[low : high - 1]
            cuts = np.flatnonzero(inner == inner.min()) + low + 1
            if len(cuts) == high - low - 1:  # no two documents share more
                cuts = np.arange(low + LEAF, high, LEAF)
            edges = [low, *cuts.tolist(), high]
            start = low
            for left, right in zip(edges, edges[1:]):
                if right - start > LEAF and left > start:
                    open_.append(self._add(start, left))
                    self.children[node].append(open_[-1])
                    start = left
            open_.append(self._add(start, high))
            self.children[node].append(open_[-1])

    def search(self, terms: np.ndarray, weights: np.ndarray, by_term: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Better (scores, ids) than ``best`` with this trie's documents, best first, and the number of documents scored."""
        tf = self.most[:, terms].astype(np.int64)
        bound = (weights * ((_UNIT * tf) // (1000 * tf + 20 * self.least[:, None]))).sum(1)
        scores, ids = best
        stack, scored = [0], 0
        while stack:
            node = stack.pop()
            last = (-1, 0) if len(scores) < top else (int(scores[-1]), -int(ids[-1]))
            if bound[node] <= 0 or (int(bound[node]), -int(self.first[node])) <= last:
                continue
            if self.children[node]:
                children = np.array(self.children[node])
                stack += children[np.argsort(bound[children], kind="stable")].tolist()
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.bounds[low], self.bounds[high]
            got = np.add.reduceat(by_term[self.terms[a:b]] * self.gain[a:b], self.bounds[low:high] - a)
            scored += high - low
            some = np.flatnonzero((got > 0) & (got >= last[0]))
            if len(some):
                scores, ids = np.concatenate([scores, got[some]]), np.concatenate([ids, self.ids[low:high][some]])
                order = np.lexsort((ids, -scores))[:top]
                scores, ids = scores[order], ids[order]
        return scores, ids, scored


def _searched(items: list[tuple[int, np.ndarray, np.ndarray]], rank: np.ndarray, documents: int, words: int, top: int):
    """The best documents of each item (number, term ranks, weights) among the rows of a task; one more row counts the work."""
    size = len(rank)
    most = max(2 * LEAF, min(TRIE, _TRIE_BYTES * LEAF // (8 * size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        scored = seen = 0
        by_term = np.zeros(size, np.int64)

        def search(rows: pa.Table) -> None:
            nonlocal scored, seen
            rows = rows.combine_chunks()
            terms, tfs = one_array(rows.column("terms")), one_array(rows.column("tfs"))
            bounds = terms.offsets.to_numpy().astype(np.int64)
            flat = rank[terms.values.to_numpy()[bounds[0] : bounds[-1]]]
            tf = tfs.values.to_numpy()[tfs.offsets[0].as_py() : tfs.offsets[len(tfs)].as_py()].astype(np.int64)
            bounds = bounds - bounds[0]
            by = np.lexsort((flat, np.repeat(np.arange(len(rows)), np.diff(bounds))))
            m = 50 + (50 * rows.column("n").to_numpy() * documents) // words
            trie = Trie(rows.column("doc_id").to_numpy(), m, flat[by], tf[by], bounds, size)
            seen += len(rows)
            for k, (_, own, weights) in enumerate(items):
                by_term[own] = weights
                *best[k], count = trie.search(own, weights, by_term, best[k], top)
                by_term[own] = 0
                scored += count

        wait: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                wait.append(batch.slice(start, most))
                if sum(b.num_rows for b in wait) >= most:
                    search(pa.Table.from_batches(wait))
                    wait = []
        if wait:
            search(pa.Table.from_batches(wait))
        for (item, _, _), (scores, ids) in zip(items, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([scored]), pa.array([seen * len(items)])], names=["item", "doc_id", "score"])

    return run


_NO_ID = np.iinfo(np.int64).max


def _block(docs: DataFrame, items: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """item, doc_id, score of the best documents for a block of items that the driver may hold, and the work done by task."""
    local = items.toPandas()
    words = split(pa.array(local["text"].tolist(), pa.string()), PUNCTUATION, fold=True)
    own = [np.unique(words.hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    vocabulary = np.unique(words.hashes)
    if not len(vocabulary):
        none = docs.limit(0).select(F.lit(0).cast("long").alias("item"), "doc_id", F.lit(0).cast("long").alias("score"))
        return none, none
    vectors = written(docs.mapInArrow(_restricted(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"))
    documents, total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts["term"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    plan = []
    for number, terms in zip(local["item"].tolist(), own):
        place = np.searchsorted(vocabulary, terms)
        plan.append((number, rank[place], weight[place]))
    found = written(vectors.where(F.size("terms") > 0).mapInArrow(_searched(plan, rank, documents, max(total, 1), top), "item long, doc_id long, score long"))
    return found.where("item >= 0"), found.where("item < 0")


def search(docs: DataFrame, items: DataFrame, top: int = 50, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, equal scores by rising id.

    Null texts have no terms; an item without terms, and any item where no document shares one, has no rows. Items are rows: one that is
    there twice is answered twice. Documents that repeat an id rank by themselves. Rows without an id come after all others of their score.
    Items go to the tasks in blocks of about ``item_bytes`` of text, however many there are. Empty tables give no rows; other columns are
    not read.
    """
    rows = docs.select(F.coalesce(F.col(doc_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()))
    blocks = 1 + (asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // item_bytes
    found = [_block(rows, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "text"), top)[0] for k in range(blocks)]
    best = reduce(DataFrame.union, found)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = asked.select("item", "item_id")
    return best.join(ids, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")


def work(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """scored, pairs: documents scored for some item, and all pairs of an item and a document with one of the terms."""
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _block(rows, asked, top)[1].agg(F.sum("doc_id").alias("scored"), F.sum("score").alias("pairs"))
