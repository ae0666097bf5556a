"""Exact repeats of word windows: what both substring methods share.

A method proposes, for each document, hashes of short word runs that also occur elsewhere. Here the hits are extended on the
texts: every window of ``size`` words around a hit is looked up, the first document with it is found, and the words that a window
with an earlier start covers are taken out. Maximal repeats are unions of such windows. A document of many words stays in one row; hashes are keyed by
value, at most one for each document and value, so a passage shared by all documents makes as many rows as documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casemeter.llm.common import slices, written
from casemeter.llm.words import U, split, windows, within

#: Stands for a null id: later than every other.
LAST = 2**63 - 1
Propose = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words joined by one space, their number and the digest of the sequence."""
    for batch in slices(batches, "text"):
        words = split(batch.column("text"))
        joined = []
        data = words.data.tobytes()
        for first, last in zip(words.bounds[:-1], words.bounds[1:]):
            joined.append(b" ".join(data[a:b] for a, b in zip(words.starts[first:last].tolist(), words.ends[first:last].tolist())))
        keys = [hashlib.sha256(j).digest() for j in joined]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(words.bounds), pa.int64()), pa.array(keys, pa.binary()), pa.array([j.decode() for j in joined], pa.string())],
            names=["row", "doc_id", "n_words", "key", "text"],
        )


def _per_document(run: Callable[[np.ndarray, np.ndarray], np.ndarray], hashes_of: str | None = None):
    """Rows (hash, doc) of what ``run(word hashes, listed hashes)`` returns for each document."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split(batch.column("text"))
            listed = batch.column(hashes_of) if hashes_of else None
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            out, owner = [], []
            for k, (first, last) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                have = run(words.hashes[first:last], np.asarray(listed[k].values.to_numpy(zero_copy_only=False)).view(U) if listed else None)
                out.append(have)
                owner.append(np.full(len(have), docs[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner).astype(np.int64))], names=["hash", "doc"])

    return go


def _covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words that a flagged window covers."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:n]) > 0


def _clean(size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split(batch.column("text"))
            data, listed, out = words.data.tobytes(), batch.column("hashes"), []
            for k, (first, last) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                n, grams = int(last - first), windows(words.hashes[first:last], size)
                flags = np.zeros(len(grams), bool)
                if len(grams):
                    flags[:] = True
                    flags[np.unique(grams, return_index=True)[1]] = False
                    if listed[k].is_valid:
                        flags |= np.isin(grams, listed[k].values.to_numpy(zero_copy_only=False).view(U))
                gone = _covered(flags, size, n)
                keep = np.flatnonzero(~gone) + first
                text = b" ".join(data[a:b] for a, b in zip(words.starts[keep].tolist(), words.ends[keep].tolist()))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans = ",".join(f"{a}:{b}" for a, b in edges.reshape(-1, 2).tolist())
                out.append((int(gone.sum()), hashlib.sha256(text).hexdigest(), spans))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["key", "n_removed", "kept_sha256", "spans"],
            )

    return go


def remove(docs: DataFrame, size: int, propose: Callable[[DataFrame], DataFrame], run: int, reach: Callable[[np.ndarray, np.ndarray], np.ndarray],
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed words, start:end): one row per row of ``docs``.

    ``propose`` takes the distinct texts (doc, text), where doc is the text's place in their table, and returns (hash, doc) of runs that occur in several; ``reach``
    takes the window hashes' word hashes and the proposed hashes and returns which windows to look up. Each step is a written table, so that
    the shuffles of one step at a time lie on disk. Documents whose word sequences are equal count
    once: of them the one with the smallest id stays, one row where ids repeat, and the others lose every word a window covers. Rows of different texts with
    one id are not earlier than each other; null ids are later than all. Null, empty and short texts lose nothing.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(rows.mapInArrow(_texts, "row long, doc_id long, n_words long, key binary, text string"))
    first = rows.groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "row")).alias("f")).select("key", F.col("f.doc").alias("doc"), F.col("f.row").alias("row"))
    first = written(first)
    texts = rows.select("row", "key", "text").join(first.select("row", "doc"), "row").select("key", "doc", "text")
    texts = written(texts.withColumn("place", F.monotonically_increasing_id()))
    long = texts.where(F.size(F.split("text", " ", size)) >= size)
    hits = written(propose(long.select(F.col("place").alias("doc"), "text")).groupBy(F.col("doc").alias("place")).agg(F.collect_list("hash").alias("hashes")))
    near = long.join(hits, "place").select("doc", "text", "hashes").mapInArrow(_per_document(reach, "hashes"), "hash long, doc long").repartition("hash")
    known = near.groupBy("hash").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last")
    later = written(near.join(known.hint("shuffle_hash"), "hash").where("doc > lead").groupBy("doc").agg(F.collect_list("hash").alias("hashes")))
    cleaned = written(texts.join(later, "doc", "left").select("key", "text", "hashes").mapInArrow(_clean(size), "key binary, n_removed long, kept_sha256 string, spans string"))
    facts = cleaned.join(first.select("key", F.col("row").alias("lead")), "key")
    copy = F.col("row") != F.col("lead")
    whole = copy & (F.col("n_words") >= size)
    return rows.select("row", "doc_id", "n_words", "key").join(facts, "key").select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.concat(F.lit("0:"), F.col("n_words"))).otherwise(F.col("spans")).alias("spans"),
    )
