"""Sparse term vectors of texts: a bounded vocabulary in one pass, and blocks of weighted terms side by side.

Compiled expressions cut a text into tokens, which go to Python one a row, so that a batch is small however long the texts are. A task takes
whole texts of about ``_TOKENS`` tokens at a time and makes their terms from the distinct tokens, or pairs of them, there. What leaves it is
one row per distinct term, or the finished vector of a document. No (document, term) pair is shuffled. A vector is two
arrays, ``indices`` (rising) and ``values``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import word_tokens
from .text_features import GRAM_LENGTHS, words

#: Most terms of one vocabulary; it travels to every task.
MAX_TERMS = 200_000
#: Tokens, and bytes of them, that a task works on at a time; a longer text stands alone.
_TOKENS, _BYTES = 1 << 17, 2 << 20


@dataclass(frozen=True)
class Terms:
    """An array column of tokens, and the terms made of them: ``pairs`` (each token, and neighbours joined by a space) or ``grams`` (of each token)."""

    tokens: Column
    shape: str


def word_terms(text: Column) -> Terms:
    """Lower-case words of two or more characters, and pairs of neighbours."""
    return Terms(word_tokens(text), "pairs")


def char_terms(text: Column) -> Terms:
    """Character n-grams inside words padded with a space on each side."""
    return Terms(words(text), "grams")


@dataclass(frozen=True)
class Vocabulary:
    """Terms in alphabetical order with their counts over the texts they were fitted on."""

    terms: pa.Array
    frequency: np.ndarray
    documents: np.ndarray
    rows: int

    @property
    def idf(self) -> np.ndarray:
        return np.log((1 + self.rows) / (1.0 + self.documents)) + 1

    def __len__(self) -> int:
        return len(self.terms)

    def frame(self, spark: SparkSession) -> DataFrame:
        table = pa.table({"term": self.terms, "position": pa.array(np.arange(len(self), dtype=np.int32)), "frequency": self.frequency, "documents": self.documents, "idf": self.idf})
        return spark.createDataFrame(table)


def _tokens(docs: DataFrame, terms: Sequence[Terms | Column], keep: Sequence[str]) -> DataFrame:
    """A row per token, texts in turn: ``_first`` of its text, the ``keep`` columns there, the block and the token. A text without tokens has one row, without a token."""
    none, names = F.array().cast("array<string>"), [f"_t{k}" for k in range(len(terms))]
    lists = docs.select(*keep, *[F.coalesce(t.tokens if isinstance(t, Terms) else t, none).alias(c) for c, t in zip(names, terms)])
    rows = lists.select(*keep, *[F.size(c).alias(f"_n{c}") for c in names], F.posexplode_outer(F.concat(*names)).alias("_at", "_token"))
    first, block, end = F.coalesce(F.col("_at") == 0, F.lit(True)), F.lit(0), F.lit(0)
    for c in names[:-1]:
        end = end + F.col(f"_n{c}")
        block = block + (F.col("_at") >= end).cast("int")
    return rows.select(first.alias("_first"), *[F.when(first, F.col(c)).alias(c) for c in keep], F.coalesce(block, F.lit(0)).alias("_block"), "_token")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``_tokens`` in runs of whole texts."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    most = 1
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < most * _TOKENS and size < most * _BYTES:
            continue
        run = pa.Table.from_batches(held)
        last = int(np.flatnonzero(run["_first"].to_numpy())[-1])
        if last:
            yield run.slice(0, last).combine_chunks()
        most = 1 if last else 2 * most
        held = run.slice(last).combine_chunks().to_batches()
        rows, size = run.num_rows - last, sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _grams(names: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the n-grams of each padded word, one word behind the other, their bounds, and the distinct n-grams."""
    longest, texts = max(GRAM_LENGTHS), names.to_pylist()
    points = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le"), np.uint32)
    letters, code = np.unique(points, return_inverse=True)
    base = len(letters)
    if not texts or letters[0] == 0 or len(GRAM_LENGTHS) * base**longest >= 1 << 62:
        # Too many letters for one number, or one that ends a NumPy string.
        cut = [[p[i : i + n] for n in GRAM_LENGTHS for i in range(len(p) - n + 1)] for p in (f" {w} " for w in texts)]
        flat = pa.array([g for some in cut for g in some], pa.string()).dictionary_encode()
        return flat.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum([len(some) for some in cut])]).astype(np.int64), flat.dictionary
    size = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(size + 1) + 1  # a space stands between two words once
    word = np.repeat(np.arange(len(size)), size + 1)
    value, owners, keys = np.zeros(len(word), np.int64), [], []
    for n in range(1, longest + 1):
        at = np.flatnonzero(np.arange(len(word)) + n <= ends[word])
        value[at] = value[at] * base + code[at + n - 1]
        if n in GRAM_LENGTHS:
            owners.append(word[at]), keys.append(value[at] * len(GRAM_LENGTHS) + GRAM_LENGTHS.index(n))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    distinct, gram = np.unique(key, return_inverse=True)
    value, length = distinct // len(GRAM_LENGTHS), np.array(GRAM_LENGTHS)[distinct % len(GRAM_LENGTHS)]
    shown = np.empty(len(distinct), object)
    for n in GRAM_LENGTHS:
        some = np.flatnonzero(length == n)
        cells = np.stack([letters[value[some] // base ** (n - 1 - j) % base] for j in range(n)], axis=1).astype(np.uint32)
        shown[some] = np.ascontiguousarray(cells).view(f"<U{n}").ravel().tolist()
    return gram[order], np.searchsorted(owner[order], np.arange(len(size) + 1)), pa.array(shown.tolist(), pa.string())


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64)


def _counts(row: np.ndarray, tokens: pa.Array, shape: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term and number of each term of each row, by row and term, and the distinct terms, from the row of each token."""
    coded = tokens.dictionary_encode()
    token, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if shape == "pairs":
        near = np.flatnonzero(row[1:] == row[:-1])
        pair, at = np.unique(token[near] * len(names) + token[near + 1], return_inverse=True)
        row, token = np.concatenate([row, row[near]]), np.concatenate([token, at + len(names)])
        left, right = (names.take(pa.array(x)) for x in (pair // max(len(names), 1), pair % max(len(names), 1)))
        names = pa.concat_arrays([names, pc.binary_join_element_wise(left, right, " ")])
    width = max(len(names), 1)
    key, n = _summed(row * width + token, np.ones(len(row), np.int64))
    if shape == "grams":
        gram, bounds, grams = _grams(names)
        row, token = key // width, key % width
        many = np.diff(bounds)[token]
        ends = np.cumsum(many)
        place = np.repeat(bounds[token] - (ends - many), many) + np.arange(int(many.sum()))
        names, width = grams, max(len(grams), 1)
        key, n = _summed(np.repeat(row, many) * width + gram[place], np.repeat(n, many))
    return key // width, key % width, n, names


def _blocks(batches: Iterator[pa.RecordBatch], shapes: Sequence[str | None]) -> Iterator[tuple[pa.Table, int, list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]]]:
    """For each run of texts its first rows, the number of texts, and the counted terms of each block."""
    for run in _texts(batches):
        first, block = run["_first"].to_numpy(), run["_block"].to_numpy()
        row, tokens = np.cumsum(first) - 1, pa.concat_arrays(run["_token"].chunks)
        there = tokens.is_valid().to_numpy(zero_copy_only=False)
        parts = []
        for k, shape in enumerate(shapes):
            some = np.flatnonzero(there & (block == k))
            parts.append(_counts(row[some], tokens.take(pa.array(some)), shape))
        yield run.filter(run["_first"]), int(first.sum()), parts


def _shapes(terms: Sequence[Terms | Column]) -> list[str | None]:
    return [t.shape if isinstance(t, Terms) else None for t in terms]


def _counted(shape: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, [(_, term, n, names)] in _blocks(batches, [shape]):
            frequency, documents = (np.bincount(term, x, len(names)).astype(np.int64) for x in (n, None))
            yield pa.RecordBatch.from_arrays([names, pa.array(frequency), pa.array(documents)], names=["term", "frequency", "documents"])

    return run


def fit_vocabulary(train: DataFrame, terms: Terms | Column, max_features: int) -> Vocabulary:
    """The ``max_features`` most frequent terms of ``train`` (ties by term), with their document counts, in one pass."""
    if max_features > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms")
    counts = _tokens(train, [terms], []).mapInArrow(_counted(*_shapes([terms])), "term string, frequency long, documents long")
    counts = counts.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.sum("documents").alias("documents"))
    top = counts.orderBy(F.desc("frequency"), "term").limit(max_features).toPandas()
    top = top.iloc[np.argsort(np.array([t.encode() for t in top["term"]], dtype=object), kind="stable")]
    return Vocabulary(pa.array(top["term"].tolist(), pa.string()), top["frequency"].to_numpy(np.int64), top["documents"].to_numpy(np.int64), train.count())


def _weighted(shapes: list[str | None], blocks: Sequence[tuple[pa.Array, np.ndarray | None]], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, texts, parts in _blocks(batches, shapes):
            rows, places, values, start = [], [], [], 0
            for (terms, idf), (row, term, n, names) in zip(blocks, parts):
                known = pc.fill_null(pc.index_in(names, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = known[term] >= 0
                row, place, weight = row[hit], known[term[hit]], n[hit].astype(np.float64)
                order = np.lexsort((place, row))
                row, place, weight = row[order], place[order], weight[order]
                if idf is not None:
                    weight = (1 + np.log(weight)) * idf[place]
                    weight /= np.sqrt(np.bincount(row, weight * weight, minlength=texts))[row]
                rows.append(row), places.append(place + start), values.append(weight)
                start += len(terms)
            row, place, value = (np.concatenate(x) for x in (rows, places, values))
            order = np.argsort(row, kind="stable")
            at = pa.array(np.searchsorted(row[order], np.arange(texts + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (place[order].astype(np.int32), value[order])]
            yield from pa.table([*(kept[c] for c in keep), *lists], names=[*keep, "indices", "values"]).to_batches()

    return run


def encode(docs: DataFrame, blocks: Sequence[tuple[Terms | Column, Vocabulary]], keep: Sequence[str], counts: bool = False) -> DataFrame:
    """``keep`` columns with the sparse vector of each row: the blocks of (terms, vocabulary) side by side.

    Each block is the sublinear term frequency times idf, scaled to unit length, or the plain term counts. A null text and one
    without known terms have an empty block.
    """
    terms = [t for t, _ in blocks]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    plan = [(v.terms, None if counts else v.idf) for _, v in blocks]
    return _tokens(docs, terms, keep).mapInArrow(_weighted(_shapes(terms), plan, list(keep)), f"{schema}, indices array<int>, values array<double>")


def width(blocks: Sequence[tuple[Terms | Column, Vocabulary]]) -> int:
    return sum(len(v) for _, v in blocks)
