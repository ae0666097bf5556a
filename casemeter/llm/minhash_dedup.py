"""Near-duplicates by one-permutation MinHash with optimal densification.

Documents with equal shingle sets collapse to one class before anything is compared. One hash of each shingle fills
``BINS`` bins; an empty bin copies a filled one that a hash of (bin, attempt) selects, so each bin agrees with the
probability of the Jaccard similarity. Bands of bins name buckets. A bucket proposes star edges to its smallest and its
largest class. What the stars leave apart in one bucket is compared too: members outside the bucket's largest
component against those of other components. In a bucket of over ``CROWD`` members (a passage that many unlike documents share) the members are keyed anew by
their rarest bins first, so many that two classes which agree in enough bins share one, and only those that do are compared. A pair is
compared by size and sketch where it meets, in crowds by the sets themselves unless they are large. Of the components that may so be linked no more leaves a task than joins them to a
family. Then every class stands in its family once, with its whole set, and the pairs of a family are decided there; one link joins two components, the others between
them are not needed. So no component is missed, and a bucket whose members belong
together costs a star. A pair is dropped early only where the agreeing bins are over 0.2 below the threshold, five or
more standard deviations; a sketch keeps 8 bits of each bin, which can only make more bins agree. Links are confirmed on the
full sets, which are made anew from the texts of the candidates and never stored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casemeter.llm.common import one_array, slices, written
from casemeter.llm.graph import components
from casemeter.llm.words import U, mix, split, windows

BINS, BAND = 128, 4
#: Members of a group that one task compares with one another.
BLOCK = 1024
#: Members of a bucket that are paired directly where stars leave them apart; a larger bucket's members are keyed anew by their rarest bins.
CROWD = 64
#: Shingles up to which a class of a crowd is compared by its set rather than by its sketch alone.
WHOLE = 512
#: Shingles up to which a class is decided by its whole set in its family; pairs with a larger one are confirmed from the texts.
FULL = 4096
#: How far the share of agreeing bins may lie below the similarity of a link before a pair is dropped.
_SLACK = 0.2
_ATTEMPTS = 2048
_BITS = 22


@cache
def _probes() -> np.ndarray:
    at = np.arange(BINS * _ATTEMPTS, dtype=np.uint64).reshape(BINS, _ATTEMPTS)
    return (mix(at * U(0x9E3779B97F4A7C15) + U(77)) >> U(57)).astype(np.int64)


def shingle_sets(words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle, no words none."""
    grams = windows(words.hashes, size)
    out = []
    for first, last in zip(words.bounds[:-1], words.bounds[1:]):
        if last - first >= size:
            out.append(np.unique(grams[first : last - size + 1]))
        elif last > first:
            out.append(windows(words.hashes[first:last], int(last - first)) ^ U(last - first))
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` values for each set; every set needs an element."""
    sizes = np.array([len(s) for s in sets])
    owner, hashes = np.repeat(np.arange(len(sets)), sizes), mix(np.concatenate(sets) ^ U(0x5BD1E995))
    cell = owner * BINS + (hashes >> U(57)).astype(np.int64)
    values = ((hashes >> U(20)) & U(0xFFFFFFFF)).astype(np.int64)
    flat = np.full(len(sets) * BINS, -1, np.int64)
    order = np.lexsort((values, cell))
    lead = np.ones(len(order), bool)
    lead[1:] = cell[order][1:] != cell[order][:-1]
    flat[cell[order][lead]] = values[order][lead]
    table = flat.reshape(len(sets), BINS)
    filled = table.copy()
    row, column = np.nonzero(table < 0)
    for attempt in range(_ATTEMPTS):
        if not len(row):
            break
        found = table[row, _probes()[column, attempt]]
        filled[row, column] = found
        row, column = row[found < 0], column[found < 0]
    if len(row):
        filled[row, column] = np.where(table < 0, np.int64(1) << 40, table).min(1)[row]
    return filled.astype(np.uint32)


_SETS = "row long, doc_id long, node binary, n_shingles long, sketch binary, bands array<long>, text string"


def band_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bands = table.reshape(len(table), BINS // BAND, BAND).astype(U)
    key = np.broadcast_to(mix(np.arange(1, BINS // BAND + 1, dtype=U)), bands.shape[:2]).copy()
    for k in range(BAND):
        key = mix(key * U(0xD1342543DE82EF95) + bands[:, :, k])
    return key


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(split(batch.column("text"), fold=True), size)
            some = [s for s in sets if len(s)]
            signed = signatures(some) if some else np.zeros((0, BINS), np.uint32)
            sketches, keys = iter((signed & 255).astype(np.uint8)), iter(band_keys(signed).view(np.int64))
            nodes = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())), batch.column("text")],
                names=["row", "doc_id", "node", "n_shingles", "sketch", "bands", "text"],
            )

    return run


def _alike(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
                yield batch.filter(pa.array((a == b).mean(1) >= floor)).select(["a", "b"])

    return run


def _cell(node: Column) -> Column:
    """A place in the table of ``2**_BITS`` bits for a class."""
    return F.shiftrightunsigned(F.xxhash64(node), 64 - _BITS)


def _marked(classes: DataFrame) -> np.ndarray:
    """Bits of the classes, of fixed size whatever their number; a full table only filters nothing."""
    cell = _cell(F.col("node"))
    flags = classes.groupBy(F.shiftright(cell, 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), cell.bitwiseAND(F.lit(7))).cast("int")).alias("bits")).toPandas()
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    bits[flags["byte"].to_numpy(np.int64)] = flags["bits"].to_numpy(np.int64)
    return bits


def _wanted(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1) == 1)).select(["node", "text"])

    return run


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "ta"):
                coded = [one_array(part.column(c)).dictionary_encode() for c in ("ta", "tb")]  # a text stands in many pairs
                sets = [shingle_sets(split(c.dictionary, fold=True), size) for c in coded]
                left, right = ([have[k] for k in c.indices.to_pylist()] for have, c in zip(sets, coded))
                shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(left, right, strict=True)]
                keep = [100 * n >= percent * (len(a) + len(b) - n) for n, a, b in zip(shared, left, right)]
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough: by size, by sketch, then by the sets, made anew from one text of each class."""
    side = lambda x, *more: classes.select(F.col("node").alias(x), *[F.col(c).alias(n) for c, n in more])
    sized = pairs.join(side("a", ("n_shingles", "na"), ("sketch", "sa")), "a").join(side("b", ("n_shingles", "nb"), ("sketch", "sb")), "b")
    sized = sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = written(sized.select("a", "b", "sa", "sb").mapInArrow(_alike(percent / 100 - _SLACK), "a binary, b binary"))
    bits = _marked(near.select(F.explode(F.array("a", "b")).alias("node")))
    texts = rows.where("node is not null").select("node", "text", _cell(F.col("node")).alias("cell")).mapInArrow(_wanted(bits), "node binary, text string")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")))
    full = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return written(full.select("a", "b", "ta", "tb").mapInArrow(_confirmed(size, percent), "a binary, b binary"))


def _full_sets(size: int, bits: np.ndarray):
    """The sets, in 64 bits for each shingle, of the texts whose class may be marked, but for large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wanted(bits)(batches):
            for part in slices([batch], "text"):
                sets = shingle_sets(split(part.column("text"), fold=True), size)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() if len(x) <= FULL else None for x in sets], pa.binary())], names=["node", "set"])

    return run


def _full_signatures(size: int, bits: np.ndarray):
    """Signatures of the texts whose class may be marked, in 32 bits for each bin, and the sets themselves, in 32 bits for each shingle, where they are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wanted(bits)(batches):
            for part in slices([batch], "text"):
                sets = shingle_sets(split(part.column("text"), fold=True), size)
                small = [np.unique(x.astype(np.uint32)).tobytes() if len(x) <= WHOLE else None for x in sets]
                signed = [row.tobytes() for row in signatures(sets)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(signed, pa.binary()), pa.array(small, pa.binary())], names=["node", "sig", "set"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bin of a signature: bin and value as one number."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            values = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, BINS).astype(np.int64)
            keys = values | (np.arange(BINS) << 32)
            at = pa.array(np.repeat(np.arange(len(values)), BINS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("node").take(at), part.column("label").take(at)], names=["key", "node", "label"])


def _rare_tokens(crowd: DataFrame, rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, label): the rarest bins of each class of ``crowd`` (node, label), as many as two classes that agree in enough bins must share one of; and
    (node, set) of the crowd.

    With t bins to agree in, two classes share one of the rarest ``BINS - t + 1`` of each, in any one order of all values; the order is by their number in
    the crowd. A value that one class alone has takes its place among the rarest and needs no row.
    """
    prefix = BINS - math.ceil(BINS * (percent / 100 - _SLACK)) + 1
    marked = rows.where("node is not null").select("node", "text", _cell(F.col("node")).alias("cell"))
    signed = marked.mapInArrow(_full_signatures(size, _marked(crowd)), "node binary, sig binary, set binary")
    signed = written(signed.groupBy("node").agg(F.first("sig").alias("sig"), F.first("set").alias("set")).join(crowd, "node"))
    tokens = signed.select("node", "label", "sig").mapInArrow(_tokens, "key long, node binary, label binary")
    shared = tokens.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    known = tokens.join(shared, "key")
    order, whole = Window.partitionBy("node").orderBy("n", "key"), Window.partitionBy("node")
    rank = F.row_number().over(order) + F.lit(BINS) - F.count("*").over(whole)
    return written(known.withColumn("rank", rank).where(F.col("rank") <= prefix).select("key", "node", "label")), signed.select("node", "set")


def _root(lead: dict[int, int], label: int) -> int:
    """The component that ``label`` belongs to by the pairs so far."""
    while label in lead:
        label = lead[label]
    return label


def _shared(sets: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all sets as places in one list, bounds of each, and the list's marks; a set that is not there has none."""
    flat = np.concatenate([x for x in sets if x is not None])
    names, place = np.unique(flat, return_inverse=True)
    return place, np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in sets])]), np.zeros(len(names), bool)


def _compared(percent: int, final: bool):
    """What sizes, sketches and sets say of the pairs of different components in a group, or between two blocks of one.

    Where it is ``final``, sets are whole and decide: pairs (a, b) of classes, of the links as many as join the components, and every pair that may be one but has a class without set.
    Else labels (a, b) of components that may be linked, as many as join them. Rows come sorted by (key, lower, upper); only the rows of an unfinished group wait for the next batch.
    """
    bits = np.uint64 if final else np.uint32
    floor = math.ceil(BINS * (percent / 100 - _SLACK))
    names = ("key", "lower", "upper")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        node, names_of = one_array(rows.column("node")), one_array(rows.column("label"))
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        key, lower, upper, block, size, top = (column(c) for c in (*names, "block", "n_shingles", "is_top"))
        label = names_of.dictionary_encode().indices.to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(lower) != 0) | (np.diff(upper) != 0)) + 1
        sets = [None if x is None else np.frombuffer(x, bits) for x in rows.column("set").to_pylist()]
        whole = np.array([x is not None for x in sets])
        left, right = [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            at = np.arange(a, b)
            place, bounds, marks = _shared(sets[a:b]) if whole[a:b].any() else (None, None, None)
            own = at[~top[a:b]]
            lead: dict[int, int] = {}
            for i in own.tolist():
                # Two members that are not of the largest component meet once, in the order of their places.
                other = at[(label[a:b] != label[i]) & (top[a:b] | (at > i))]
                if lower[a] != upper[a]:
                    other = other[block[other] != block[i]]
                other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
                other = other[(sketch[other] == sketch[i]).sum(1) >= floor]
                if whole[i] and len(other):
                    marks[place[bounds[i - a] : bounds[i - a + 1]]] = True
                    sums = np.concatenate([[0], np.cumsum(marks[place])])
                    marks[:] = False
                    both = sums[bounds[other - a + 1]] - sums[bounds[other - a]]
                    other = other[~whole[other] | (100 * both >= percent * (size[other] + size[i] - both))]
                if final:
                    unsure = other[~(whole[other] & whole[i])]
                    left.append(np.full(len(unsure), i)), right.append(unsure)
                    other = other[whole[other] & whole[i]]
                for k in other[np.unique(label[other], return_index=True)[1]].tolist():
                    mine, its = _root(lead, int(label[i])), _root(lead, int(label[k]))
                    if mine != its:
                        lead[its] = mine
                        left.append(np.array([i])), right.append(np.array([k]))
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        if len(x):
            out = node if final else names_of
            yield pa.RecordBatch.from_arrays([out.take(pa.array(x)), out.take(pa.array(y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            if sum(b.num_rows for b in wait) < 1 << 12:
                continue
            rows = pa.Table.from_batches(wait)
            last = [rows.column(c)[-1].as_py() for c in names]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(names, last)])
            open_ = int(np.flatnonzero(~same).max(initial=-1)) + 1
            if open_:
                yield from compare(rows.slice(0, open_))
                wait = rows.slice(open_).combine_chunks().to_batches()
        if wait:
            yield from compare(pa.Table.from_batches(wait))

    return run


def _apart(groups: DataFrame, classes: DataFrame, percent: int, final: bool = False) -> DataFrame:
    """Pairs (a, b) of different components in one group of ``groups`` (key, node, label), by ``_compared``: of labels, or of classes where it is ``final``.

    ``classes`` has node, n_shingles, sketch and set, which may be null.

    Members of a group's largest component are not compared with one another, nor is any component within itself. A group of more than ``BLOCK``
    members is cut into blocks, and each two blocks are compared by themselves. Only pairs that may be links leave a task.
    """
    counts = groups.groupBy("key", "label").agg(F.count("*").alias("n"))
    counts = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    split_ = groups.join(counts.select("key", "top", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    split_ = split_.withColumn("block", F.pmod(F.hash("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split_ = split_.select("key", "node", "label", (F.col("label") == F.col("top")).alias("is_top"), "block", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"))
    facts = split_.join(classes.select("node", "n_shingles", "sketch", "set"), "node")
    names = ["key", "lower", "upper"]
    found = facts.repartition(*names).sortWithinPartitions(*names).mapInArrow(_compared(percent, final), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_families(apart: DataFrame, groups: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that join the components which ``apart`` (labels a, b) puts into one family and which have a link; ``groups`` (node, label) has the classes."""
    families = components(apart).select(F.col("node").alias("label"), F.xxhash64("label").alias("key"))
    members = written(groups.select("node", "label").distinct().join(families, "label").select("key", "node", "label"))
    marked = rows.where("node is not null").select("node", "text", _cell(F.col("node")).alias("cell"))
    sets = written(marked.mapInArrow(_full_sets(size, _marked(members)), "node binary, set binary").groupBy("node").agg(F.first("set").alias("set")).join(members.select("node"), "node", "left_semi"))
    return _apart(members, classes.join(sets, "node"), percent, final=True)


def classify(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept, first: one row per row of ``docs``.

    Texts without words, null ones included, are alone. ``component_id`` is the smallest id of the component (null ids are
    never the smallest beside others); ``kept`` marks the rows with that id, ``first`` one row of each component. Ids must be integers;
    other columns are not read, but for ``row_col``, which numbers the rows where it is given.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(rows.mapInArrow(_sets(size), _SETS))
    classes = rows.where("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")])
    classes = written(classes)
    members = classes.select(F.explode("bands").alias("key"), "node").repartition("key")
    stars = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = written(members.join(stars, "key"))
    ends = members.select("node", F.explode(F.array("low", "high")).alias("end")).where("node <> end")
    pairs = ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    tried = written(pairs.distinct())
    links = _links(tried, classes, rows, size, percent)
    labels = components(links)
    named = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("key").agg(F.count("*").alias("n"))
    sized = written(named.join(sizes.where("n > 1"), "key"))
    crowd = written(sized.where(F.col("n") > CROWD).select("node", "label").distinct())
    apart = _apart(sized.where(F.col("n") <= CROWD).drop("n"), classes.withColumn("set", F.lit(None).cast("binary")), percent)
    if not crowd.isEmpty():
        tokens, sets = _rare_tokens(crowd, rows, size, percent)
        apart = apart.union(_apart(tokens, classes.join(sets, "node"), percent)).distinct()
    apart = written(apart)
    rest = _links(written(_in_families(apart, sized, classes, rows, size, percent).join(tried, ["a", "b"], "left_anti")), classes, rows, size, percent)
    if not rest.isEmpty():
        labels = components(links.union(rest))
    rows = rows.select("row", "doc_id", "n_shingles", "node").join(labels, "node", "left")
    rows = written(rows.select("row", "doc_id", "n_shingles", F.coalesce("label", "node", F.encode(F.concat(F.lit("row "), F.col("row")), "utf-8")).alias("label")))
    firsts = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f"))
    firsts = firsts.select("label", "component_id", F.col("f.row").alias("f"))
    return rows.join(firsts, "label").select(
        "row", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("f")).alias("first")
    )
