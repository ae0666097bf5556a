"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice.

Each of ``tables`` projects the unit vectors to eight dimensions, divides them by ``scale``, shifts them and decodes them to the nearest
point of E8: the vector's home cell. It also probes the neighbouring cells whose boundary is within ``reach``. Two vectors meet where one is
at home and the other at home or probing; the pairs of a cell are compared by cosine in double precision and nothing else decides a link.
A pair that meets in several cells counts in the first of them, which both vectors' cells tell without a look at other tasks.

Equal vectors are one class with a weight, so copies are never paired. Cells of more than ``BLOCK`` rows are cut into blocks, and each pair
of blocks is a matrix product of its own. A task gives sums by vector and a spanning forest of the links it saw, never the links, so its
output grows with its rows alone.

At cosine 0.95 a pair meets in one table with a probability of 0.73, in one of the four with 0.995; more at higher cosines. A larger table
takes a smaller ``scale`` (finer cells) and more ``tables``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from casemeter.llm.common import one_array, written
from casemeter.llm.graph import components
from casemeter.llm.words import mix

#: Rows of a cell that one task compares with one another; larger cells are cut into blocks of about so many.
BLOCK = 1024
_SMALL = 24
_CHUNK = 1 << 14
_TABLE_BITS = 5
_NO_CELL = -1
#: Coordinates are whole multiples of 2**-_GRID, so that projections are exact sums in any order and every task finds the same cells.
_GRID = 18
_WEIGHT_GRID = 10


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the differences between a lattice point and its neighbours."""
    whole = [v for i, j in itertools.combinations(range(8), 2) for s, t in itertools.product((1, -1), repeat=2) for v in [np.eye(8)[i] * s + np.eye(8)[j] * t]]
    half = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


_NEIGHBOURS = _minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of the even points or of those shifted by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _cell(points: np.ndarray, table: int) -> np.ndarray:
    """A number for each lattice point of a table; its lowest bits are the table's."""
    h = np.full(points.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        h = mix(h ^ (2 * points[..., k]).astype(np.int64).astype(np.uint64))
    return ((h >> np.uint64(1 + _TABLE_BITS)).astype(np.int64) << _TABLE_BITS) | table


class Lattice:
    """The cells of unit vectors, the same for a vector wherever it is computed."""

    def __init__(self, tables: int = 4, scale: float = 1.6, reach: float = 0.1, seed: int = 8):
        if not 1 <= tables <= 1 << _TABLE_BITS:
            raise ValueError(f"1 to {1 << _TABLE_BITS} tables")
        self.tables, self.scale, self.reach, self.seed = tables, scale, reach, seed
        self._maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _map(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self._maps:
            draw = np.random.default_rng([self.seed, size])
            weights = np.rint(draw.normal(size=(size, 8 * self.tables)) / self.scale * 2**_WEIGHT_GRID)
            self._maps[size] = weights, draw.random((self.tables, 8)) * 2
        return self._maps[size]

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cells (row, table) and probed cells (row, table, place), filled up with ``_NO_CELL``."""
        weights, shifts = self._map(units.shape[1])
        places = (np.rint(units * 2**_GRID) @ weights).reshape(len(units), self.tables, 8) / 2.0 ** (_GRID + _WEIGHT_GRID)
        homes, probes = np.empty((len(units), self.tables), np.int64), []
        for table in range(self.tables):
            x = places[:, table] + shifts[table]
            home = decode(x)
            homes[:, table] = _cell(home, table)
            inward = np.zeros((len(x), len(_NEIGHBOURS)))
            for k in range(8):
                inward += (x[:, k] - home[:, k])[:, None] * _NEIGHBOURS[:, k]
            # The boundary to a neighbour lies at half of its distance, the root of 2.
            row, way = np.nonzero(1 - inward <= self.reach * np.sqrt(2))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out = np.full((len(x), int(place.max(initial=-1)) + 1), _NO_CELL)
            out[row, place] = _cell(home[row] + _NEIGHBOURS[way], table)
            probes.append(out)
        width = max(p.shape[1] for p in probes)
        return homes, np.stack([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=_NO_CELL) for p in probes], 1)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, first place, size and validity of each vector: not null, without null or non-finite components, not all zero."""
    column = one_array(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    holes = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False)
    first, size = offsets[:-1], np.diff(offsets)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    bad, some = sums(holes | ~np.isfinite(flat)), sums(flat != 0)
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    return flat + 0.0, first, size, valid & (bad[offsets[1:]] == bad[first]) & (some[offsets[1:]] > some[first])


def _digested(whole: bool):
    """id, digest (null where nothing can be linked) and, if ``whole``, the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, first, size, valid = _vectors(batch.column("vector"))
            keep = np.flatnonzero(valid) if whole else np.arange(batch.num_rows)
            data = [flat[first[k] : first[k] + size[k]].tobytes() if valid[k] else None for k in keep.tolist()]
            digest = pa.array([d if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary())
            ids = batch.column("id").take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, digest, *([pa.array(data, pa.binary())] if whole else [])], names=["id", "digest", "bytes"][: 2 + whole])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers in an order that has nothing to do with the rows', as the search for components wants them."""
    for batch in batches:
        number = mix(batch.column("node").to_numpy().astype(np.uint64)).astype(np.int64)
        yield batch.set_column(batch.schema.get_field_index("node"), "node", pa.array(number))


def _by_size(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector size, and their unit vectors in double precision."""
    column = one_array(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) else np.zeros(0, kind)
    offsets = (offsets - offsets[0]) // np.dtype(kind).itemsize
    size = np.diff(offsets)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        x = data[offsets[rows][:, None] + np.arange(n)].astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _placed(lattice: Lattice, kind: type, whole: bool):
    """One row for each cell that a vector has: its home cells and those it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                for rows, units in _by_size(part.column("bytes"), kind):
                    homes, probes = lattice.cells(units)
                    cells = np.concatenate([homes[:, :, None], probes], 2)
                    row, _, place = at = np.nonzero(cells != _NO_CELL)
                    # Vectors of other sizes have cells of their own.
                    cell = pa.array(cells[at] ^ (units.shape[1] << 40))
                    if not whole:
                        yield pa.RecordBatch.from_arrays([cell], names=["cell"])
                        continue
                    taken = part.take(pa.array(rows[row]))
                    yield pa.RecordBatch.from_arrays(
                        [cell, pa.array(place == 0), taken.column("node"), taken.column("weight"), taken.column("bytes")],
                        names=["cell", "home", "node", "weight", "bytes"],
                    )

    return run


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place by the links (a, b)."""
    label = np.arange(size)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _first_meeting(lattice: Lattice, units: np.ndarray, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether ``cell`` is the first cell in which the vectors of each pair meet."""
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    homes, probes = lattice.cells(units[used])
    a, b = back[: len(a)], back[len(a) :]
    out = np.zeros(len(a), bool)
    far = np.iinfo(np.int64).max
    for start in range(0, len(a), 1 << 17):
        x, y, c = a[start : start + (1 << 17)], b[start : start + (1 << 17)], cell[start : start + (1 << 17)]
        first = np.full(len(x), far)
        for table in range(lattice.tables):
            open_ = first == far
            if not open_.any():
                break
            p, q = x[open_], y[open_]
            hp, hq = homes[p, table], homes[q, table]
            at_p = (hp == hq) | (probes[q, table] == hp[:, None]).any(1)
            at_q = (hp == hq) | (probes[p, table] == hq[:, None]).any(1)
            first[open_] = np.minimum(np.where(at_p, hp, far), np.where(at_q, hq, far))
        out[start : start + (1 << 17)] = first == c
    return out


def _linked(lattice: Lattice, cosine: float, kind: type):
    """Compare the pairs of each cell or pair of blocks. Gives (a, null, weight of what a is linked with) and (a, b, null) of a forest.

    Rows come sorted by (cell, low, high); only the rows of unfinished groups wait for the next batch.
    """

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).to_numpy()
        cell, low, high, own, home = column("cell"), column("low"), column("high"), column("block"), column("home")
        node, weight = column("node"), column("weight")
        change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        bounds = np.concatenate([[0], change, [len(cell)]])
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        small = np.repeat(np.diff(bounds) <= _SMALL, np.diff(bounds))
        for size_rows, units in _by_size(rows.column("bytes"), kind):
            at = np.full(len(cell), -1)
            at[size_rows] = np.arange(len(size_rows))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for step in range(1, _SMALL):
                x = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if step < len(cell) else np.zeros(0, np.int64)
                if not len(x):
                    break
                y = x + step
                x, y = (z[(home[x] | home[y]) & (at[x] >= 0) & (at[y] >= 0) & ((low[x] == high[x]) | (own[x] != own[y]))] for z in (x, y))
                near = np.einsum("ij,ij->i", units[at[x]], units[at[y]]) >= cosine
                found.append((x[near], y[near]))
            yield from told(found, cell, node, weight, units, at)
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if end - start > _SMALL:
                    part = np.arange(start, end)
                    part = part[at[part] >= 0]
                    if low[start] == high[start]:
                        near = units[at[part]] @ units[at[part]].T >= cosine
                        near &= home[part][:, None] | home[part]
                        x, y = np.nonzero(np.triu(near, 1))
                        x, y = part[x], part[y]
                    else:
                        left, right = part[own[part] == low[start]], part[own[part] == high[start]]
                        near = units[at[left]] @ units[at[right]].T >= cosine
                        near &= home[left][:, None] | home[right]
                        x, y = np.nonzero(near)
                        x, y = left[x], right[y]
                    yield from told([(x, y)], cell, node, weight, units, at)

    def told(found: list[tuple[np.ndarray, np.ndarray]], cell: np.ndarray, node: np.ndarray, weight: np.ndarray, units: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if not len(a):
            return
        used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = back[: len(a)], back[len(a) :]
        root = _forest(len(used), x, y)
        child = np.flatnonzero(root != np.arange(len(used)))
        first = _first_meeting(lattice, units[at[used]], x, y, cell[a] ^ (units.shape[1] << 40))
        x, y = x[first], y[first]
        n = np.zeros(len(used), np.int64)
        np.add.at(n, x, weight[used[y]])
        np.add.at(n, y, weight[used[x]])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[used[some]], node[used[child]]])),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[used[root[child]]])]),
                pa.concat_arrays([pa.array(n[some]), pa.nulls(len(child), pa.int64())]),
            ],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            if sum(b.num_rows for b in wait) < _CHUNK:
                continue
            rows = pa.Table.from_batches(wait)
            last = tuple(rows.column(c)[-1].as_py() for c in ("cell", "low", "high"))
            same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("cell", "low", "high"), last)])
            open_ = int(np.flatnonzero(~same).max(initial=-1)) + 1
            if open_:
                yield from compare(rows.slice(0, open_))
                wait = rows.slice(open_).combine_chunks().to_batches()
        if wait:
            yield from compare(pa.Table.from_batches(wait))

    return run


def classify(
    vectors: DataFrame, cosine: float = 0.95, lattice: Lattice | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, all zero or hold a null or non-finite component, and empty ones, are linked with nothing; vectors of different
    sizes are never linked. Rows with equal vectors are linked. ``component_id`` is the smallest id that links reach, null where only rows
    without id are; ``kept`` is true for every row whose id that is, so rows that repeat an id share its fate. Other columns are not read, and
    an empty table gives no rows.
    """
    lattice = lattice or Lattice()
    of = vectors.schema[vector_col].dataType.elementType
    kind = np.float32 if isinstance(of, T.FloatType) else np.float64
    vector = F.col(vector_col) if kind is np.float32 else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    classes = (
        rows.mapInArrow(_digested(True), "id long, digest binary, bytes binary")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("bytes").alias("bytes"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes.mapInArrow(_numbered, classes.schema))
    crowded = written(
        classes.select("bytes").mapInArrow(_placed(lattice, kind, False), "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    placed = classes.select("node", "weight", "bytes").mapInArrow(_placed(lattice, kind, True), "cell long, home boolean, node long, weight long, bytes binary")
    placed = placed.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.hash("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cell", "low", "high"]
    placed = placed.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "home", "node", "weight", "bytes")
    seen = written(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(lattice, cosine, kind), "a long, b long, n long"))
    sums = seen.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(seen.where("b is not null").select("a", "b"))
    known = classes.select("digest", "id", "weight", "node").join(sums, "node", "left").join(labels, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("id").alias("component_id"))
    known = known.join(least, "label").select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.mapInArrow(_digested(False), "id long, digest binary").join(known, "digest", "left")
    group = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept")
    )


def recall(vectors: DataFrame, cosine: float = 0.95, every: int = 50, lattice: Lattice | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """links, found: links of the rows whose id is divisible by ``every`` by brute force against all rows, and as :func:`classify` found them.

    Those rows travel to every task in blocks of ``_CHUNK`` rows; each task compares a block with its own rows by matrix products.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = rows.where(F.col("id") % every == 0).mapInArrow(_digested(True), "id long, digest binary, bytes binary").select("id", "bytes")
    total, parts = None, max(1, -(-asked.count() // _CHUNK))
    for part in range(parts):
        block = asked.where(F.pmod(F.hash("id"), F.lit(parts)) == part).toPandas()
        ids, data = block["id"].to_numpy(), list(block["bytes"])

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, data: list[bytes] = data) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(d) // 8 for d in data], np.int64)
            n = np.zeros(len(ids), np.int64)
            for batch in batches:
                for here, units in _by_size(batch.column("bytes"), np.float64):
                    q = np.flatnonzero(sizes == units.shape[1])
                    if len(q):
                        _, mine = next(_by_size(pa.array([data[k] for k in q], pa.binary()), np.float64))
                        n[q] += (mine @ units.T >= cosine).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

        every_row = rows.mapInArrow(_digested(True), "id long, digest binary, bytes binary").select("bytes")
        sums = every_row.mapInArrow(run, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("links"))
        total = sums if total is None else total.union(sums)
    found = classify(vectors, cosine, lattice, id_col, vector_col).select(F.col("vec_id").alias("id"), "n_links")
    return total.join(found, "id").agg(F.sum("links").alias("links"), F.sum("n_links").alias("found"))

