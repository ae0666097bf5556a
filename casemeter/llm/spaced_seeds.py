"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, marks and digits of any script, without regard to case, and single characters where a script has no blanks; all else separates. A document holds a passage of an item where ``WINDOW`` tokens in a row differ from the item's in
at most ``SUBSTITUTIONS`` places. Two fixed masks read six of eight positions each; whatever two places of a window differ, one
mask fits somewhere free of them (a test tries all), so no such passage is missed. Seeds of documents are joined with those of the items, and
the tokens around each hit, carried along, decide.

An item of fewer tokens than ``WINDOW`` is a window of its own. With ``short_items`` it may differ in one token for each ``WINDOW // SUBSTITUTIONS`` of its
tokens: one of 8 to 15 tokens in one, a shorter one in none. Its tokens are cut into ``PARTS`` parts, and each mask leaves out one of them; as one
substitution lies in one part, one mask is free of it. Items that must be whole have one mask, the hash of the whole sequence. Without
``short_items``, items of ``SHORTEST`` to ``WINDOW - 1`` tokens must occur whole and unchanged, and shorter ones match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casemeter.llm.common import slices, written
from casemeter.llm.words import _power, U, Words, letters, mix, within

WINDOW, SUBSTITUTIONS, SHORTEST = 16, 2, 8
MASKS = ("11100111", "11101101")
SPAN = 8
#: Tokens on each side of a seed that a window around it may hold.
SIDE = WINDOW - SPAN
PARTS = 4
_BITS = 22
_B = 0x9FB21C651E98DF25
_B_INVERSE = pow(_B, -1, 1 << 64)


def _seeds(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every seed; a seed lies in one text."""
    n = max(0, len(hashes) - SPAN + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:n] == owner[SPAN - 1 : SPAN - 1 + n])
    places, seeds = [], []
    for number, mask in enumerate(MASKS):
        value = np.full(len(at), number + 1, U)
        for k, bit in enumerate(mask):
            if bit == "1":
                value = value * U(0xD1342543DE82EF95) + hashes[at + k]
        places.append(at)
        seeds.append(mix(value))
    return np.concatenate(places), np.concatenate(seeds)


def substitutions(tokens: int, short_items: bool) -> int:
    """How many tokens of a short item may differ."""
    return tokens * SUBSTITUTIONS // WINDOW if short_items else 0


def gaps(tokens: int, short_items: bool) -> list[tuple[int, int]]:
    """The part that each mask of a short item leaves out."""
    if not substitutions(tokens, short_items):
        return [(0, 0)]
    cuts = [tokens * k // PARTS for k in range(PARTS + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _short_seeds(hashes: np.ndarray, bounds: np.ndarray, tokens: int, short_items: bool) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every run of ``tokens`` tokens of a text, for each mask; where the run must be whole, once for each text and hash."""
    at = np.flatnonzero(within(bounds, tokens))
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * _power(_B, n))])
    places, seeds = [], []
    for number, (first, last) in enumerate(gaps(tokens, short_items)):
        value = (sums[at + first] - sums[at] + sums[at + tokens] - sums[at + last]) * _power(_B_INVERSE, n)[at]
        places.append(at)
        seeds.append(mix(value ^ mix(U(1000 + 10 * tokens + number))))
    places, seeds = np.concatenate(places), np.concatenate(seeds)
    if not substitutions(tokens, short_items):
        text = np.searchsorted(bounds, places, "right") - 1
        order = np.lexsort((seeds, text))
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (seeds[order][1:] != seeds[order][:-1])
        places, seeds = places[order[new]], seeds[order[new]]
    return places, seeds


def _context(hashes: np.ndarray, bounds: np.ndarray, places: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Tokens from SIDE before a seed to SIDE behind it, or the ``tokens`` tokens of a short item's window; 0 outside of the text."""
    text = np.searchsorted(bounds, places, "right") - 1
    short = (tokens > 0)[:, None]
    at = places[:, None] + np.arange(-SIDE, SPAN + SIDE) + np.where(short, SIDE, 0)
    inside = (at >= bounds[text][:, None]) & (at < np.where(short, (places + tokens)[:, None], bounds[text + 1][:, None]))
    return np.where(inside, hashes[np.clip(at, 0, max(0, len(hashes) - 1))], U(0))


def _all_seeds(words: Words, lengths: list[int] | None, short_items: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and tokens (0: a seed of a whole window) of every seed: of items, or of documents for short items of ``lengths``."""
    hashes, bounds = words.hashes | U(1), words.bounds  # never 0, which stands for no token
    sizes = np.diff(bounds)
    places, seeds = _seeds(hashes, bounds)
    if lengths is None:
        long = sizes[np.searchsorted(bounds, places, "right") - 1] >= WINDOW
        places, seeds = places[long], seeds[long]
    found = [(places, seeds, np.zeros(len(places), np.int64))]
    for tokens in range(1 if short_items else SHORTEST, WINDOW) if lengths is None else lengths:
        places, seeds = _short_seeds(hashes, bounds, tokens, short_items)
        if lengths is None:
            own = sizes[np.searchsorted(bounds, places, "right") - 1] == tokens
            places, seeds = places[own], seeds[own]
        found.append((places, seeds, np.full(len(places), tokens)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _emit(bits: np.ndarray | None, lengths: list[int] | None, short_items: bool):
    """Rows (seed, id, tokens, context) of a table (id, text); ``bits`` drops seeds that no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = letters(batch.column("text"))
            places, seeds, tokens = _all_seeds(words, lengths, short_items)
            if bits is not None:
                some = (bits[(seeds >> U(64 - _BITS)).astype(np.int64) >> 3] >> (seeds >> U(64 - _BITS) & U(7)).astype(np.uint8)) & 1
                places, seeds, tokens = places[some == 1], seeds[some == 1], tokens[some == 1]
            if not len(seeds):
                continue
            context = _context(words.hashes | U(1), words.bounds, places, tokens)
            text = np.searchsorted(words.bounds, places, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds.view(np.int64)), batch.column("id").take(pa.array(text)), pa.array(np.diff(words.bounds)[text]), pa.array([c.tobytes() for c in context], pa.binary())],
                names=["seed", "id", "tokens", "context"],
            )

    return run


def _verified(short_items: bool):
    most = np.array([substitutions(n, short_items) for n in range(WINDOW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(-1, SPAN + 2 * SIDE) for c in ("doc_context", "context"))
            tokens = batch.column("tokens").to_numpy()
            same = (a == b) & (a > 0) & (b > 0)
            sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            best = (sums[:, WINDOW:] - sums[:, :-WINDOW]).max(1)
            both = np.cumsum(np.pad((a > 0) & (b > 0), ((0, 0), (1, 0))), axis=1)
            full = ((both[:, WINDOW:] - both[:, :-WINDOW] == WINDOW) & (sums[:, WINDOW:] - sums[:, :-WINDOW] >= WINDOW - SUBSTITUTIONS)).any(1)
            short = (both[:, -1] == tokens) & (sums[:, -1] >= tokens - most[np.minimum(tokens, WINDOW - 1)])
            keep = np.where(tokens < WINDOW, short, full)
            out = batch.append_column("matched", pa.array(np.where(tokens < WINDOW, sums[:, -1], best).astype(np.int64)))
            yield out.filter(pa.array(keep)).select(["row", "item_id", "matched"])

    return run


def matches(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", short_items: bool = False) -> DataFrame:
    """row, item_id, matched (most equal tokens of one window) of each document (row, text) and item that share a passage; ``row`` may be a number or bytes.

    ``short_items`` matches items of 1 to ``WINDOW - 1`` tokens too, in windows of their own length. A table of 2**22 bits, half a megabyte whatever the benchmark's size, lets tasks pass over most seeds that no item has.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    seeds = written(items.mapInArrow(_emit(None, None, short_items), "seed long, id long, tokens long, context binary").dropDuplicates(["seed", "id", "context"]))
    cell = F.shiftrightunsigned("seed", 64 - _BITS)
    flags = seeds.groupBy(F.shiftright(cell, 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), cell.bitwiseAND(F.lit(7))).cast("int")).alias("bits")).toPandas()
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    bits[flags["byte"].to_numpy(np.int64)] = flags["bits"].to_numpy(np.int64)
    lengths = sorted(seeds.where(F.col("tokens") < WINDOW).select("tokens").distinct().toPandas()["tokens"].tolist())  # fewer than WINDOW
    kind = rows.schema["row"].dataType.simpleString()
    probes = rows.select(F.col("row").alias("id"), "text").mapInArrow(_emit(bits, lengths, short_items), f"seed long, id {kind}, tokens long, context binary")
    probes = probes.select("seed", F.col("id").alias("row"), F.col("context").alias("doc_context"))
    pairs = probes.join(seeds.select("seed", F.col("id").alias("item_id"), "tokens", "context"), "seed")
    found = pairs.select("row", "item_id", "tokens", "doc_context", "context").mapInArrow(_verified(short_items), f"row {kind}, item_id long, matched long")
    return found.groupBy("row", "item_id").agg(F.max("matched").alias("matched"))


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted), matched, row: one row per row of ``docs``.

    Null and empty texts are clean, an item without id counts as an item but is not listed, and other columns are not read.
    """
    rows = written(tagged(docs, id_col, text_col))
    found = matches(rows, benchmark, short_items=short_items).groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("item_id")).alias("ids"), F.max("matched").alias("matched"))
    return rows.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"),
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("matched", F.lit(0)).alias("matched"), "row",
    )
