"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two models of character pairs, one of random strings and one of ordinary identifiers, are counted over the whole table from samples that the
patterns label: the values of pattern matches are random strings, other words of 4 to 19 letters and digits are identifiers. What lies outside the pattern matches is cut into runs. Of each run, of any length, the stretches whose
log-likelihood ratios, in bits per character, score best above a margin are judged: one of over ``_EVIDENCE`` bits in all, what the shortest whole run needs at a margin of 1, is reported up to the next of ``+/_=-`` on each side, less the parts at its ends whose own mean is under the margin. There a pair with one of these
characters counts for nothing, since no sample of identifiers has them. A run of 20 or more characters without such a stretch is reported whole where its mean ratio is over the margin. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casemeter.llm.common import slices

# Fixed patterns; a shorter match is dropped after it has taken its place.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"[0-9a-f]{16,}")  # runs of [0-9a-f]+ are maximal, so this drops the short ones
KINDS = ("assign", "access", "hex")
#: Fewest characters of a run that is judged as a whole.
_WHOLE = 20
_EVIDENCE = float(_WHOLE - 1)
_JOINS = "+/_=-"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(_LETTERS), np.int64)
_CODE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
_OUTSIDE = len(_LETTERS)
_SIZE = len(_LETTERS) + 1
_PRIOR = 10.0
#: Samples of identifiers: their words, for a longer run may be the very string that is looked for.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{4,19}(?![A-Za-z0-9])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def _pairs(runs: list[str]) -> np.ndarray:
    """Counts of neighbouring characters; each run begins and ends with a character of its own."""
    codes = _CODE[np.frombuffer(" ".join(["", *runs, ""]).encode("ascii"), np.uint8)]
    return np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, _SIZE * _SIZE), np.int64)
    for batch in slices(batches, "text"):
        secrets: list[str] = []
        plain: list[str] = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            cut, at = [], 0
            for start, end, kind in spans:
                cut.append(text[at:max(start, at)])
                at = max(at, end)
                value = text[start:end]
                secrets.append(_ASSIGN.match(value).group(2).replace(".", "") if kind == "assign" else value)
            cut.append(text[at:])
            plain += [m for piece in cut for m in _IDENTIFIER.findall(piece)]
            if len(plain) > 50_000:
                total[1] += _pairs(plain)
                plain = []
        total[0] += _pairs(secrets)
        total[1] += _pairs(plain)
    model, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(pair), pa.array(total[model, pair])], names=["model", "pair", "n"])


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Bits that each pair of characters speaks for a random string: log2 of the ratio of transition probabilities.

    A transition is smoothed by ``_PRIOR`` characters drawn from the model's own characters, so a context that a model never met counts as rare as its characters are.

    At most ``2 * 68 ** 2`` sums reach the driver, whatever the table's size; without samples no pair speaks for either.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = texts.mapInArrow(_counts, "model long, pair long, n long").groupBy("model", "pair").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, _SIZE * _SIZE))
    np.add.at(total, (sums["model"].to_numpy(np.int64), sums["pair"].to_numpy(np.int64)), sums["n"].to_numpy(float))
    total = total.reshape(2, _SIZE, _SIZE)
    single = total.sum(1, keepdims=True) + 0.5
    single /= single.sum(2, keepdims=True)
    odds = np.log2((total + _PRIOR * single) / (total.sum(2, keepdims=True) + _PRIOR))
    return odds[0] - odds[1]


def stretches(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches (first, behind the last) of a sequence, in linear time (Ruzzo and Tompa)."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum behind, first, behind the last, the nearest with a smaller sum before
    total = 0.0
    for k, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, at = k, len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= before:
                at = found[at][4]
            if at < 0 or found[at][1] >= total:
                found.append((before, total, first, k + 1, at))
                break
            before, _, first, _, link = found[at]
            del found[at:]
            at = link
    return [(first, end) for _, _, first, end, _ in found]


def _trimmed(gains: np.ndarray, margin: float, text: str, first: int, end: int) -> tuple[int, int]:
    """The stretch without the parts at its ends, between joins, whose own pairs do not speak for a random string."""
    inner = [k for k in range(first, end) if text[k] in _JOINS]
    parts = [(a, b) for a, b in zip([first, *(k + 1 for k in inner)], [*inner, end]) if b > a]
    speaks = [k for k, (a, b) in enumerate(parts) if b - a > 1 and gains[a : b - 1].mean() > margin]
    return (parts[speaks[0]][0], parts[speaks[-1]][1]) if speaks else (first, end)


def _judged(gains: np.ndarray, margin: float, text: str) -> list[tuple[int, int]]:
    """Places of what is reported of the run ``text``; ``gains`` has the bits of each pair of its neighbours."""
    whole = [(0, len(text))] if len(text) >= _WHOLE and gains.mean() > margin else []
    out: list[tuple[int, int]] = []
    joins = np.array([c in _JOINS for c in text])
    gains = np.where(joins[:-1] | joins[1:], 0.0, gains)
    for first, end in stretches((gains - margin).tolist()):
        if gains[first:end].sum() > _EVIDENCE:
            end += 1
            while first and text[first - 1] not in _JOINS:
                first -= 1
            while end < len(text) and text[end] not in _JOINS:
                end += 1
            first, end = _trimmed(gains, margin, text, first, end)
            if out and first <= out[-1][1]:
                first = out.pop()[0]
            out.append((first, end))
    return out or whole


def _runs(bits: np.ndarray, margin: float, texts: list[str], bases: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """What the models report of each text outside the pattern matches."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    whole = "\n".join([*texts, ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODE[np.minimum(points, 127)], _OUTSIDE)
    for offset, base in zip(offsets.tolist(), bases):
        for start, end, _ in base:
            codes[offset + start : offset + end] = _OUTSIDE
    inside = np.pad(codes != _OUTSIDE, 1)
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if not len(starts):
        return out
    gains = np.where(inside[1:-2] & inside[2:-1], bits[codes[:-1], codes[1:]], 0.0)
    gains = np.append(gains, 0.0)
    sizes = ends - starts
    # No stretch has more than all positive pairs of its run together.
    some = (np.add.reduceat(np.maximum(gains, 0), starts) > _EVIDENCE) | (sizes >= _WHOLE) & (np.add.reduceat(gains, starts) > margin * (sizes - 1) - 1e-6)
    for start, end in zip(starts[some].tolist(), ends[some].tolist()):
        k = int(np.searchsorted(offsets, start, "right")) - 1
        offset = start - int(offsets[k])
        out[k] += [(offset + a, offset + b, "random") for a, b in _judged(gains[start : end - 1], margin, whole[start:end])]
    return out


def _scanned(bits: np.ndarray, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            texts = batch.column("text").to_pylist()
            bases = [base_spans(text) for text in texts]
            for base, more in zip(bases, _runs(bits, margin, texts, bases)):
                named = [f"{kind}:{s}:{e}" for s, e, kind in base]
                order = sorted([(s, i, n) for i, ((s, _, _), n) in enumerate(zip(base, named))] + [(s, len(base), f"{kind}:{s}:{e}") for s, e, kind in more])
                sizes = [sum(kind == x for _, _, kind in base) for x in KINDS]
                out.append((*sizes, len(more), hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(n for _, _, n in order)))
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame, margin: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans: one row per row of ``docs``; null texts are empty."""
    bits = train(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scanned(bits, margin), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
