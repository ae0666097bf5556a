"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe its characters and words, those of the lines before and after it, and whether it repeats in its document.
Only documents are labelled, so the labels of the lines are latent: in training, the lines of a document are inferred under the condition that the
length-weighted share of good lines is expected to agree with the document's label (a multiplier for each document biases its lines until it does), and the field
is fitted to what is inferred. A good document may have bad lines and the other way round. Forward-backward gives each line's probability of being good;
weighted by line length these make the document's score, which a logistic fit on the same training rows maps to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casemeter.llm.common import slices, utf8
from casemeter.llm.words import SPACES, split

_BASIC = 17
#: Lines whose features are standardised at a time.
_SLICE = 1 << 14
#: What the driver holds of a line in training: features and length.
_LINE_BYTES = 4 * _BASIC + 8
#: Share of good lines, by length, that a good document's lines are expected to reach and a bad one's not to pass; and the multiplier's range.
_SHARE = (0.6, 0.4)
_MOST = 6.0


class Model(NamedTuple):
    mean: np.ndarray  # of a line's own features
    scale: np.ndarray
    weights: np.ndarray  # features of the line, the one before and the one after x 2 states
    moves: np.ndarray  # from state x to state
    slope: float
    shift: float


class Lines(NamedTuple):
    features: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray  # first line of each document, and the number of lines


def _classes() -> np.ndarray:
    table = np.zeros((10, 256), np.int32)
    table[0, [*range(65, 91), *range(97, 123)]] = 1
    table[1, 48:58] = 1
    table[2, 65:91] = 1
    table[3, 128:] = 1
    table[4] = SPACES
    for k, signs in enumerate((".,", "|", "#$%&*@^~", "<>{}[]()=/\\_", "!?;:'\"-"), 5):
        table[k, [ord(c) for c in signs]] = 1
    return table


_TABLE = _classes()


def lines(texts: pa.Array) -> Lines:
    """Features of each line of each text. An empty text is one empty line."""
    data, at = utf8(texts)
    n = len(data)
    breaks = np.flatnonzero(data == 10) + 1
    # A line starts at each text and behind each line break inside it.
    starts = np.concatenate((at[:-1], breaks))
    owner = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, breaks - 1, "right") - 1))
    inside = np.concatenate((np.ones(len(at) - 1, bool), breaks < at[np.minimum(owner[len(at) - 1 :] + 1, len(at) - 1)]))
    starts, owner = starts[inside], owner[inside]
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(at)))
    ends = np.append(starts[1:], n)
    last = bounds[1:] - 1
    ends[last] = at[1:]
    lengths = ends - starts
    size = np.maximum(lengths, 1).astype(float)
    columns = [np.log1p(lengths), lengths == 0]
    for row in _TABLE:
        sums = np.concatenate(([0], np.cumsum(row[data], dtype=np.int64)))
        columns.append((sums[ends] - sums[starts]) / size)
    words = split(texts)
    first, final = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    count = final - first
    spread = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    columns += [np.log1p(count), (spread[final] - spread[first]) / np.maximum(count, 1) / 10]
    same = np.zeros(max(len(words.starts), 1), np.int64)
    same[1 : len(words.starts)] = words.hashes[1:] == words.hashes[:-1] if len(words.starts) else 0
    runs = np.concatenate(([0], np.cumsum(same)))
    columns.append((runs[final] - runs[np.minimum(first + 1, final)]) / np.maximum(count, 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes, dtype=np.uint64)))
    key = np.lexsort((sums[final] - sums[first], owner))
    digest = (sums[final] - sums[first])[key]
    twin = (digest[1:] == digest[:-1]) & (owner[key][1:] == owner[key][:-1])
    again = np.zeros(len(starts), bool)
    again[key[1:][twin]] = True
    again[key[:-1][twin]] = True
    columns += [again & (lengths > 0), np.ones(len(starts))]
    basic = np.stack([np.asarray(c, float) for c in columns], 1)
    assert basic.shape[1] == _BASIC
    return Lines(basic, lengths, bounds)


def _line_scores(model: Model, have: Lines) -> np.ndarray:
    """Scores of both states for each line: its own features, and those of its neighbours, which have none beyond the ends of a document.

    The neighbours' shares are products moved by a line, so no feature is stored three times.
    """
    own, before, after = model.weights[:_BASIC], model.weights[_BASIC : 2 * _BASIC], model.weights[2 * _BASIC :]
    out = np.empty((len(have.lengths), 2))
    ahead, behind = np.empty_like(out), np.empty_like(out)
    for at in range(0, len(out), _SLICE):
        x = (have.features[at : at + _SLICE] - model.mean) / model.scale
        out[at : at + _SLICE], ahead[at : at + _SLICE], behind[at : at + _SLICE] = x @ own, x @ before, x @ after
    inner = np.ones(len(out), bool)
    inner[have.bounds[:-1]] = False
    inner = np.flatnonzero(inner)
    out[inner] += ahead[inner - 1]
    out[inner - 1] += behind[inner]
    return out


def _weight_sums(model: Model, have: Lines, error: np.ndarray) -> np.ndarray:
    """The gradient of the weights where each line's scores are off by ``error``."""
    inner = np.ones(len(error), bool)
    inner[have.bounds[:-1]] = False
    inner = np.flatnonzero(inner)
    ahead, behind = np.zeros_like(error), np.zeros_like(error)
    ahead[inner - 1], behind[inner] = error[inner], error[inner - 1]
    total = np.zeros_like(model.weights)
    for at in range(0, len(error), _SLICE):
        x = (have.features[at : at + _SLICE] - model.mean) / model.scale
        part = slice(at, at + _SLICE)
        total += x.T.dot(np.hstack((error[part], ahead[part], behind[part]))).reshape(_BASIC, 3, 2).transpose(1, 0, 2).reshape(-1, 2)
    return total


def _padded(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents in groups of like length: their numbers and their line places, -1 behind the end. Groups hold at most 200,000 cells or one document."""
    count = np.diff(bounds)
    order = np.argsort(count, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and count[order[stop]] * (stop + 1 - at) <= 200_000:
            stop += 1
        group = order[at:stop]
        place = bounds[group][:, None] + np.arange(count[group].max())
        yield group, np.where(place < bounds[group + 1][:, None], place, -1)
        at = stop


def forward_backward(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line, summed marginals of moves, and the sum of the documents' log partition functions."""
    marginal, pairs, total = np.zeros_like(scores), np.zeros((2, 2)), 0.0
    step = np.exp(moves)
    for _, place in _padded(bounds):
        live = place >= 0
        s = np.where(live[:, :, None], scores[place], 0.0)
        top = s.max(2, keepdims=True)
        e = np.exp(s - top)
        width = place.shape[1]
        a, b, norm = np.zeros_like(e), np.ones_like(e), np.ones(place.shape)
        a[:, 0] = e[:, 0]
        for t in range(width):
            if t:
                a[:, t] = (a[:, t - 1] @ step) * e[:, t]
                a[~live[:, t], t] = a[~live[:, t], t - 1]
            norm[:, t] = np.where(live[:, t], a[:, t].sum(1), 1.0)
            a[:, t] /= a[:, t].sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            back = (e[:, t + 1] * b[:, t + 1]) @ step.T / norm[:, t + 1][:, None]
            b[:, t] = np.where(live[:, t + 1][:, None], back, 1.0)
        g = a * b
        marginal[place[live]] = (g / g.sum(2, keepdims=True))[live]
        on = live[:, 1:]
        ahead = e[:, 1:] * b[:, 1:] / norm[:, 1:, None]
        pairs += np.einsum("dti,dtj->ij", np.where(on[:, :, None], a[:, :-1], 0), np.where(on[:, :, None], ahead, 0)) * step
        total += float((np.log(norm) + np.where(live, top[:, :, 0], 0)).sum())
    return marginal, pairs, total


def _fit_line(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Logistic fit of one input by Newton steps, with a small ridge."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((p - y) * share * x).sum() + 1e-3 * slope, ((p - y) * share).sum()])
        v = p * (1 - p) * share
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(d[0], -2, 2)), shift - float(np.clip(d[1], -2, 2))
    return slope, shift


def document_scores(model: Model, have: Lines) -> np.ndarray:
    """Length-weighted mean of the lines' log odds of being good, from the marginals."""
    marginal, _, _ = forward_backward(_line_scores(model, have), model.moves, have.bounds)
    good = np.clip(marginal[:, 1], 1e-6, 1 - 1e-6)
    weight = have.lengths + 1.0
    return np.add.reduceat(np.log(good / (1 - good)) * weight, have.bounds[:-1]) / np.add.reduceat(weight, have.bounds[:-1])


def line_labels(model: Model, texts: pa.Array) -> list[np.ndarray]:
    """The probability of being good of each line of each text."""
    have = lines(texts)
    marginal, _, _ = forward_backward(_line_scores(model, have), model.moves, have.bounds)
    return np.split(marginal[:, 1], have.bounds[1:-1])


def fit(have: Lines, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Model:
    """Adam steps on the sample's likelihood with latent line labels; each line counts once.

    A round infers the lines twice: freely, and with each document's multiplier added to the score of good. The difference of the two is the gradient.
    The multiplier starts at the document's label and follows the gap between the expected share of good lines and the one the label asks for;
    it never turns against the label.
    """
    width = 3 * _BASIC
    if not len(labels) or labels.min() == labels.max():
        only = 0.0 if not len(labels) else (5.0 if labels[0] else -5.0)
        return Model(np.zeros(_BASIC), np.ones(_BASIC), np.zeros((width, 2)), np.zeros((2, 2)), 0.0, only)
    mean, scale = have.features.mean(0, dtype=float), have.features.std(0, dtype=float)
    mean[scale == 0], scale[scale == 0] = 0.0, 1.0
    count, first = np.diff(have.bounds), have.bounds[:-1]
    sign = np.where(labels == 1, 1.0, -1.0)
    weight = have.lengths + 1.0
    weight /= np.repeat(np.add.reduceat(weight, first), count)
    model = Model(mean, scale, np.zeros((width, 2)), np.zeros((2, 2)), 1.0, 0.0)
    bias = 1.5 * sign
    m = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    v = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    for t in range(1, rounds + 1):
        scores = _line_scores(model, have)
        free, pairs, _ = forward_backward(scores, model.moves, have.bounds)
        scores[:, 1] += np.repeat(bias, count)
        bound, seen, _ = forward_backward(scores, model.moves, have.bounds)
        share = np.add.reduceat(bound[:, 1] * weight, first)
        gap = np.where(labels == 1, _SHARE[0] - share, share - _SHARE[1])
        bias = sign * np.clip(sign * bias + gap, 0, _MOST)
        grads = (_weight_sums(model, have, free - bound) / len(free) + ridge * model.weights, (pairs - seen) / len(free) + ridge * model.moves)
        for k, (value, grad) in enumerate(zip((model.weights, model.moves), grads)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            value -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    slope, shift = _fit_line(document_scores(model, have), labels.astype(float), np.ones(len(labels)))
    return model._replace(slope=slope, shift=shift)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and lengths of the lines of each document, in bytes."""
    for batch in slices(batches, "text"):
        if not batch.num_rows:
            continue
        have = lines(batch.column("text"))
        part = lambda x: [x[a:b].tobytes() for a, b in zip(have.bounds[:-1], have.bounds[1:])]
        data = [pa.array(part(x), pa.binary()) for x in (have.features.astype(np.float32), have.lengths.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *data], names=["id", "label", "features", "lengths"])


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 4_000, max_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``max_documents`` labelled documents of whole text, by the order of a digest of their id, and as many of them as ``max_bytes`` holds, where a
    document counts its bytes and ``_LINE_BYTES`` for each line: one that would pass the bound is left out and shorter ones after it still come in.

    Only ids are ordered; tasks make the features of the chosen, and the driver gets those and no text. Documents with crc32(id) % 3 = 1 never train.
    Null labels and null ids do not train; of several labels of one id the largest counts.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(whole) + _LINE_BYTES * (1 + F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))))
    ids = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("bytes")).where(~held_out("id") & F.col("id").isNotNull())
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    order = F.md5(F.concat(F.lit("fit"), F.col("id").cast("string")))
    picks = ids.groupBy("id").agg(F.min("bytes").alias("bytes")).join(marks, "id").orderBy(order).limit(max_documents).collect()
    chosen, used = [], 0
    for pick in picks:
        if used + pick["bytes"] <= max_bytes:
            chosen.append((pick["id"], pick["label"]))
            used += pick["bytes"]
    none = Lines(np.zeros((0, _BASIC), np.float32), np.zeros(0, np.int64), np.zeros(1, np.int64))
    if not chosen:
        return fit(none, np.zeros(0, int))
    table = docs.sparkSession.createDataFrame(chosen, "id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(table), "id")
    texts = texts.groupBy("id").agg(F.min_by("label", F.octet_length("text")).alias("label"), F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text"))
    rows = texts.mapInArrow(_line_rows, "id long, label int, features binary, lengths binary").toPandas().sort_values("id")
    lengths = [np.frombuffer(x, np.int64) for x in rows["lengths"]]
    features = np.frombuffer(b"".join(rows.pop("features")), np.float32).reshape(-1, _BASIC)
    have = Lines(features, np.concatenate(lengths), np.concatenate([[0], np.cumsum([len(x) for x in lengths])]))
    return fit(have, rows["label"].to_numpy())


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``. Null texts are empty; a null id is not held out. Nothing is shuffled."""

    def run(batches):
        for batch in slices(batches, "text"):
            if batch.num_rows:
                z = model.slope * document_scores(model, lines(batch.column("text"))) + model.shift
                yield batch.select(["doc_id"]).append_column("score", pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model takes for good, with their columns. The stage's own mark may not be a column of ``docs``."""
    from pyspark.sql.types import StructType

    def run(batches):
        for batch in slices(batches, text_col):
            if batch.num_rows:
                z = model.slope * document_scores(model, lines(batch.column(text_col))) + model.shift
                yield batch.filter(pa.array(z >= 0))

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)))
