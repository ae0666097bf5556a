"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes that are no separators. All separators are ASCII, so a byte scan of UTF-8 is exact.
Hashes have 64 bits: a random table value for each byte, weighted by its place, then mixed.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from casemeter.llm.common import utf8

U = np.uint64
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where punctuation is ignored: all ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


#: Scripts written without blanks between words; each of their letters, marks and numbers is a word: Thai and Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Bopomofo, Yi and Han.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # first word of each text, and the number of words


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def split(texts: pa.Array, separators: np.ndarray = SPACES, fold: bool = False) -> Words:
    """Words of every text; ``fold`` hashes A-Z as a-z."""
    data, at = utf8(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U), np.zeros(len(at), np.int64))
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    before[at[:-1][at[:-1] < n]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first & before), np.flatnonzero(last & after) + 1
    values = np.where(separators, U(0), _TABLE)
    if fold:
        values[65:91] = values[97:123]
    weighted = values[data]
    weighted *= _power(_M, n)
    hashes = np.add.reduceat(weighted, starts) * _power(_M_INVERSE, n)[starts] if len(starts) else np.zeros(0, U)
    return Words(data, starts, ends, mix(hashes ^ (ends - starts).astype(U)), np.searchsorted(starts, at))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """By code point: what it is (0 separator, 1 part of a word, 2 a word of its own), its hash value, its case-folded form, and the forms of more than one character.

    Folding is ``upper().casefold()``, so a text and its upper-cased form are the same. Letters, marks and numbers are parts of words.
    """
    kind, fold, longer = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), {}
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] in "LMN":
            kind[point] = 1
        if point < 0x20000 and (folded := char.upper().casefold()) != char:
            if len(folded) == 1:
                fold[point] = ord(folded)
            else:
                longer[point] = folded
    for first, last in ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF)):  # variation selectors
        kind[first : last + 1] = 0
    for first, last in UNSPACED:
        kind[first : last + 1] *= 2
    values = mix(np.arange(0x110000, dtype=U) * U(_M)) | U(1)
    values[:128] = _TABLE[:128]
    values[kind == 0] = 0
    return kind, values, fold, longer


def letters(texts: pa.Array) -> Words:
    """Runs of letters, marks and numbers of every text, without regard to case; single characters where a script has no blanks. Places count folded characters."""
    data, at = utf8(texts)
    if not (data > 127).any():
        return split(texts, PUNCTUATION, fold=True)
    kinds, values, fold, longer = _characters()
    raw = data.tobytes()
    whole = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    wide = {chr(c): f for c, f in longer.items()}
    if odd := {c for c in set().union(*whole) if c in wide}:
        table = str.maketrans({c: wide[c] for c in odd})
        whole = [t.translate(table) if not odd.isdisjoint(t) else t for t in whole]
    at = np.concatenate([[0], np.cumsum([len(t) for t in whole])])
    points = fold[np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)]
    kind = kinds[points]
    inside, alone = kind == 1, kind == 2
    before, after = np.ones(len(points), bool), np.ones(len(points), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    before[at[:-1][at[:-1] < len(points)]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before | alone), np.flatnonzero(inside & after | alone) + 1
    weighted = values[points]
    weighted *= _power(_M, len(points))
    hashes = np.add.reduceat(weighted, starts) * _power(_M_INVERSE, len(points))[starts] if len(starts) else np.zeros(0, U)
    return Words(points, starts, ends, mix(hashes ^ (ends - starts).astype(U)), np.searchsorted(starts, at))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words, by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    part, length, total, used = hashes, 1, np.zeros(n, U), 0
    while True:
        times = U(pow(_STEP, length, 1 << 64))
        if size & length:
            total = total * times + part[used : used + n]
            used += length
        if 2 * length > size:
            return mix(total)
        part = part[:-length] * times + part[length:]
        length *= 2


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def within(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words lie in one text."""
    text = owner(bounds)
    n = max(0, len(text) - size + 1)
    return text[:n] == text[size - 1 : size - 1 + n]
