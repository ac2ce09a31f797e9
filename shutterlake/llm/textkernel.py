"""Vectorised tokenising and hashing of Arrow string columns, for use inside tasks.

A batch of texts is one byte array with offsets, as Arrow holds it. Words are found, hashed and combined to
windows with a fixed number of NumPy passes per byte; no Python object is made for a word. Work goes in
slices of about SLICE bytes so that the temporaries stay in cache whatever the batch holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, PIECE = 1 << 19, 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_MUL = 0x9E3779B97F4A7C15
#: Places of a run that have their own random numbers; further ones take these times a random factor per PLACES.
PLACES = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def _numbers(seed: int) -> np.ndarray:
    """A random number for every place (row) and byte (column)."""
    with np.errstate(over="ignore"):
        return mix((np.arange(PLACES * 256, dtype=_U) + _U(seed << 32)) * _U(_MUL)).reshape(PLACES, 256)


_LINE = _numbers(1)
_LINE[:, 10] = 0
_EXACT = _numbers(2)
_EXACT[:, SPACE] = 0
_FOLDED = _EXACT[:, LOWER]


def run_sums(table: np.ndarray, data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per run of bytes, from one start to the next, the sum of the numbers of its (place, byte) pairs modulo 2^64.

    The numbers are independent of one another, so two different runs have equal sums with probability 2^-64 whatever
    they hold; a polynomial in the bytes has sequences that collide for every base. The work goes in pieces of whole runs."""
    out = np.empty(len(start), _U)
    stop = np.append(start[1:], len(data))
    flat, lo = table.ravel(), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + PIECE, "right")))
        a, b = start[lo], stop[hi - 1]
        own = start[lo:hi] - a
        place = np.arange(b - a, dtype=np.int64) - np.repeat(own, stop[lo:hi] - start[lo:hi])
        value = flat[(place & (PLACES - 1)) << 8 | data[a:b]]
        if (stop[lo:hi] - start[lo:hi]).max() > PLACES:
            turn = place >> 6
            value *= np.append(_U(1), mix(np.arange(1, turn.max() + 1, dtype=_U) * _U(_MUL)) | _U(1))[turn]
        out[lo:hi] = np.add.reduceat(value, own)
        lo = hi
    return out


@dataclass
class Words:
    """Words of a slice of texts; of[d]:of[d + 1] are those of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes; fold: A-Z count as a-z."""
        if not len(self.start):
            return np.zeros(0, _U)
        return mix(run_sums(_FOLDED if fold else _EXACT, self.data, self.start) + (self.end - self.start).astype(_U))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts of about size bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def windows(h: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of size consecutive words within one text."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    first = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    return first, window_at(h, first, size)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(_MUL) + b)


def window_at(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size words from each position on: of halves, quarters and so on, mixed at each step."""
    if not len(first):
        return np.zeros(0, _U)
    out, at, runs, length = None, first, h, 1
    while True:
        if size & length:
            out = runs[at] if out is None else _join(out, runs[at])
            at = at + length
        if 2 * length > size:
            return out
        runs = _join(runs[:-length], runs[length:])
        length *= 2


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags are set between each pair of offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, has a word) of every line, as split at \\n."""
    n = len(data)
    cuts = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    start = start[start < n]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool)
    stop = np.append(start[1:], n)
    h = run_sums(_LINE, data, start)
    length = stop - start - (data[stop - 1] == 10)
    text = np.searchsorted(offsets, start, "right") - 1
    return text, mix(h + length.astype(_U)), np.add.reduceat((~SPACE[data]).astype(np.int64), start) > 0


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(h.view(np.int64))


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case by Unicode; ss stands for sharp s, and one sigma for both, as upper case has them. Bytes that are no UTF-8 are replaced."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    try:
        column = pc.utf8_lower(column)
    except pa.ArrowInvalid:
        texts = [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.large_binary()).to_pylist()]
        column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    for old, new in (("ß", "ss"), ("ς", "σ")):
        column = pc.replace_substring(column, old, new)
    return column


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, digit or mark; those from 0x20000 on count as letters."""
    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x20000)] + [True])


def bare(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words without the punctuation and symbols at their ends; words of nothing else stay whole."""
    letters = _letters()
    inside = letters[data & 127] & (data < 128)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (b[lead + k] for k in range(4))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        two, three = (b0 & 31) << 6 | b1 & 63, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63
        code = np.select([size == 2, size == 3], [two, three], (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)
        ok = letters[np.minimum(code, len(letters) - 1)]
        for k in range(4):
            at = lead[ok & (size > k)] + k
            inside[at[at < len(data)]] = True
    w = words(data, offsets)
    kept = np.flatnonzero(inside)
    first, last = np.searchsorted(kept, w.start), np.searchsorted(kept, w.end) - 1
    has = last >= first
    start, end = w.start.copy(), w.end.copy()
    start[has], end[has] = kept[first[has]], kept[last[has]] + 1
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    return Words(np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, data, np.uint8(0x20)), offsets, start, end, w.of)
