"""Whole-array text primitives for Arrow batches.

A batch of texts is one byte array plus offsets; words, their 64-bit hashes and
hashes of word n-grams are computed for the whole array at once. Work is cut
into chunks of about ``CHUNK`` bytes, so memory is bounded by that or by the
longest single text. Texts are never truncated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64
_SPACES = b" \t\n\x0b\x0c\r"


def lut(chars: bytes) -> np.ndarray:
    """A boolean for each byte value."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


SPACE = lut(_SPACES)
#: White space, ASCII punctuation and other ASCII controls: what separates letters and digits.
NON_ALNUM = lut(bytes(c for c in range(128) if not chr(c).isalnum()))
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hashes of any substrings of a byte array in constant time each."""

    def __init__(self, data: np.ndarray, fold: np.ndarray = SAME):
        n = len(data)
        self.power, self.inverse = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[fold[data]] * self.power[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Texts ``first`` .. of a batch: bytes, and the byte bounds of each."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """The texts of an Arrow string column in chunks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        part = bounds[lo : hi + 1]
        yield Texts(lo, data[part[0] : part[-1]], part - part[0])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte bounds, and for each text its range of words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(t: Texts, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, inside each text."""
    n = len(t.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64))
    inside = ~separator[t.data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = t.bounds[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.bounds))


#: Blocks of scripts that don't put spaces between words; a character of theirs is a word.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF)]


_known_kinds: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point below 65536: 0 separates words, 1 is part of one, 2 is one."""
    if not _known_kinds:
        kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(1 << 16)), np.uint8, 1 << 16)
        for low, high in UNSPACED:
            kinds[low : high + 1] *= 2
        _known_kinds.append(kinds)
    return _known_kinds[0]


#: Kind of each byte that is a character; others count as letters until their character is known.
_ASCII_KIND = np.where(NON_ALNUM, 0, 1).astype(np.uint8)


def _kind_of_bytes(data: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to; ``high`` are the places of bytes from 128 on."""
    kind = _ASCII_KIND[data]
    at = high[data[high] >= 0xC0]  # first bytes of the longer characters
    first = data[at].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    tail = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    code = (first & 0x1F) << 6 | tail[0]
    code = np.where(size == 3, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], code)
    code = np.where(size == 4, (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], code)
    own = _kinds()[np.minimum(code, 0xFFFF)]
    # beyond the first plane: ideographs from 0x20000 on, pictures in 0x1Fxxx, else old scripts
    far = code > 0xFFFF
    own[far] = np.where(code[far] >= 0x20000, 2, np.where(code[far] >> 12 == 0x1F, 0, 1))
    for k in range(4):
        some = size > k
        kind[at[some] + k] = own[some]
    return kind


def units(t: Texts) -> Words:
    """Runs of letters, digits and marks inside each text; in scripts without spaces every character is one."""
    high = np.flatnonzero(t.data >= 128)
    if not len(high):
        return words(t, NON_ALNUM)
    kind = _kind_of_bytes(t.data, high)
    inside = kind > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    alone = np.flatnonzero(kind == 2)
    if len(alone):
        head = alone[(t.data[alone] & 0xC0) != 0x80]
        opens[head] = True
        # what follows such a character begins anew
        after = alone[(alone + 1 < len(kind))] + 1
        after = after[((t.data[after] & 0xC0) != 0x80) & inside[after]]
        opens[after] = True
    bounds = t.bounds[:-1][t.bounds[:-1] < len(t.data)]
    opens[bounds] = inside[bounds]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    edge = t.bounds[1:-1]
    edge = edge[edge > 0] - 1
    closes[edge] |= inside[edge]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, t.bounds))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that begins at each word, and whether it ends in the same text.

    The arrays have one place for each word; places where no whole n-gram begins
    are marked False.
    """
    total = len(hashes)
    whole = np.ones(total, bool)
    for back in range(1, n):
        at = first[1:] - back
        whole[at[at >= first[:-1]]] = False
    out = np.zeros(total, U64)
    span = max(total - n + 1, 0)
    factor = 0x9E3779B97F4A7C15
    for k in range(n):
        out[:span] += hashes[k : k + span] * U64(pow(factor, 2 * k + 1, 1 << 64))
    whole[span:] = False
    return mix64(out + U64(n)), whole
