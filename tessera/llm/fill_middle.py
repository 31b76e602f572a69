"""Fill-in-the-middle texts: each document is cut at two token bounds and its middle moved to the end.

Method: succinct rank and select. A chunk of texts is one array of bytes. The
bytes that begin a token, and those that begin a character, are two packed bit
vectors; for each, a directory holds the number of ones before every block of
``BLOCK`` bytes. The ones of a text give its number of tokens, a select on two
ranks gives the bytes to cut at, and a rank in the other vector turns those into
characters. No token is ever built.

A token is a run of ASCII letters, or one other character. Where a text is cut
and in which form it is written depend on its doc_id alone, so reruns and other
partitionings give the same. There is no shuffle and no state: a lost executor
costs its own partitions.

Defined results: a null text is empty, and an empty text stays plain; a null
doc_id draws as an empty one; rows with the same doc_id draw alike; very long
texts are read whole, a chunk of their own; empty tables give an empty result;
further columns of ``docs`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.textcore import chunks, lut

#: Bytes of a block of the directory.
BLOCK = 64
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
LETTER = lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Ones of each byte, and of its lowest 0 to 7 bits.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)
BELOW = (1 << np.arange(8)) - 1


class BitVector:
    """A packed vector of bits with the number of ones before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        blocks = len(packed) // BLOCK + 1
        self.packed = np.zeros(blocks * BLOCK, np.uint8)
        self.packed[: len(packed)] = packed
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(ONES[self.packed].reshape(blocks, BLOCK).sum(1), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of the places ``at``."""
        byte = at >> 3
        block = byte // BLOCK
        inside = ONES[self.packed[block[:, None] * BLOCK + np.arange(BLOCK)]]
        whole = (inside * (np.arange(BLOCK) < (byte % BLOCK)[:, None])).sum(1)
        return self.before[block] + whole + ONES[self.packed[byte] & BELOW[at & 7]]

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has ``k`` ones before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        inside = ONES[self.packed[block[:, None] * BLOCK + np.arange(BLOCK)]].cumsum(1)
        rest = k - self.before[block]
        byte = (inside <= rest[:, None]).sum(1)
        rest = rest - np.where(byte > 0, inside[np.arange(len(k)), byte - 1], 0)
        byte = block * BLOCK + byte
        bits = np.unpackbits(self.packed[byte][:, None], axis=1, bitorder="little").cumsum(1)
        return byte * 8 + (bits <= rest[:, None]).sum(1)


def boundaries(data: np.ndarray, bounds: np.ndarray) -> tuple[BitVector, BitVector]:
    """Where the tokens and the characters of texts begin, whose bytes are bounded by ``bounds``."""
    head = (data & 0xC0) != 0x80
    letter = LETTER[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[bounds[:-1][bounds[:-1] < len(data)]] = False
    return BitVector(head & ~inner), BitVector(head)


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of a doc_id: the first hex digits of a SHA-256, eight each."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _transform(sentinels: tuple[str, str, str], plain: int, spm: int):
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
            for t in chunks(batch.column("text")):
                own = slice(t.first, t.first + len(t))
                tokens, characters = boundaries(t.data, t.bounds)
                before = tokens.rank(t.bounds)
                n = np.diff(before)
                first, second = h[0][own] % (n + 1), h[1][own] % (n + 1)
                cuts = []
                for k in (np.minimum(first, second), np.maximum(first, second)):
                    cut = t.bounds[1:].copy()
                    inside = k < n
                    cut[inside] = tokens.select((before[:-1] + k)[inside])
                    cuts.append(cut)
                chars = [characters.rank(x) for x in (t.bounds[:-1], *cuts)]
                forms, outputs = [], []
                keep = h[2][own] % 100 >= plain
                suffix_first = h[3][own] % 100 < spm
                for i in range(len(t)):
                    text, lo = t.raw(i), int(t.bounds[i])
                    a, b = int(cuts[0][i]) - lo, int(cuts[1][i]) - lo
                    if keep[i] or not text or p in text or s in text or m in text:
                        forms.append("plain")
                        outputs.append(text)
                    elif suffix_first[i]:
                        forms.append("spm")
                        outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
                as_is = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(t.first, len(t)),
                        pa.array(n, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(chars[1] - chars[0], pa.int64(), mask=as_is),
                        pa.array(chars[2] - chars[1], pa.int64(), mask=as_is),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    Of a hundred documents ``100 - plain_from`` stay plain, and of the others
    ``spm_below`` in a hundred have the suffix first. A text that contains a
    sentinel stays plain, so that every output can be undone.
    """
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(doc_id, seed))])
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_transform(sentinels, plain_from, spm_below), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output: what stands behind the three sentinels, put in order."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
