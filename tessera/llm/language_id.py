"""Language ID by word-first backoff.

Known words score by their log frequency in each language. A word that no
language knows falls back to character n-grams: at each of its characters the
longest known n-gram that begins there, from 4 characters down to 1, scores by
its log frequency, weighed by 1 / n so that a character counts about once.

A word is a run of letters and their combining marks, in lower case; fitting and
scoring cut words by the same test. The model is fitted on at most about
``PER_LANGUAGE`` labelled documents of each language, taken by hash of doc_id:
the documented bound of the classifier. Of these it keeps every word and every
n-gram; every document is scored over its whole text.

Defined results: ``und`` with score 0 for a text that is null, empty or has no
letter, and for all texts if nothing can be learned; a very long text is scored
whole; ties go to the language first by code point; a row without doc_id, text or
lang is no example, but is predicted and not held out; repeated rows give
repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.textcore import U64, Texts, _power_tables, chunks, mix64

PER_LANGUAGE, LONGEST = 3000, 4


def held_out(doc_id: Column) -> Column:
    """Fold 2 of 4 by CRC-32 of the identifier as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter or a combining mark, and whether it is a letter."""
    known, at = np.unique(codes, return_inverse=True)
    kinds = [unicodedata.category(chr(c))[0] for c in known]
    return np.array([k in "LM" for k in kinds], bool)[at], np.array([k == "L" for k in kinds], bool)[at]


def _spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: the runs of marked places, cut at the bounds of texts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    return start, np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1


class CodePoints:
    """Hashes of substrings of an array of code points."""

    def __init__(self, codes: np.ndarray):
        power, self.inverse = _power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(mix64(codes.astype(U64) + U64(1)) * power[: len(codes)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return whole, np.concatenate(([0], np.cumsum([len(x) for x in texts])))


def unit_hashes(units: list[str]) -> np.ndarray:
    codes, bounds = _codes(units)
    return CodePoints(codes).hashes(bounds[:-1], bounds[1:]) if units else np.zeros(0, U64)


@dataclass
class Model:
    """Languages, and for words (0) and n-grams (1..) sorted hashes with log frequencies by language."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    @staticmethod
    def of(counts: pd.DataFrame) -> Model:
        """From (lang, length, unit, n); length 0 marks words."""
        languages = sorted(counts["lang"].unique(), key=lambda x: x.encode())
        model = Model(languages, [], [])
        for length in range(LONGEST + 1):
            part = counts[counts["length"] == length]
            units = sorted(part["unit"].unique())
            table = np.zeros((len(units), len(languages)))
            row, col = {u: i for i, u in enumerate(units)}, {x: i for i, x in enumerate(languages)}
            np.add.at(table, ([row[u] for u in part["unit"]], [col[x] for x in part["lang"]]), part["n"].to_numpy(float))
            table = np.log((table + 0.5) / (table.sum(0) + 0.5 * max(len(units), 1)))
            keys = unit_hashes(units)
            order = np.argsort(keys)
            model.keys.append(keys[order])
            model.logs.append(table[order].astype(np.float32))
        return model

    def find(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the table, and whether it is there."""
        keys = self.keys[length]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def scores(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) summed logs, and the number of words of each text; 0 without a letter."""
        codes, bounds = _codes([t.raw(i).decode("utf-8", "replace").lower() for i in range(len(t))])
        total = np.zeros((len(t), len(self.languages)))
        if not len(codes):
            return total, np.zeros(len(t), np.int64)
        inside, letter = _letters(codes)
        start, end = _spans(inside, bounds)
        owner = np.searchsorted(bounds, start, "right") - 1
        text = CodePoints(codes)

        def add(length: int, at: np.ndarray, who: np.ndarray, weight: float) -> None:
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(who, self.logs[length][at, k] * weight, minlength=len(t))

        at, known = self.find(0, text.hashes(start, end))
        add(0, at[known], owner[known], 1.0)
        # every character of the unknown words, with the end of its word
        size = (end - start)[~known]
        pos = np.repeat(start[~known] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        stop, who = np.repeat(end[~known], size), np.repeat(owner[~known], size)
        for length in range(LONGEST, 0, -1):
            fits = np.flatnonzero(pos + length <= stop)
            at, hit = self.find(length, text.hashes(pos[fits], pos[fits] + length))
            add(length, at[hit], who[fits[hit]], 1.0 / length)
            left = np.ones(len(pos), bool)
            left[fits[hit]] = False
            pos, stop, who = pos[left], stop[left], who[left]
        some = np.diff(np.concatenate(([0], np.cumsum(letter)))[bounds]) > 0
        return total, np.where(some, np.bincount(owner, minlength=len(t)), 0)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for t in chunks(batch.column("text")):
            texts = [t.raw(i).decode("utf-8", "replace").lower() for i in range(len(t))]
            codes, bounds = _codes(texts)
            if not len(codes):
                continue
            whole, (start, end) = "".join(texts), _spans(_letters(codes)[0], bounds)
            first = np.searchsorted(start, bounds).tolist()
            spans = list(zip(start.tolist(), end.tolist(), strict=True))
            for i in range(len(t)):
                counts[langs[t.first + i]].update(whole[a:b] for a, b in spans[first[i] : first[i + 1]])
    for lang, words in counts.items():
        grams: dict[tuple[int, str], int] = defaultdict(int)
        for word, n in words.items():
            for length in range(1, LONGEST + 1):
                for i in range(len(word) - length + 1):
                    grams[length, word[i : i + length]] += n
        rows = [(0, w, n) for w, n in words.items()] + [(k, g, n) for (k, g), n in grams.items()]
        for i in range(0, len(rows), 50_000):
            length, unit, n = zip(*rows[i : i + 50_000], strict=True)
            columns = [pa.array([lang] * len(unit)), pa.array(length, pa.int32()), pa.array(unit), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "length", "unit", "n"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of (doc_id, text, lang) rows without nulls; None without rows."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts = sample.select("lang", "text").mapInArrow(_count_units, "lang string, length int, unit string, n long")
    counts = counts.groupBy("lang", "length", "unit").agg(F.sum("n").alias("n")).toArrow()
    return Model.of(counts.to_pandas()) if len(counts) else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from doc_id and text alone."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for t in chunks(batch.column("text")):
                names, sure = np.full(len(t), "und", object), np.zeros(len(t))
                if model:
                    total, n = model.scores(t)
                    best = total.argmax(1)
                    scaled = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                    names = np.where(n > 0, np.array(model.languages, object)[best], "und")
                    sure = np.where(n > 0, 1.0 / np.exp(scaled).sum(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.first, len(t)), pa.array(names, pa.string()), pa.array(sure)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted outside the held-out fold, predicted for all."""
    labelled = docs.select("doc_id", "text", "lang").dropna().where(~held_out(F.col("doc_id")))
    return identify(docs, fit(labelled)).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
