"""Quality rules: counts inside a document, and lines that many documents of a host share.

Lines are normalised and hashed together with their host. A line is above the
limit if more distinct documents of the host than ``max(min_docs, share of the
host's documents)`` contain it. Such lines are removed from all documents, and a
document that loses more than ``depleted`` of its words is rejected, as is one
that fails the base rules. ``judge`` gives the counts and the verdict,
``clean_documents`` the kept documents with those lines cut from their text.

Scale: texts are never shuffled. A document gives each of its lines once, so the
documents of a line are a count that is combined before the shuffle, however many
have it. Lines are cut in one pass over the documents, with the table of lines
above the limit broadcast; only beyond ``BROADCAST_LINES`` of them is each row
joined to its own.

Defined results: a null or empty text has no words and fails the base rules; a
very long text is read whole, in one chunk; a null host is a host of its own;
each row is a document, judged by its own text: repeated rows, rows without
doc_id and different texts under one doc_id alike; an empty table gives an empty
result; extra columns are ignored by ``judge`` and kept by ``clean_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_row, durable, keyed
from tessera.llm.textcore import SPACE, Prefix, Texts, Words, chunks, grams, lut, words

_SPACES, _DIGITS = b" \t\n\x0b\x0c\r", re.compile(rb"[0-9]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Lines above the limit up to which they are broadcast: 8 bytes each.
BROADCAST_LINES = 1_000_000

STATS = (
    "row long, doc_id long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " lines array<long>, line_words array<int>"
)


def _covered(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word lies in an 8-word window that its text has at least twice."""
    total = len(hashes)
    out = np.zeros(total, bool)
    gram, whole = grams(hashes, first, WINDOW)
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    # the text's number goes into the hash, so that one sort serves the chunk
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))[at]
    keyed = gram[at] ^ (owner + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = at[order[twice]]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def host_hash(host: str | None) -> int:
    """Unsigned 64-bit hash of a host; null is one of its own."""
    return xxhash.xxh64_intdigest(b"h" + host.encode() if host is not None else b"n")


def line_hash(host: int, norm: bytes) -> int:
    """Signed 64-bit hash of a host's hash and a normalised line."""
    return xxhash.xxh64_intdigest(norm, host) - (1 << 63)


def _normal(line: bytes) -> list[bytes]:
    """The words of a line's normal form."""
    return _DIGITS.sub(b"0", line.lower()).split()


def _repeats(t: Texts, w: Words) -> np.ndarray:
    """Words of each text that lie in a repeated window."""
    repeat = _covered(Prefix(t.data).hashes(w.start, w.end), w.first)
    return np.diff(np.concatenate(([0], np.cumsum(repeat)))[w.first])


def _base_failed(n_words, n_repeat_words):
    """Of columns or arrays."""
    return (n_words < 20) | (n_repeat_words * 100 > n_words * 30)


def _stats(min_words: int):
    symbol = lut(SYMBOLS.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_hash(h) for h in batch.column("host").to_pylist()]
            for t in chunks(batch.column("text")):
                w = words(t)
                starts_char = (t.data & 0xC0) != 0x80
                per_doc = lambda flag, t=t: np.diff(np.concatenate(([0], np.cumsum(flag)))[t.bounds])
                dups, ends, lines, sizes = [], [0], [], []
                for i in range(len(t)):
                    found = [x for x in t.raw(i).split(b"\n") if x.strip(_SPACES)]
                    dups.append(len(found) - len(set(found)))
                    own: dict[int, int] = {}
                    for x in found:
                        parts = _normal(x)
                        if len(parts) >= min_words:
                            h = line_hash(hosts[t.first + i], b" ".join(parts))
                            own[h] = own.get(h, 0) + len(parts)
                    lines += own
                    sizes += own.values()
                    ends.append(len(lines))
                ends = pa.array(ends, pa.int32())
                place = slice(t.first, t.first + len(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(t.first, len(t)),
                        batch.column("doc_id").slice(t.first, len(t)),
                        pa.array([h - (1 << 63) for h in hosts[place]], pa.int64()),
                        *map(pa.array, (np.diff(w.first), per_doc(starts_char & ~SPACE[t.data]), per_doc(symbol[t.data]))),
                        pa.array(dups, pa.int64()),
                        pa.array(_repeats(t, w)),
                        pa.ListArray.from_arrays(ends, pa.array(lines, pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(sizes, pa.int32())),
                    ],
                    names=[x.split()[0] for x in STATS.split(",")],
                )

    return run


def document_stats(docs: DataFrame, min_words: int = 3) -> DataFrame:
    """Counts of each row from its whole text, and its distinct lines of ``min_words`` words or more with all their words.

    A line is kept as a hash of its host and its normal form: ASCII letters in
    lower case, runs of digits as 0, white space as single spaces, trimmed.
    ``row`` is a number of the row's own; the result is written, so that it stays.
    """
    row = F.monotonically_increasing_id().alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), "text")
    return durable(rows.mapInArrow(_stats(min_words), STATS), "line-stats")


def frequent_lines(stats: DataFrame, min_docs: int = 20, share: float = 0.02) -> DataFrame:
    """(line) of the lines above the limit."""
    lines = stats.select("host", F.explode("lines").alias("line")).groupBy("line")
    spread = lines.agg(F.min("host").alias("host"), F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = stats.groupBy("host").agg(F.count("*").alias("host_docs"))
    return durable(spread.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * share).select("line"), "lines-above")


def judge(docs: DataFrame, depleted: float = 0.5, **limits) -> DataFrame:
    """The counts of every document, base_failed, lost_words and kept."""
    stats = document_stats(docs)
    above = frequent_lines(stats, **limits)
    above = F.broadcast(above) if above.count() <= BROADCAST_LINES else above
    lines = stats.select("row", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lost = lines.select("row", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")).join(above, "line")
    lost = lost.groupBy("row").agg(F.sum("words").alias("lost_words"))
    rows = stats.drop("host", "lines", "line_words").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = _base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (F.col("lost_words") <= F.col("n_words") * depleted)).drop("row")


def _cleaned(shared, extra: str | None, columns: list[str], min_words: int, depleted: float):
    """The rows kept, without their lines above the limit: those of ``shared``, or else of the column ``extra``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = shared.value if shared else np.zeros(0, np.int64)
        for batch in batches:
            hosts = [host_hash(h) for h in batch.column("source").to_pylist()]
            at, texts, sizes = [], {}, {}
            for t in chunks(batch.column("text")):
                w = words(t)
                n_words = np.diff(w.first)
                fine = np.flatnonzero(~_base_failed(n_words, _repeats(t, w)))
                lines, size, owner, place = [], [], [], []
                pieces = {i: t.raw(i).split(b"\n") for i in fine.tolist()}
                for i, found in pieces.items():
                    for k, x in enumerate(found):
                        parts = _normal(x)
                        if len(parts) >= min_words:
                            lines.append(line_hash(hosts[t.first + i], b" ".join(parts)))
                            size.append(len(parts))
                            owner.append(i)
                            place.append(k)
                lines, size, owner = np.array(lines, np.int64), np.array(size, np.int64), np.array(owner, np.int64)
                if extra is None:
                    spot = np.minimum(np.searchsorted(above, lines), max(len(above) - 1, 0))
                    cut = above[spot] == lines if len(above) else np.zeros(len(lines), bool)
                else:
                    own = {i: set(batch.column(extra)[t.first + i].as_py() or ()) for i in pieces}
                    cut = np.array([x in own[i] for i, x in zip(owner.tolist(), lines.tolist(), strict=True)], bool)
                lost = np.zeros(len(t), np.int64)
                np.add.at(lost, owner[cut], size[cut])
                gone = {}
                for j in np.flatnonzero(cut).tolist():
                    gone.setdefault(int(owner[j]), set()).add(place[j])
                for i, found in pieces.items():
                    if lost[i] <= n_words[i] * depleted:
                        at.append(t.first + i)
                        if i in gone:
                            text = b"\n".join(x for k, x in enumerate(found) if k not in gone[i]).decode()
                            texts[at[-1]], sizes[at[-1]] = text, len(text)
            out = []
            for name in columns:
                column, new = batch.column(name).take(pa.array(at, pa.int64())), {"text": texts, "n_chars": sizes}.get(name)
                if new:
                    column = pa.array([new.get(i, x) for i, x in zip(at, column.to_pylist(), strict=True)], column.type)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return run


def clean_documents(docs: DataFrame, depleted: float = 0.5, min_words: int = 3, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, their text without the lines above the limit, ``n_chars`` that of a cut text."""
    names, schema = docs.columns, docs.schema
    rows = keyed(docs) if (above := frequent_lines(document_stats(docs, min_words), **limits)).count() > BROADCAST_LINES else None
    if rows is None:
        lines = above.orderBy("line").toArrow()["line"].combine_chunks().to_numpy(zero_copy_only=False)
        return docs.mapInArrow(_cleaned(docs.sparkSession.sparkContext.broadcast(lines), None, names, min_words, depleted), schema)
    extra = "cut"
    while extra in names:
        extra += "_"
    own = document_stats(by_row(rows, "source", "text"), min_words).select(F.col("doc_id").alias("_row"), F.explode("lines").alias("line"))
    cuts = own.join(above, "line").groupBy("_row").agg(F.collect_set("line").alias("cut"))
    both = rows.join(cuts, "_row", "left").select("doc.*", F.col("cut").alias(extra))
    return both.mapInArrow(_cleaned(None, extra, names, min_words, depleted), schema)
