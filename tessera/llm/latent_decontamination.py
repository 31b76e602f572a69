"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to ``SLOTS`` terms; the passage frequency of every term is
   counted over all passages (runs of ``PASSAGE`` words) of all documents.
2. A randomised SVD of the TF-IDF matrix of passages gives a latent space of
   ``RANK`` dimensions. Its rows are the benchmark's items, weighed to half of
   the whole, and a bounded sample of about ``FIT`` passages by hash; the range
   finder's products are summed on the executors. Only this fit is on a sample
   (of the items too, where there are more than ``FIT``), and it is made once.
3. Every document is searched whole, in one pass for up to ``BLOCK`` items:
   windows at every eighth word, of 24 and 48 words, are projected. A window is a
   candidate for an item if their cosine in the latent space is ``COSINE`` or
   more, and if of its whole TF-IDF vector, not only of what the space keeps, as
   much lies along the item's image as ``SHARE`` of an item's own vector does.
4. A candidate is a leak if the longest common subsequence of the item's words
   and the words around the window covers ``COVER`` of the item, and half of its
   answer: its last quarter, at least 3 words, which must not be missing.

Items of fewer than ``SHORT`` words leave nothing to paraphrase: they leak where
their words stand in a document in this order, next to each other; items of one
or two words, where they are the whole document. Words are runs of letters,
digits and marks of any script, in lower case; in scripts without spaces each
character is a word.

Only counters, sampled passages and leaks are shuffled. Benchmark items are the
query set: they are broadcast in blocks of ``BLOCK``, documents pass once for each.

Defined results: null or empty texts and items match nothing; repeated rows give
the same leaks once a document, rows without doc_id none (``clean_documents``
judges them by a key of their own); a very long text is searched whole, in one
chunk; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_row, durable, forget, keyed, partitions, without_rows
from tessera.llm.textcore import U64, Prefix, Texts, Words, chunks, grams, mix64, units

SLOTS, PASSAGE, FIT, RANK, OVER = 1 << 15, 32, 16_000, 48, 8
STEP, WINDOWS = 8, (3, 6)
COSINE, SHARE, COVER, ANSWER, SHORT, BLOCK = 0.5, 0.4, 0.6, 0.5, 8, 1 << 15
SLICE = 1 << 10
#: Items that windows are multiplied with at once.
COLUMNS = 1024


def _hashed(t: Texts) -> tuple[Words, np.ndarray]:
    w = units(t)
    return w, Prefix(t.data).hashes(w.start, w.end)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(49)).astype(np.int64)


def _text_words(text: str) -> np.ndarray:
    raw = (text or "").encode()
    return _hashed(Texts(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[1]


def _passages(share: float):
    """Rows of term counts by slice, of the number of passages (slice -1), and sampled passages."""
    limit = U64(min(int(share * 2**63), 2**63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in chunks(batch.column("text")):
                w, h = _hashed(t)
                if not len(h):
                    continue
                place = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))
                number = np.cumsum(place % PASSAGE == 0) - 1
                n = int(number[-1]) + 1
                pairs = np.unique(number * SLOTS + _slot(h))
                counts += np.bincount(pairs % SLOTS, minlength=SLOTS)
                total += n
                # a passage is drawn by the hash of its words
                key = np.zeros(n, U64)
                np.add.at(key, number, mix64(h + place.astype(U64)))
                drawn = np.flatnonzero(mix64(key) >> U64(1) < limit)
                if len(drawn):
                    first = np.searchsorted(number, np.arange(n + 1))
                    lists = [_slot(h[first[i] : first[i + 1]]).astype(np.int32) for i in drawn]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(lists), pa.int32()), pa.nulls(len(lists), pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
                        names=["slice", "counts", "slots"],
                    )
        blobs = [np.array([total]).tobytes()] + [counts[i : i + SLICE].tobytes() for i in range(0, SLOTS, SLICE)]
        m = len(blobs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, m - 1), pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(m, pa.list_(pa.int32()))],
            names=["slice", "counts", "slots"],
        )

    return run


def _sum_slices(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                one = np.frombuffer(blob.as_buffer(), kind)
                sums[k] = sums[k] + one if k in sums else one
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"]
            )

    return run


def _summed(rows: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Sums of equal slices, added up on the executors; the result has a fixed size."""
    added = rows.repartition(partitions(rows), "slice").mapInArrow(_sum_slices(kind), "slice int, counts binary")
    return {r.slice: np.frombuffer(r.counts, kind) for r in added.collect()}


def _sparse(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, slots and weights of the unit TF-IDF rows of some passages."""
    starts, slots, weights = [0], [], []
    for x in lists:
        s, n = np.unique(x, return_counts=True)
        v = (1 + np.log(n)) * idf[s]
        slots.append(s)
        weights.append(v / max(np.linalg.norm(v), 1e-9))
        starts.append(starts[-1] + len(s))
    return np.array(starts), np.concatenate(slots), np.concatenate(weights).astype(np.float32)


def _times(rows: tuple, right: np.ndarray) -> np.ndarray:
    starts, slots, weights = rows
    return np.add.reduceat(right[slots] * weights[:, None], starts[:-1], axis=0)


def _gram_times(rows: tuple, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots that occur, and their rows of A'(A right)."""
    starts, slots, weights = rows
    left = np.repeat(_times(rows, right), np.diff(starts), axis=0) * weights[:, None]
    order = np.argsort(slots, kind="stable")
    found, first = np.unique(slots[order], return_index=True)
    return found, np.add.reduceat(left[order], first, axis=0)


def _products(shared, width: int, small: bool):
    """Slices of A'(A Q) of the passages of a partition, or the one slice (AQ)'(AQ); added up over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = shared.value
        total = np.zeros((width, width) if small else (SLOTS, width), np.float32)
        some = False
        for batch in batches:
            lists = [np.asarray(x.values) for x in batch.column("slots") if len(x)]
            if not lists:
                continue
            some = True
            rows = _sparse(lists, idf)
            if small:
                y = _times(rows, right)
                total += y.T @ y
            else:
                found, part = _gram_times(rows, right)
                total[found] += part
        if some:
            blobs = [total.tobytes()] if small else [total[k : k + SLICE].tobytes() for k in range(0, SLOTS, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    return run


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' space, by their small Gram matrix; directions without weight become zero."""
    for _ in range(2):
        gram = sum(part.T @ part for k in range(0, len(x), SLICE) for part in (x[k : k + SLICE].astype(float),))
        values, vectors = np.linalg.eigh(gram)
        scale = np.where(values > max(values[-1], 1e-30) * 1e-10, 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)
        x = x @ (vectors * scale).astype(np.float32)
    return x


def fit_space(sample: DataFrame, items: list[np.ndarray], idf: np.ndarray, drawn: int, seed: int = 7) -> np.ndarray:
    """Orthonormal basis (SLOTS x RANK) of the passages' and items' leading right singular space."""
    spark, width = sample.sparkSession, RANK + OVER
    own = _sparse([_slot(x) for x in items], idf)
    boost = max(drawn, 1) / max(len(items), 1)
    q = np.random.default_rng(seed).standard_normal((SLOTS, width), np.float32)
    for _ in range(2):
        shared = spark.sparkContext.broadcast((idf, q))
        parts = _summed(sample.mapInArrow(_products(shared, width, False), "slice int, counts binary"), np.float32)
        shared.destroy()
        found, part = _gram_times(own, q)
        q[:] = 0
        q[found] = boost * part
        while parts:
            k, part = parts.popitem()
            q[k * SLICE : (k + 1) * SLICE] += part.reshape(SLICE, width)
        q = _orthonormal(q)
    shared = spark.sparkContext.broadcast((idf, q))
    small = _summed(sample.mapInArrow(_products(shared, width, True), "slice int, counts binary"), np.float32)
    shared.destroy()
    y = _times(own, q)
    gram = boost * (y.T @ y) + sum((v.reshape(width, width) for v in small.values()), np.zeros((width, width), np.float32))
    values, vectors = np.linalg.eigh(gram)
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = masks.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


LEAKS = "doc_id long, item_id long, cosine double, cover double, first_word long, last_word long"


def _verbatim(h: np.ndarray, w: Words, short: dict[int, dict[int, list[int]]]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, last word) of the short items that stand in a chunk; ``short`` has ids by length and hash."""
    size = np.diff(w.first)
    for n, of in short.items():
        gram, whole = grams(h, w.first, n)
        if n < 3:
            whole[:] = False
            whole[w.first[:-1][size == n]] = True
        keys = np.sort(np.fromiter(of, U64, len(of)))
        spot = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        for at in np.flatnonzero(whole & (keys[spot] == gram)).tolist():
            doc = int(np.searchsorted(w.first, at, "right")) - 1
            for item in of[int(gram[at])]:
                yield doc, item, int(at - w.first[doc]), int(at - w.first[doc]) + n


def _found(window: np.ndarray, full: np.ndarray, latent: np.ndarray, image: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(window, item, cosine) of the candidates, for ``COLUMNS`` items at a time."""
    kept = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
    # what lies along an item's image is at most what the space keeps
    able = np.flatnonzero(kept >= SHARE * image.min() * full)
    window, kept, full = window[able], kept[able], full[able]
    for k in range(0, latent.shape[1], COLUMNS):
        near, some_image = window @ latent[:, k : k + COLUMNS], image[k : k + COLUMNS]
        # most windows fail with their best item already
        some = np.flatnonzero(near.max(axis=1) >= np.maximum(COSINE * kept, SHARE * some_image.min() * full))
        near = near[some]
        cosine = near / kept[some, None]
        for i, j in zip(*np.nonzero((near >= SHARE * some_image * full[some, None]) & (cosine >= COSINE)), strict=True):
            yield int(able[some[i]]), k + int(j), float(cosine[i, j])


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, table, weight, latent, image, short = shared.value
        lists = [x.tolist() for x in items]
        sets = [set(x) for x in lists]
        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out = []
            for t in chunks(batch.column("text")):
                w, h = _hashed(t)
                if not len(h):
                    continue
                out += [(docs[t.first + d], item, 1.0, 1.0, lo, hi) for d, item, lo, hi in _verbatim(h, w, short)]
                if not lists:
                    continue
                slot, lengths = _slot(h), np.diff(w.first)
                place = np.arange(len(h)) - np.repeat(w.first[:-1], lengths)
                cut = np.flatnonzero(place % STEP == 0)
                sums = np.add.reduceat(table[slot], cut, axis=0).astype(np.float64)
                norm = np.add.reduceat(weight[slot], cut)
                sums = np.concatenate((np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)))
                norm = np.concatenate(([0.0], np.cumsum(norm)))
                owner = np.searchsorted(w.first, cut, "right") - 1
                last = np.searchsorted(owner, owner, "right")  # the block after the document's last
                for size in WINDOWS:
                    end = np.minimum(np.arange(len(cut)) + size, last)
                    window = (sums[end] - sums[:-1]).astype(np.float32)
                    full = np.sqrt(np.maximum(norm[end] - norm[:-1], 1e-9)).astype(np.float32)
                    for b, k, cosine in _found(window, full, latent, image):
                        item, doc = lists[k], owner[b]
                        spare = max(len(item) - size * STEP, 0) + STEP
                        lo = max(cut[b] - spare, w.first[doc])
                        hi = min(cut[b] + size * STEP + spare, w.first[doc + 1])
                        near = h[lo:hi].tolist()
                        # words that aren't near can't be in a common subsequence
                        if len(item) - len(sets[k]) + len(sets[k].intersection(near)) < COVER * len(item):
                            continue
                        cover = common_subsequence(item, near) / len(item)
                        if cover >= COVER:
                            tail = item[-max(len(item) // 4, 3) :]
                            if common_subsequence(tail, near) >= ANSWER * len(tail):
                                out.append((docs[t.first + doc], ids[k], cosine, cover, int(lo - w.first[doc]), int(hi - w.first[doc])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in LEAKS.split(", ")]
            )

    return run


def _short_items(pairs: list[tuple[int, np.ndarray]]) -> dict[int, dict[int, list[int]]]:
    """Ids of items by their number of words and the hash of these."""
    out: dict[int, dict[int, list[int]]] = {}
    for item, x in pairs:
        n = len(x)
        gram, _ = grams(x, np.array([0, n]), n)
        out.setdefault(n, {}).setdefault(int(gram[0]), []).append(item)
    return out


def _items(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """(item_id, word hashes) of the items that have a word."""
    found = rows.select("item_id", F.lower("item").alias("item")).collect()
    return [(r.item_id, x) for r in found if r.item_id is not None and len(x := _text_words(r.item))]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, cover, first_word, last_word): the best match of each leaked item in each document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.withColumn("text", F.lower("text"))
    found = texts.select("text").mapInArrow(_passages(FIT * PASSAGE * 6 / max(size, 1)), "slice int, counts binary, slots array<int>")
    found = durable(found, "passages")
    counts = _summed(found.where("slice is not null").select("slice", "counts"), np.int64)
    total = int(counts.pop(-1)[0]) if counts else 0
    frequency = np.concatenate([counts[k] for k in sorted(counts)]) if counts else np.zeros(SLOTS)
    idf = np.log((total + 1) / (frequency + 1)).astype(np.float32)
    sample = found.where("slots is not null").select("slots")

    queries = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item is not null")
    n_items = queries.count()
    result = spark.createDataFrame([], LEAKS)
    if not total or not n_items:
        return result
    fitted = F.pmod(F.xxhash64("item", F.lit(1)), F.lit(1 << 30)) < min(1.0, FIT / n_items) * (1 << 30)
    own = [x for _, x in _items(queries.where(fitted)) if len(x) >= SHORT]
    table = fit_space(sample, own, idf, sample.count()) if own else np.zeros((SLOTS, RANK), np.float32)
    forget(found)
    for k in range(blocks := -(-n_items // BLOCK)):
        rows = _items(queries.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k))
        long = [(i, x) for i, x in rows if len(x) >= SHORT]
        short = _short_items([(i, x) for i, x in rows if len(x) < SHORT])
        latent = _times(_sparse([_slot(x) for _, x in long], idf), table).T if long else np.zeros((RANK, 0), np.float32)
        image = np.maximum(np.linalg.norm(latent, axis=0), 1e-6)
        shared = spark.sparkContext.broadcast(
            ([i for i, _ in long], [x for _, x in long], table * idf[:, None], idf**2, latent / image, image, short)
        )
        hits = durable(texts.mapInArrow(_search(shared), LEAKS), "leaks")
        shared.destroy()
        result = hits if k == 0 else result.union(hits)
    best = F.max_by(F.struct("cosine", "cover", "first_word", "last_word"), F.struct("cover", "cosine", F.col("first_word") * -1))
    return result.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without leaks, unchanged; each row is judged by its own text, whatever its doc_id."""
    rows = keyed(docs)
    return without_rows(rows, leaks(by_row(rows, "text"), benchmark).select(F.col("doc_id").alias("_row"))).select("doc.*")
