"""Suffix-array dedup of 50-byte strings across documents, by deep-shallow sorting.

A byte is removed if it lies in a string of ``SPAN`` bytes that also starts in a
document with a smaller doc_id. Sorting all suffixes of a corpus would ship each
byte 50 times, so only suffixes that can have an equal are sorted:

1. Every window of ``SPAN`` bytes is represented by its anchor, the ``KMER``-byte
   string in it with the smallest hash. Equal windows have equal anchors. Anchor
   hashes are dealt to buckets, where those that two different texts share are
   found. The answer is a bit array of ``FILTER`` bits, of fixed size; further
   bits set by chance, or a full array, cost time and never change the result.
2. The windows of shared anchors, with their bytes, are contexts. Of equal
   contexts only those of the smallest document are sorted, the others are cut
   at once: inside a chunk after their bytes were compared, and across chunks
   for frequent ones, by a hash, a number made of 24 of their bytes and the
   length. The rest is dealt to
   buckets. A bucket sorts its suffixes: ternary partitioning (multikey
   quicksort) on 8-byte words to the shallow depth of ``SHALLOW`` bytes, for all
   open groups at once, small groups by one plain sort; deep groups become blind
   tries, whose nodes branch at the first byte in which their suffixes differ.
   Suffixes with 50 equal bytes are a leaf; all but those of its smallest
   document are removed.
3. Removed runs are joined to the texts of the documents that have any.

Exact copies of a text are removed as wholes and found by its hash (64 and 32
bits, and the length). In steps 1 and 2 equal hashes and equal contexts of a
chunk travel once, so a passage that a third of all documents share comes once
from each chunk; contexts that still come often are cut before they are dealt.

Defined results: null is an empty text, texts under 50 bytes lose nothing; a
very long text is searched whole, in one chunk; an empty table gives an empty
result; repeated rows (same doc_id) aren't smaller than each other and stay; of
different texts under one doc_id each loses what smaller doc_ids have; a row
without doc_id loses nothing and removes nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_KEYS, HOT_ROWS, attached, durable
from tessera.llm.textcore import U64, Prefix, Texts, chunks, mix64

SPAN, KMER, SHALLOW = 50, 24, 16
#: Members up to which a group of the quicksort is sorted plainly.
SMALL = 1 << 17
FILTER = 27
#: Bytes of text for each bucket, and how many buckets there are at least.
BUCKET, LEAST = 8 << 20, 6
#: Documents with removed bytes up to which their keys are broadcast (16 bytes each).
BROADCAST_DOCS = 1_000_000


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run of windows with one anchor."""
    n = len(t.data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none.astype(U64), none, none
    starts = np.arange(n - KMER + 1)
    full = Prefix(t.data).hashes(starts, starts + KMER)
    low = (full & U64(0xFFFFFFFF00000000)) | starts.astype(U64)
    size, width = 1, SPAN - KMER + 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)  # one for each window of the chunk
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(t.bounds[1:] - SPAN + 1, t.bounds[:-1]), 1)
    np.add.at(edge, t.bounds[1:], -1)
    inside = np.flatnonzero(np.cumsum(edge[: len(at)]) == 0)
    if not len(inside):
        return none.astype(U64), none, none
    a = at[inside]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1))))
    # anchors have small hashes: mixed again, they deal evenly
    return mix64(full[a[new]] ^ U64(0x2545F4914F6CDD1D)), inside[new], inside[np.concatenate((new[1:], [len(inside)])) - 1]


def _anchor_blobs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column("text_class").to_numpy(zero_copy_only=False)
            for t in chunks(batch.column("text")):
                h, first, _ = anchors(t)
                if not len(h):
                    continue
                owner = np.searchsorted(t.bounds, first, "right") - 1
                c = classes[t.first + owner].astype(np.int64)
                order = np.argsort(h, kind="stable")
                h, c = h[order], c[order]
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                low, high = np.minimum.reduceat(c, start), np.maximum.reduceat(c, start)
                h, c = h[start], np.where(low == high, low, 0)  # 0: shared in this chunk
                bucket = (h >> U64(64 - bits)).astype(np.int64)
                ids, cut = np.unique(bucket, return_index=True)
                cut = [*cut.tolist(), len(h)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.astype(np.int32)),
                        pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                        pa.array([c[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                    ],
                    names=["bucket", "hashes", "classes"],
                )

    return run


def _shared_bits(bits: int):
    def run(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table["hashes"]])
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["classes"]])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        low, high = np.minimum.reduceat(c, start), np.maximum.reduceat(c, start)
        some = np.minimum.reduceat(np.abs(c), start) == 0
        shared = h[start][(low != high) | some]
        # a bucket's hashes share their first bits, so it owns a range of the bit array
        flags = np.zeros(1 << (FILTER - bits), np.uint8)
        flags[((shared >> U64(64 - FILTER)) & U64((1 << (FILTER - bits)) - 1)).astype(np.int64)] = 1
        return pa.table({"bucket": table["bucket"][:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    return run


def _contexts(bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            classes = batch.column("text_class").to_numpy(zero_copy_only=False)
            for t in chunks(batch.column("text")):
                h, first, last = anchors(t)
                spot = (h >> U64(64 - FILTER)).astype(np.int64)
                use = (flags[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
                h, first, last = h[use], first[use], last[use]
                if not len(h):
                    continue
                owner = np.searchsorted(t.bounds, first, "right") - 1
                doc = docs[t.first + owner]
                # of equal contexts only those of the smallest document travel; the rest is settled here
                key = Prefix(t.data).hashes(first, last + SPAN)
                second = _sample(t.data, first, last + SPAN)
                order = np.lexsort((doc, key))
                start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                leader = np.empty(len(order), np.int64)
                leader[order] = np.repeat(order[start], np.diff(np.append(start, len(order))))
                text = t.data.tobytes()
                begin, end = first.tolist(), (last + SPAN).tolist()
                ctx = [text[i:j] for i, j in zip(begin, end, strict=True)]
                later = np.flatnonzero(doc > doc[leader])
                for k, lead in zip(later.tolist(), leader[later].tolist(), strict=True):
                    if ctx[k] == text[begin[lead] : end[lead]]:
                        ctx[k] = None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((h >> U64(64 - bits)).astype(np.int32)),
                        pa.array(doc.astype(np.int64)),
                        pa.array(classes[t.first + owner].astype(np.int64)),
                        pa.array(first - t.bounds[owner]),
                        pa.array((last - first + 1).astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array(ctx, pa.binary()),
                    ],
                    names=[x.split()[0] for x in CONTEXTS.split(", ")],
                )

    return run


def _sample(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number of each context made of its own bytes: eight at the start, in the middle and at the end."""
    out = np.zeros(len(start), U64)
    for k, at in enumerate((start, (start + end) // 2 - 4, end - 8)):
        word = np.zeros(len(start), U64)
        for i in range(8):
            word |= data[at + i].astype(U64) << U64(8 * i)
        out = mix64(out ^ word + U64(k))
    return out


CONTEXTS = "bucket int, doc_id long, text_class long, start long, windows int, key long, second long, context binary"


def _partitioned(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort to the shallow depth: the order of the suffixes, and where a new group of equal ones begins.

    Every round cuts each open group in three around the median of three of its
    words, all groups at once; the middle part goes on at the next word.
    """
    n = len(at)
    order, new, depth = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    new[:1] = True
    done = np.zeros(n, bool)
    while True:
        edge = np.append(np.flatnonzero(new), n)
        size = np.diff(edge)
        done[edge[:-1][size == 1]] = True
        open_ = np.flatnonzero(~done[edge[:-1]])
        if not len(open_):
            return order, new
        large = open_[size[open_] > SMALL]
        some = large if len(large) else open_
        count = size[some]
        where = np.repeat(edge[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        group = np.repeat(np.arange(len(some)), count)
        key = word[at[order[where]] + depth[where]]
        if len(large):
            begin = np.cumsum(count) - count
            pivot = np.sort(np.stack([key[begin], key[begin + count // 2], key[begin + count - 1]]), axis=0)[1][group]
            side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2)).astype(np.int64)
            # places by counting: parts of a group follow one another, members keep their order
            part = group * 3 + side
            total = np.bincount(part, minlength=3 * len(some))
            first = np.cumsum(total) - total
            place = np.empty(len(part), np.int64)
            for k in range(3):
                mine = side == k
                seen = np.concatenate(([0], np.cumsum(mine)))
                place[mine] = (first[group * 3 + k] + seen[:-1] - seen[begin][group])[mine]
            moved = np.empty(len(part), np.int64)
            moved[place] = order[where]
            order[where] = moved
            new[where[first[total > 0]]] = True
            middle = np.zeros(len(part), bool)
            middle[place[side == 1]] = True
            ahead = where[middle]
        else:
            again = np.lexsort((key, group))
            order[where] = order[where][again]
            key = key[again]
            new[where[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            ahead = where
        depth[ahead] += 8
        done[ahead] = depth[ahead] >= SHALLOW


def _first_difference(word: np.ndarray, mine: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The first byte from ``SHALLOW`` on in which two suffixes differ; ``SPAN`` where none does."""
    differ = np.full(len(mine), SPAN)
    for depth in range(SPAN - SPAN % 8, SHALLOW - 1, -8):
        x = word[mine + depth] ^ word[lead + depth]
        if depth + 8 > SPAN:
            x &= U64(((1 << 64) - 1) ^ ((1 << 8 * (depth + 8 - SPAN)) - 1))
        hit = x != 0
        byte = np.zeros(hit.sum(), np.int64)
        for k in range(7, -1, -1):
            byte[(x[hit] >> U64(8 * (7 - k))) & U64(255) != 0] = k
        differ[hit] = depth + byte
    return differ


class BlindTries:
    """The blind tries of all deep groups, built from the roots down, a level of all tries at once.

    A node has its parent and the depth of its critical byte, the first in which
    its suffixes differ; its branches are that byte's values. A leaf holds suffixes
    with ``SPAN`` equal bytes, and has that depth. Leaves in the order of branches
    are in the order of their suffixes.
    """

    def __init__(self, data: np.ndarray, word: np.ndarray, at: np.ndarray, order: np.ndarray, new: np.ndarray):
        n = len(at)
        self.order, self.new = order, new
        self.parent, self.depth = [np.full(int(new.sum()), -1)], []
        node = np.cumsum(new) - 1  # of each place
        open_ = np.arange(n)
        made = int(new.sum())
        while len(open_):
            ids, first = np.unique(node[open_], return_index=True)
            size = np.diff(np.append(first, len(open_)))
            lead = np.repeat(at[order[open_[first]]], size)
            critical = np.repeat(np.minimum.reduceat(_first_difference(word, at[order[open_]], lead), first), size)
            self.depth.append(critical[first])
            inner = critical < SPAN
            open_, critical = open_[inner], critical[inner]
            if not len(open_):
                break
            branch, above = data[at[order[open_]] + critical], node[open_]
            again = np.lexsort((branch, above))
            order[open_] = order[open_][again]
            branch = branch[again]
            child = np.concatenate(([True], (branch[1:] != branch[:-1]) | (above[1:] != above[:-1])))
            new[open_[child]] = True
            self.parent.append(above[child])
            node[open_] = made + np.cumsum(child) - 1
            made += int(child.sum())

    def leaves(self) -> np.ndarray:
        """The leaf's number of each suffix, in the order of suffixes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out


def suffix_classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class of each suffix ``data[at:at + SPAN]``; classes are numbered in suffix order.

    ``data`` has at least 8 bytes after the last suffix's end.
    """
    word = np.zeros(len(data) - 7, U64)
    for k in range(8):
        word |= data[k : len(data) - 7 + k].astype(U64) << U64(8 * (7 - k))
    order, new = _partitioned(word, at)
    return BlindTries(data, word, at, order, new).leaves()


CUTS = "doc_id long, text_class long, begin long, end long"


def _resolve(table: pa.Table) -> pa.Table:
    """Removed runs of the contexts of a bucket."""
    table = table.combine_chunks()
    doc, kind, start = (table[c].to_numpy() for c in ("doc_id", "text_class", "start"))
    size = table["windows"].to_numpy().astype(np.int64)
    context = table["context"].to_pylist()
    # of contexts that come from several chunks only those of the smallest document are sorted
    leader: dict[bytes, int] = {}
    owners = doc.tolist()
    gone = np.zeros(len(doc), bool)
    for i in np.argsort(doc, kind="stable").tolist():
        gone[i] = owners[leader.setdefault(context[i], i)] < owners[i]
    del leader
    out = [(doc[gone], kind[gone], start[gone], start[gone] + size[gone] + SPAN - 1)]
    rest = np.flatnonzero(~gone)
    doc, kind, start, size = doc[rest], kind[rest], start[rest], size[rest]

    data = np.frombuffer(b"".join([context[i] for i in rest.tolist()]) + bytes(16), np.uint8)
    shift = np.concatenate(([0], np.cumsum(size + SPAN - 1)[:-1]))
    owner = np.repeat(np.arange(len(doc)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    of = suffix_classes(data, shift[owner] + place)
    least = np.full(of.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc[owner])
    hit = np.flatnonzero(doc[owner] > least[of])
    o, p = owner[hit], place[hit]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] - p[:-1] > SPAN))) if len(hit) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit))[: len(first)] - 1
    row = o[first]
    out.append((doc[row], kind[row], start[row] + p[first], start[row] + p[last] + SPAN))
    return pa.table({n: np.concatenate(c) for n, c in zip(("doc_id", "text_class", "begin", "end"), zip(*out, strict=True), strict=True)})


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of some intervals; those that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > reach[:-1])) if len(begin) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin))[: len(first)] - 1] if len(first) else reach[:0]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = batch.column("cuts")
        spans = cuts.values
        begin, end = (spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        offsets, some = cuts.offsets.to_numpy(), np.asarray(cuts.is_valid())
        out: list[list] = [[], [], [], []]
        for t in chunks(batch.column("text"), 1 << 24):
            for i in range(len(t)):
                raw, row = t.raw(i), t.first + i
                lo, hi = (offsets[row], offsets[row + 1]) if some[row] else (0, 0)
                b, e = merged(np.minimum(begin[lo:hi], len(raw)), np.minimum(end[lo:hi], len(raw)))
                b, e = b[b < e].tolist(), e[b < e].tolist()
                kept = b"".join([raw[x:y] for x, y in zip([0, *e], [*b, len(raw)], strict=True)]) if b else raw
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(b), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[x.split()[0] for x in DIGEST.split(", ")])


def removed_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_class, begin, end): byte runs to remove from the rows with this doc_id and hash of the text; they may overlap."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    rows = rows.withColumn("text_class", F.xxhash64("text"))
    ids = durable(rows.select("doc_id", "text_class", F.hash("text").alias("h"), F.octet_length("text").alias("n")), "classes")
    key = ["text_class", "h", "n"]
    originals = ids.where(f"n >= {SPAN}").groupBy(*key)
    originals = originals.agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last"), F.count("*").alias("members"))
    originals = durable(originals.where("original < last").drop("last"), "originals")
    size, total = ids.agg(F.sum("n"), F.count("*")).first()
    copies = attached(ids, originals, key, "members", total).where("doc_id > original")
    copies = copies.select("doc_id", "text_class", F.lit(0).cast("long").alias("begin"), F.col("n").cast("long").alias("end"))
    bits = min(max(LEAST, int((size or 0) // BUCKET).bit_length()), 20)
    blobs = rows.select("text", "text_class").mapInArrow(_anchor_blobs(bits), "bucket int, hashes binary, classes binary")
    flags = blobs.groupBy("bucket").applyInArrow(_shared_bits(bits), "bucket int, flags binary")
    width = (1 << (FILTER - bits)) // 8
    whole = bytearray(1 << (FILTER - 3))
    for r in durable(flags, "shared-anchors").collect():
        whole[r.bucket * width : (r.bucket + 1) * width] = r.flags
    shared = spark.sparkContext.broadcast(bytes(whole))
    contexts = durable(rows.select("doc_id", "text_class", "text").mapInArrow(_contexts(bits, shared), CONTEXTS), "contexts")
    shared.destroy()

    whole_run = [F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (SPAN - 1)).alias("end")]
    settled = contexts.where("context is null").select("doc_id", "text_class", *whole_run)
    live = contexts.where("context is not null")
    # frequent contexts: at most HOT_KEYS of them, whatever the input
    key = ["key", "second", "windows"]
    many = live.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where(f"members >= {HOT_ROWS}")
    many = durable(many, "frequent")
    many = F.broadcast(many.where(F.col("members") >= max(HOT_ROWS, live.count() // HOT_KEYS)).select(*key, "least"))
    marked = live.join(many, key, "left")
    late = marked.where("doc_id > least").select("doc_id", "text_class", *whole_run)
    rest = marked.where("least is null or doc_id <= least").select("bucket", "doc_id", "text_class", "start", "windows", "context")
    return rest.groupBy("bucket").applyInArrow(_resolve, CUTS).unionByName(settled).unionByName(late).unionByName(copies)


def dedup(docs: DataFrame) -> DataFrame:
    """Digest of every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    key = ["doc_id", "text_class"]
    cuts = durable(removed_runs(docs), "cuts").groupBy(*key).agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    cuts = durable(cuts, "cuts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_class"))
    hit = cuts.select(*key)
    if cuts.count() <= BROADCAST_DOCS:  # texts without cuts stay where they are
        plain = rows.join(F.broadcast(hit), key, "left_anti").withColumn("cuts", F.lit(None).cast("array<struct<begin:long,end:long>>"))
        both = rows.join(F.broadcast(hit), key, "left_semi").join(cuts, key).unionByName(plain)
    else:
        both = rows.join(cuts, key, "left")
    return both.select("doc_id", "text", "cuts").mapInArrow(_digests, DIGEST)
