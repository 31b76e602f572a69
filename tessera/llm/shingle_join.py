"""Similarity join of documents on word shingles: rare-first prefix filtering.

Two documents link when ``100 * |A & B| >= 90 * |A | B|`` for their sets of
distinct 3-word shingles (production setting of op6). All documents order
shingles by the same total order, rarest first, so linked documents share a
shingle among the first ``n - ceil(0.9 n) + 1`` of each. The order's rarity
comes from two tables of counters over all documents, of fixed size however
large the corpus is: ``SKETCH`` counters of shingles tell the clearly frequent
ones, ``WORDS`` counters of words tell how often a shingle of such words is to
be expected. Shingles equal in both are ordered by hash. Any total order gives
the same result, rarity only the speed.

Documents with equal sets form a class, and only classes are compared. In the
search a class is named by a 64-bit hash of its set, so that copies propose
nothing. Candidates come in two rounds, so that a large group of near copies
does not yield all its pairs:

1. each prefix shingle proposes its classes to one centre, the class with the
   least hash, which is the same for most shingles of a group (linear in the
   prefix entries); verified links are closed to components. Shingles that still
   have classes of different components do so once more, with another hash;
2. shingles whose classes lie in different components propose the pairs across
   components, under the length and positional filters. Classes of a shingle
   that more than ``HEAVY`` have meet by band of set sizes too (a link spans two
   neighbouring bands at most) and under a coarse suffix filter, so that such a
   shingle is dealt by their sizes and yields few of its pairs.

Every link lies inside a component of round 1 or is proposed in round 2, so
none is lost. Before sets are fetched, pairs pass the length filter and a
suffix filter in the form of a histogram bound: sets are cut at fixed hash
bounds into ``PARTS`` parts, and the differences of the parts' sizes bound the
sets' difference from below. Each pair left is verified once, on its whole sets.

Defined results: a null or empty text has no shingles, links with nothing and
is its own component; with one or two words the whole sequence is the only
shingle; a very long text is cut whole, in one chunk; equal texts link, repeated
rows give repeated rows, and different texts under one doc_id are compared as
two; a row without doc_id comes after all others, and its component_id is null
if no row with doc_id is in its component; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import attached, by_row, durable, forget, keyed, numbered, partitions, without_rows
from tessera.llm.components import components
from tessera.llm.textcore import LOWER, U64, Prefix, Texts, chunks, grams, mix64, words

#: The highest level of a word counter.
WORD_LEVEL = 80
#: Counters of shingles and of words in the rarity tables, and how many travel in one row.
SKETCH, WORDS, SLICE = 1 << 20, 1 << 18, 1 << 12
#: Parts of a set for the suffix filter, a power of two, and the shift of a hash to its part.
PARTS, PART_SHIFT = 512, 55
#: Classes from which on a shingle is dealt by bands of set sizes, and its pairs are filtered at once by parts put together to ``COARSE``.
HEAVY, COARSE = 64, 64
#: How many of a document's preceding tokens an entry of round 2 carries.
BACK = 4
#: Documents up to which the list of those to fetch is broadcast: 16 bytes each.
BROADCAST_DOCS = 1_000_000


class Rule:
    """Shingle length and threshold, as a ratio of integers."""

    def __init__(self, n: int = 3, num: int = 9, den: int = 10):
        self.n, self.num, self.den = n, num, den

    def prefix(self, size: int) -> int:
        """Length of the prefix that linked sets must share a shingle in."""
        return size - -(-self.num * size // self.den) + 1

    def alone(self, size: int) -> bool:
        """Whether a set of this size can link with equal sets only."""
        return self.den * size < self.num * (size + 1)

    def overlap(self, a: str, b: str) -> str:
        """SQL: the least intersection of linked sets with these sizes."""
        return f"(({self.num} * ({a} + {b}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def lengths(self, a: str, b: str) -> str:
        return f"({self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b}))"


def shingle_sets(t: Texts, n: int, word_levels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingle hashes of each text, ascending, and the sum of their words' levels."""
    w = words(t)
    hashes = Prefix(t.data, LOWER).hashes(w.start, w.end)
    gram, _ = grams(hashes, w.first, n)
    level = np.zeros(len(hashes), U64)
    if word_levels is not None and len(hashes) >= n:
        single = word_levels[_word_slot(hashes)].astype(U64)
        span = len(hashes) - n + 1
        for k in range(n):
            level[:span] += single[k : k + span]
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        if hi - lo >= n:
            found, at = np.unique(gram[lo : hi - n + 1], return_index=True)
            yield found, level[lo + at]
        elif hi > lo:
            short, _ = grams(hashes[lo:hi], np.array([0, hi - lo]), int(hi - lo))
            yield short[:1], level[lo : lo + 1]
        else:
            yield hashes[:0], level[:0]


def _shingle_slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(44)).astype(np.int64)


def _word_slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(46)).astype(np.int64)


def _profile(n: int):
    schema = "doc_id long, n long, h1 long, h2 long, parts array<tinyint>, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, empty = np.zeros(SKETCH + WORDS, np.int64), True
        names = ["doc_id", "n", "h1", "h2", "parts", "slice", "counts"]
        for batch in batches:
            for t in chunks(batch.column("text")):
                empty = False
                size, h1, h2 = (np.zeros(len(t), np.int64) for _ in range(3))
                parts = np.zeros((len(t), PARTS), np.int8)
                sets = [s for s, _ in shingle_sets(t, n)]
                for i, s in enumerate(sets):
                    size[i] = len(s)
                    if len(s):
                        h1[i] = _class_hash(s)
                        h2[i] = np.bitwise_xor.reduce(mix64(s ^ U64(0x5851F42D4C957F2D))).astype(np.int64)
                        # a count that is cut off keeps the bound a bound
                        parts[i] = np.minimum(np.bincount((s >> U64(PART_SHIFT)).astype(np.int64), minlength=PARTS), 127)
                w = words(t)
                np.add.at(counts, _shingle_slot(np.concatenate(sets)), 1)
                np.add.at(counts, SKETCH + _word_slot(Prefix(t.data, LOWER).hashes(w.start, w.end)), 1)
                lists = pa.ListArray.from_arrays(np.arange(0, (len(t) + 1) * PARTS, PARTS, dtype=np.int32), pa.array(parts.ravel()))
                none = [pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.first, len(t)), pa.array(size), pa.array(h1), pa.array(h2), lists, *none], names=names
                )
        if not empty:
            blobs = [counts[i : i + SLICE].tobytes() for i in range(0, len(counts), SLICE)]
            m = len(blobs)
            longs = [pa.nulls(m, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.nulls(m, pa.list_(pa.int8())), pa.array(range(m), pa.int32()), pa.array(blobs, pa.binary())], names=names
            )

    return run, schema


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            one = np.frombuffer(blob.as_buffer(), np.int64)
            sums[k] = sums[k] + one if k in sums else one
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"]
        )


def rarity(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A level of at most 127 for each shingle counter and each word counter, higher for more frequent ones.

    Counters up to twice their mean say no more than chance and have level 0.
    They are added up on the executors, where a task holds only the slices dealt
    to it; the driver gets SKETCH + WORDS counters, whatever the input.
    """
    slices = profile.where("slice is not null").select("slice", "counts")
    added = slices.repartition(partitions(profile), "slice").mapInArrow(_add_slices, "slice int, counts binary")
    counts = np.zeros(SKETCH + WORDS, np.int64)
    for row in added.collect():
        counts[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.counts, np.int64)
    shingles, single = counts[:SKETCH], counts[SKETCH:]
    above = np.log2(np.maximum(shingles / (2 * max(shingles.mean(), 0.5)), 1.0)) * 4
    return np.minimum(above, 127).astype(np.uint8), np.minimum(np.log2(single + 1.0) * 2, WORD_LEVEL).astype(np.uint8)


def _class_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingle hashes."""
    return int(mix64(s).sum(dtype=U64).astype(np.int64))


def _order(s: np.ndarray, frequent: np.ndarray, expected: np.ndarray, n: int) -> np.ndarray:
    """Shingles as numbers that rise with their frequency: 8 bits of each of both levels, the rest from the hash.

    ``expected`` adds up ``n`` word levels of at most ``WORD_LEVEL``; where that may pass 8 bits it is scaled to fit.
    """
    most = WORD_LEVEL * n
    if most > 255:
        expected = expected * U64(255) // U64(most)
    return (frequent.astype(U64) << U64(56)) | (expected << U64(48)) | (s >> U64(16))


def _prefixes(rule: Rule, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, word_levels = levels.value
        seen: set[int] = set()  # a task writes the prefix of equal sets once
        for batch in batches:
            for t in chunks(batch.column("text")):
                out, nodes, pos, sizes = [], [], [], []
                for s, expected in shingle_sets(t, rule.n, word_levels):
                    if len(s) == 0 or rule.alone(len(s)) or (node := _class_hash(s)) in seen:
                        continue
                    seen.add(node)
                    order = _order(s, frequent[_shingle_slot(s)], expected, rule.n)
                    k = rule.prefix(len(s))
                    out.append(np.sort(np.partition(order, k - 1)[:k] if k < len(order) else order))
                    nodes.append(np.full(k, node, np.int64))
                    pos.append(np.arange(k, dtype=np.int32))
                    sizes.append(np.full(k, len(s), np.int32))
                if out:
                    columns = [np.concatenate(out).view(np.int64), *map(np.concatenate, (nodes, pos, sizes))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "pos", "n"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch.column("text")):
                sets = [s.view(np.int64) for s, _ in shingle_sets(t, n)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.first, len(t)), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "set"]
                )

    return run


def _verify(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The (a, b) of the rows (a, b, na, nb) of ``pairs`` that link, each verified on whole sets."""
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "to-verify")
    few = wanted.count() <= BROADCAST_DOCS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    sets = durable(texts.mapInArrow(_sets(rule.n), "doc_id long, set array<long>"), "sets")
    forget(wanted)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.col("na") + F.col("nb") - F.col("common")
    links = durable(both.withColumn("common", common).where(F.col("common") * rule.den >= union * rule.num).select("a", "b"), "links")
    forget(sets)
    return links


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _differ(a: str, b: str) -> Column:
    """What the sizes of two sets' parts differ by in all: no more than the sets do."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y)))


def _most_apart(rule: Rule, a: str, b: str) -> Column:
    """The most elements that linked sets of these sizes don't share."""
    return F.expr(f"{a} + {b} - 2 * {rule.overlap(a, b)}")


def _filtered(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, na, nb), a < b, of the classes of distinct (x, y) that pass the length and suffix filters."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("doc_id").alias(f"d{k}"), F.col("n").alias(f"n{k}"), F.col("parts").alias(f"p{k}"))
    rows = pairs.join(side("x"), "x").join(side("y"), "y").where(rule.lengths("nx", "ny"))
    rows = rows.where(_differ("px", "py") <= _most_apart(rule, "nx", "ny"))
    return rows.select(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"))


def _classes(profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows (doc_id, n, class_id); classes (node, doc_id, n, parts); (class_id, members) of those with copies; the number of rows."""
    rows = profile.where("slice is null").drop("slice", "counts")
    key = ["n", "h1", "h2"]
    filled = rows.where("n > 0")
    copies = filled.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).where("members > 1")
    copies, total = durable(copies, "copies"), rows.count()
    placed = attached(filled, copies, key, "members", total).drop("members").unionByName(rows.where("n = 0").withColumn("class_id", F.col("doc_id")))
    placed = durable(placed.withColumn("class_id", F.coalesce("class_id", "doc_id")), "classes")
    nodes = placed.where("doc_id = class_id and n > 0").select(F.col("h1").alias("node"), "doc_id", "n", "parts")
    return placed.select("doc_id", "n", "class_id"), nodes, copies.select("class_id", "members"), total


def _components_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of all classes."""
    found = components(links, "a", "b").withColumnRenamed("node", "doc_id")
    return nodes.select("node", "doc_id").join(found, "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component"))


def _link(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``link`` of rows with a doc_id each."""
    run, schema = _profile(rule.n)
    profile = durable(docs.mapInArrow(run, schema), "profile")
    rows, nodes, copies, total = _classes(profile)
    levels = docs.sparkSession.sparkContext.broadcast(rarity(profile))
    entries = durable(docs.select("text").mapInArrow(_prefixes(rule, levels), "token long, node long, pos int, n int"), "prefixes")
    levels.destroy()

    forget(profile)
    centres = entries.groupBy("token").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    shared = durable(entries.join(centres.select("token", "centre"), "token"), "shared")
    forget(entries)
    ordered = lambda x, y: [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]
    star = shared.where("node <> centre").select(F.col("centre").alias("x"), F.col("node").alias("y")).distinct()
    star = durable(_filtered(star, nodes, rule), "star")
    first = _verify(docs, star, rule)
    spots = shared.select("token", "node", "pos", "n").distinct().join(_components_of(nodes, first), "node")
    spots = durable(spots, "spots")
    forget(shared)

    # once more from other centres, for classes that the first one is too far from
    key = F.xxhash64("node")
    centres = spots.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("node", key).alias("centre"), F.min_by("component", key).alias("centre_component")
    )
    centres = durable(centres.where("lo < hi").drop("lo", "hi"), "centres")
    again = spots.join(centres, "token").where("component <> centre_component").select(*ordered("node", "centre")).distinct()
    again = durable(_filtered(again, nodes, rule).join(star.select("a", "b"), ["a", "b"], "left_anti"), "star")
    first = durable(first.union(_verify(docs, again, rule)), "links")
    tested = star.select("a", "b").union(again.select("a", "b"))
    named = _components_of(nodes, first)
    rest = durable(spots.drop("component").join(centres.select("token"), "token", "left_semi").join(named, "node"), "spots")
    forget(spots, centres)
    spots = rest
    open_tokens = spots.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    spots_open = spots.join(open_tokens.select("token", (F.col("many") > HEAVY).alias("heavy")), "token")
    earlier = Window.partitionBy("node").orderBy("pos").rowsBetween(-BACK, -1)
    spots_open = durable(spots_open.withColumn("back", F.collect_list("token").over(earlier)), "open-spots")
    columns = ("node", "pos", "n", "component", "back")
    x, y = (spots_open.select("token", "heavy", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "xy")
    apart = (
        f"component_x < component_y and {rule.lengths('n_x', 'n_y')}"
        f" and least(n_x - pos_x, n_y - pos_y) >= {rule.overlap('n_x', 'n_y')}"
        # a common token just before this one has proposed the pair already
        " and not arrays_overlap(back_x, back_y)"
    )
    light = x.where("not heavy").join(y.where("not heavy").drop("heavy"), "token").where(apart).select(*ordered("node_x", "node_y"))
    # linked sizes are at most one band apart; a little wider, so that rounding can't make it two
    band = lambda n: F.floor(F.log(F.col(n)) / (math.log(rule.den / rule.num) * 1.0001)).cast("int")
    coarse = nodes.select("node", F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda k: _sum(F.slice("parts", k * (PARTS // COARSE) + 1, F.lit(PARTS // COARSE))).cast("smallint")).alias("coarse"))
    hx, hy = (h.where("heavy").drop("heavy").join(coarse.select(F.col("node").alias(f"node_{k}"), F.col("coarse").alias(f"coarse_{k}")), f"node_{k}") for h, k in ((x, "x"), (y, "y")))
    hx = hx.withColumn("band", F.explode(F.array(band("n_x") - 1, band("n_x"), band("n_x") + 1)))
    heavy = hx.join(hy.withColumn("band", band("n_y")), ["token", "band"]).where(apart).where(_differ("coarse_x", "coarse_y") <= _most_apart(rule, "n_x", "n_y"))
    across = light.unionByName(heavy.select(*ordered("node_x", "node_y"))).distinct()
    across = _filtered(across, nodes, rule)
    across = durable(across.join(tested, ["a", "b"], "left_anti"), "across")
    forget(spots, spots_open, star, again)
    links = durable(first.union(_verify(docs, across, rule)), "links")
    found = components(links, "a", "b").withColumnRenamed("node", "class_id")

    sized = durable(found.join(copies, "class_id", "left").withColumn("members", F.coalesce("members", F.lit(1))), "components")
    out = attached(rows, sized, ["class_id"], "members", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id")), links


def link(docs: DataFrame, rule: Rule | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    Documents: one row for each row of ``docs`` with doc_id, n_shingles, class_id
    (the first document with the same set) and component_id. Links: the verified
    pairs (a, b) between classes that the components were closed over.
    """
    rows, renamed = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out, links = _link(by_row(rows, "text"), rule or Rule())
    if not renamed:
        return out, links
    ids = rows.select("_row", F.col("doc.doc_id").alias("_id"))
    for name in ("class_id", "component_id", "doc_id"):
        out = out.withColumnRenamed(name, "_row").join(ids, "_row").drop("_row").withColumnRenamed("_id", name)
    for name in ("a", "b"):
        links = links.withColumnRenamed(name, "_row").join(ids, "_row").drop("_row").withColumnRenamed("_id", name)
    return out.select("doc_id", "n_shingles", "class_id", "component_id"), links.select("a", "b")


def unique_documents(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of ``docs`` without those of a component whose first document is another.

    Rows are compared as rows, whatever their doc_id: of repeated rows one stays,
    different texts under one doc_id are two documents, and rows without doc_id
    come after all others.
    """
    rows = keyed(docs)
    out, _ = _link(by_row(rows, "text"), rule or Rule())
    return without_rows(rows, out.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"))).select("doc.*")
