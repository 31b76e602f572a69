"""Similarity of embeddings: a stated query set against all rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled

#: Queries that travel with the plan at once.
BLOCK = 8192
#: Products of a query and a row that are made at once.
CELLS = 1 << 22
#: By how much a product of matrices may miss the sum place by place.
SLACK = 1e-9
NEAR = ["query_id", "vec_id", "similarity"]


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: str) -> Column:
    """The vector at length 1; zero vectors stay."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(F.col(vector), lambda x: x / norm)).otherwise(F.col(vector).cast("array<double>"))


def nearest(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity): the k nearest rows of each query by cosine, itself excluded.

    ``queries`` has (query_id, q). They are dealt by hash into blocks of about
    ``BLOCK`` rows, each broadcast against all rows; each task keeps its k best of
    each query, so that only those are shuffled. Products of matrices tell which
    rows can be among them, and these are added up place by place, so that equal
    vectors are equally near.
    """
    asked = settled(queries.select(F.col("query_id").cast("long").alias("query_id"), unit("q").alias("q")))
    # few large files would be few tasks, and a row meets every query
    rows = base.where("vec_id is not null").repartition("vec_id").select(F.col("vec_id").cast("long").alias("vec_id"), unit("embedding").alias("e"))
    blocks = max(-(-asked.count() // BLOCK), 1)
    found = [_nearest(rows, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    own = asked.where("query_id is not null").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((own["query_id"].to_numpy(), own["q"].combine_chunks()))

    def of_size(lists: pa.Array, width: int) -> np.ndarray:
        """Which of some vectors have ``width`` numbers and no null."""
        holes = pa.compute.list_parent_indices(lists).filter(pa.compute.list_flatten(lists).is_null()).to_numpy()
        fine = pa.compute.equal(pa.compute.list_value_length(lists), width).fill_null(False).to_numpy(zero_copy_only=False).copy()
        fine[holes] = False
        return fine

    def matrix(lists: pa.Array, fine: np.ndarray, width: int) -> np.ndarray:
        return pa.compute.list_flatten(lists.filter(pa.array(fine))).to_numpy(zero_copy_only=False).reshape(int(fine.sum()), width)

    def best(of: np.ndarray, ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query: a number that isn't one is above all, an unknown one below all."""
        rank = np.where(np.isnan(near), np.inf, near)
        order = np.lexsort((ids, -rank, of))
        of, ids, near = of[order], ids[order], near[order]
        opens = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(opens, np.diff(opens, append=len(of)))
        return of[place < k], ids[place < k], near[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = shared.value
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        widths = np.unique(pa.compute.list_value_length(lists).drop_null().to_numpy()).tolist()
        sides = []
        for width in widths:
            fine = of_size(lists, width)
            sides.append((width, names[fine], matrix(lists, fine, width)))
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in sides]
        low = [np.full(len(ids), -np.inf) for _, ids, _ in sides]
        odd = [np.zeros(0, np.int64) for _ in sides]
        for batch in batches:
            every = batch.column("vec_id").to_numpy()
            for at, (width, ids, q) in enumerate(sides):
                fine = of_size(batch.column("e"), width)
                odd[at] = np.sort(np.concatenate([odd[at], every[~fine]]))[: k + 1]
                e, mine = matrix(batch.column("e"), fine, width), every[fine]
                step = max(1, CELLS // max(len(ids), 1))
                for lo in range(0, len(mine) if len(ids) else 0, step):
                    some, here = e[lo : lo + step], mine[lo : lo + step]
                    near = q @ some.T
                    near[np.isnan(near)] = np.inf
                    near[ids[:, None] == here[None, :]] = -np.inf
                    if len(here) > k:
                        low[at] = np.maximum(low[at], np.partition(near, len(here) - k, axis=1)[:, len(here) - k])
                    of, j = np.nonzero((near >= low[at][:, None] - SLACK) & (near > -np.inf))
                    exact = np.zeros(len(of))
                    for d in range(width):
                        exact += q[of, d] * some[j, d]
                    kept[at] = best(*[np.concatenate(x) for x in zip(kept[at], (of, here[j], exact), strict=True)])
                    size = np.bincount(kept[at][0], minlength=len(ids))
                    worst = np.cumsum(size)[size == k] - 1
                    low[at][size == k] = np.maximum(low[at][size == k], np.where(np.isnan(kept[at][2][worst]), np.inf, kept[at][2][worst]))
        for at, (_, ids, _) in enumerate(sides):
            of, vec, near = kept[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(vec), pa.array(near)], names=NEAR)
            # rows of another size, or with a null, are at no known distance and come last
            both = np.repeat(ids, len(odd[at])), np.tile(odd[at], len(ids))
            fine = both[0] != both[1]
            yield pa.RecordBatch.from_arrays([pa.array(both[0][fine]), pa.array(both[1][fine]), pa.nulls(int(fine.sum()), pa.float64())], names=NEAR)

    found = rows.mapInArrow(run, "query_id long, vec_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def similarity(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of stated pairs of vec_id by cosine."""
    side = lambda k: base.select(F.col("vec_id").alias(k), unit("embedding").alias(f"_{k}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", dot("_a", "_b").alias("similarity"))


def analogies(base: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity): the k nearest to b - a + c for each (query_id, a, b, c) of vec_ids, these three excluded."""
    side = lambda x: base.select(F.col("vec_id").alias(x), unit("embedding").alias(f"_{x}"))
    rows = asked.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    both = F.zip_with(F.zip_with("_b", "_a", lambda x, y: x - y), "_c", lambda x, y: x + y)
    found = nearest(base, rows.select("query_id", both.alias("q")), k + 3)
    named = found.join(asked.select("query_id", F.array("a", "b", "c").alias("_own")), "query_id").where(~F.array_contains("_own", F.col("vec_id")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return named.withColumn("_r", place).where(F.col("_r") <= k).drop("_r", "_own")


def random_vector(seed: int, size: int) -> Column:
    """An array of ``size`` numbers in [-1, 1) that depends on the row's seed column alone."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(2_000_003)) / 1_000_001.5 - 1)
