"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, forget


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges with every node hung on the smallest one it reaches by them: the same components from far shorter chains."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            above.setdefault(u, u)
            above.setdefault(v, v)
            if a != b:
                above[max(a, b)] = min(a, b)
    rows = [(x, r) for x in above if (r := root(x)) != x]
    for k in range(0, len(rows), 100_000):
        u, v = zip(*rows[k : k + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm on (u, v) rows with u > v.

    The large step hangs a node's larger neighbours on its smallest neighbour,
    the small step hangs the node and its smaller neighbours on it.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each task first contracts the edges it has. Every round of stars is written to the shared folder; only a count and a checksum
    reach the driver. A hub of many edges is pre-aggregated to its minimum and
    joined by a join whose skewed partitions Spark splits.
    """
    rows = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    rows = durable(rows.mapInArrow(_contracted, "u long, v long"), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(rows)
    while seen[0]:
        before, rows = rows, durable(_star(_star(rows, True), False), "edges")
        forget(before)
        now = mark(rows)
        if now == seen:
            break
        seen = now
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
