"""Many small graphs searched side by side: the same as one after the other."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import features, graphs, paths, search


def test_each_search_is_the_search_of_each_graph(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 0, 9, 2, 30])
    first = np.cumsum(sizes) - sizes
    edges = np.concatenate([first[i] + rng.integers(0, n, (2 * n, 2)) for i, n in enumerate(sizes) if n])
    whole = search.Graph(int(sizes.sum()), edges[:, 0], edges[:, 1])
    depth, ties = whole.search(np.arange(whole.n))
    want = {(a, b): (depth[a, b], ties[a, b]) for a, b in zip(*np.nonzero(depth > 0), strict=True) if a < b}
    for cells in (1, 40, 1 << 22):
        monkeypatch.setattr(search, "CELLS", cells)
        found = [x for block in whole.each_search(sizes) for x in zip(*block, strict=True)]
        assert len(found) == len(want)
        assert {(a, b): (d, t) for a, b, d, t in found} == want


def test_paths_of_many_groups(spark):
    edges = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(1), F.lit(2))).alias("a")).select("g", "a", (F.col("a") + 1).alias("b"))
    found = graphs.path_lengths(edges, "g", keep=lambda a, b: True)
    assert found.groupBy("a", "b", "length", "ties").count().count() == 3
    assert found.count() == 12000


def test_chain_counts_are_those_of_the_chains(spark):
    rows = [(1, 0, 0, 1, "x"), (1, 0, 0, 2, "y"), (1, 0, 2, 1, "x"), (1, 0, 2, 1, "x"), (2, 0, -1, 0, "root"), (2, 0, 0, 0, "self"), (3, 1, 0, 1, "x"), (3, 1, 1, 0, "x")]
    deps = spark.createDataFrame(rows, "doc_id long, sent int, gov int, dep int, type string")
    want = features.chains(deps).groupBy("steps").agg(F.count("*").alias("n"))
    sents = deps.groupBy("doc_id", "sent").agg(F.collect_list(F.struct("gov", "dep", "type")).alias("deps"))
    got = features.chain_counts(sents, F.col("deps"))
    pairs = lambda df: sorted((tuple(r.steps), r.n) for r in df.collect())
    assert pairs(got) == pairs(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_path_totals_are_those_of_the_path_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 50)
    toks = spark.range(40).select((F.col("id") % 3).alias("doc_id"), F.lit(0).alias("sent"), (F.col("id") / 3).cast("int").alias("idx"))
    deps = toks.where("idx > 0 and idx <> 7").select("doc_id", "sent", F.expr("(idx - 1) div 2").cast("int").alias("gov"), F.col("idx").alias("dep"), F.lit("x").alias("type"))
    deps = deps.unionByName(deps.where("dep % 3 = 0").withColumn("gov", F.lit(1)))
    rows = paths.path_rows(toks, deps).groupBy("doc_id", "sent")
    want = rows.agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.max("length").alias("longest"), F.sum("ties").alias("ties"))
    assert sorted(map(tuple, paths.path_totals(toks, deps).collect())) == sorted(map(tuple, want.collect()))


def _mixed_graphs(rng, sizes):
    """Edges of graphs side by side: trees with grandparents, chains, random ones, and parts of them."""
    first, edges = np.cumsum(sizes) - sizes, [np.zeros((0, 2), np.int64)]
    for i, (lo, n) in enumerate(zip(first, sizes, strict=True)):
        if n > 1:
            some = [
                np.array([(k, (k + 1) // 2 - 1) for k in range(1, n)] + [(k, (k + 1) // 4 - 1) for k in range(3, n)]),
                np.array([(k, k - 1) for k in range(1, n)]),
                rng.integers(0, n, (n, 2)),
                np.array([(k, int(rng.integers(max(0, k - 6), k))) for k in range(1, n)] + [(0, int(rng.integers(0, n)))]),
            ][i % 4]
            edges.append(lo + (some if rng.random() < 0.7 else some[rng.random(len(some)) < 0.8]))
    return np.concatenate(edges)


def test_totals_of_graphs_taken_apart_are_those_of_a_search(monkeypatch):
    rng = np.random.default_rng(5)
    for small, cells, known in ((0, 1 << 22, 0), (0, 70, 2), (24, 1 << 22, 100)):
        monkeypatch.setattr(search, "SMALL", small)
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "KNOWN", known)
        sizes = rng.integers(0, 45, 24)
        edges = _mixed_graphs(rng, sizes)
        whole, owner = search.Graph(int(sizes.sum()), edges[:, 0], edges[:, 1]), np.repeat(np.arange(24), sizes)
        depth, ties = whole.search(np.arange(whole.n))
        want = np.zeros((4, 24), np.int64)
        for a, b in zip(*np.nonzero(np.triu(depth > 0)), strict=True):
            one = want[:, owner[a]]
            one += [1, depth[a, b], 0, int(ties[a, b])]
            one[2] = max(one[2], depth[a, b])
        kept = {}
        assert (whole.totals(sizes, kept) == want).all()
        assert (whole.totals(sizes, kept) == want).all()
        assert len(kept) <= known


def test_a_tree_needs_no_search(monkeypatch):
    monkeypatch.setattr(search.Graph, "search", None)
    size = np.array([3000, 3000])
    edges = np.concatenate([np.array([(k, (k + 1) // 2 - 1) for k in range(1, 3000)]) + lo for lo in (0, 3000)])
    sums = search.Graph(6000, edges[:, 0], edges[:, 1]).totals(size)
    assert sums[0].tolist() == [3000 * 2999 // 2] * 2 and sums[3].tolist() == sums[0].tolist() and sums[2].max() == 21


def test_path_totals_in_rows_shuffle_no_token(spark):
    sents = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["a"]), (2, 0, ["x"] * 30)], "doc_id long, sent int, tokens array<string>")
    deps = F.transform(F.slice("tokens", 2, F.size("tokens")), lambda _, i: F.struct(i.alias("gov"), (i + 1).alias("dep"), F.when(i % 2 == 0, "even").otherwise("odd").alias("type")))
    got = paths.path_totals_in_row(sents, deps)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 4, 2, 3), (2, 0, 435, 4495, 29, 435)]
    even = paths.path_totals_in_row(sents, deps, lambda kind: kind == "even")
    assert sorted(map(tuple, even.collect())) == [(1, 0, 1, 1, 1, 1), (2, 0, 15, 15, 1, 15)]


def test_distinct_rows_are_those_of_unique(monkeypatch):
    rng = np.random.default_rng(2)
    small = rng.integers(-3, 3, (3, 500))
    wide = rng.integers(-(2**40), 2**40, (3, 500))
    wide[:, 250:] = wide[:, :250]
    for rows in (small, np.concatenate([small, wide[:1]]), wide, small[:, :0]):
        want, n = np.unique(rows, axis=1, return_counts=True)
        got = features._distinct(*rows)
        assert (got[0] == want).all() and (got[1] == n).all()
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda *x, axis=None, **k: 1 / 0 if axis is not None else unique(*x, **k))
    assert features._distinct(*small)[1].sum() == 500
