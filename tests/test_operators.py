"""Operators without SQL, against known answers."""

import random
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graphs, sets, tables
from tessera.sources import formats
from tessera.streaming.directory import follow


def test_shortest_paths_ties():
    found = graphs.shortest_paths([1, 2, 3, 4], [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert sorted(found[1, 4]) == [[1, 2, 4], [1, 3, 4]]
    assert found[2, 1] == [[2, 1]]
    assert (4, 1) not in graphs.shortest_paths([1, 4], [(1, 4)], directed=True)


def test_expand_equivalents():
    assert graphs.expand_equivalents(["a", "b"], [{"a", "x"}]) == [("a", "b"), ("x", "b")]


def test_unique_events_reaches_fixpoint(spark):
    rows = [("d", "e1", "bind", ["p"]), ("d", "e2", "bind", ["p"]), ("d", "e3", "up", ["e1"]), ("d", "e4", "up", ["e2"])]
    df = spark.createDataFrame(rows, "doc string, event string, kind string, arguments array<string>")
    assert {r.event: r.keeper for r in graphs.unique_events(df, "doc").collect()} == {"e1": "e1", "e2": "e1", "e3": "e3", "e4": "e3"}


def test_ancestors(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert graphs.ancestors(df).count() == 9


def test_running_equals_prefix_sum(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"))
    got = {r.k: r.s for r in tables.running(df, "k", "w", "s").collect()}
    total = 0
    for k in range(1000):
        assert got[k] == total
        total += k % 7


def test_folds_are_equal(spark):
    sizes = [r["count"] for r in sets.folds(spark.range(103).withColumnRenamed("id", "d"), "d", 10).groupBy("fold").count().collect()]
    assert sorted(set(sizes)) == [10, 11]


def test_examples_round_trip(spark, tmp_path):
    rows = [(1, {1: 0.5, 3: 1.0}, {"id": "d.s0.x1"}), (2, {2: 2.0}, {"id": "d.s0.x2", "xtype": "edge"})]
    df = spark.createDataFrame(rows, "class int, features map<int,double>, extra map<string,string>")
    formats.example_lines(df).coalesce(1).write.text(str(tmp_path / "ex"))
    got = formats.read_examples(spark, str(tmp_path / "ex")).collect()
    assert sorted((r["class"], r.features, r.extra) for r in got) == rows


def test_standoff(spark, tmp_path):
    (tmp_path / "a.a2").write_text("T1\tProtein 0 3;5 8\tabc fgh\nE1\tBinding:T1 Theme:T2 Cause:E2\n#1\tnote\n")
    rows = {r.id: r for r in formats.read_standoff(spark, str(tmp_path / "a.a2")).collect()}
    assert [tuple(x) for x in rows["T1"].spans] == [(0, 3), (5, 8)]
    assert rows["E1"].type == "Binding"
    assert rows["E1"].trigger == "T1"
    assert [tuple(x) for x in rows["E1"].arguments] == [("Theme", "T2"), ("Cause", "E2")]
    assert "#1" not in rows


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# x\n1\tHe\the\tPRON\t_\t_\t2\tsubj\n2\truns\trun\tVERB\t_\t_\t0\troot\n\n1\tGo\tgo\tVERB\t_\t_\t0\troot\n")
    rows = sorted((r.sent, r.idx, r.token, r.head) for r in formats.read_conllu(spark, str(tmp_path / "a.conllu")).collect())
    assert rows == [(0, 1, "He", 2), (0, 2, "runs", 0), (1, 1, "Go", 0)]


def test_follow_takes_each_file_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, "id long", lambda d: d.where("id % 2 = 0"), target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 10


def test_nearest_of_every_fiftieth_row(spark, sf, monkeypatch):
    import numpy as np
    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 3)
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = base.orderBy("vec_id").collect()
    ids, e = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    got = {}
    for r in vectors.nearest(base, asked, 4).collect():
        got.setdefault(r.query_id, []).append(round(r.similarity, 6))
    assert sorted(got) == [i for i in ids if i % 50 == 0] and len(got) == 10
    for q, found in got.items():
        best = np.sort(np.delete(e @ e[ids.index(q)], ids.index(q)))[::-1][:4]
        assert np.allclose(sorted(found, reverse=True), best, atol=2e-6)


def test_nearest_tells_equal_vectors_by_number(spark, monkeypatch):
    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "CELLS", 64)
    rng = random.Random(5)
    some = [[float(rng.randint(-3, 3)) / 7 for _ in range(9)] for _ in range(12)]
    rows = [(i, some[rng.randrange(12)]) for i in range(90)] + [(90, [0.0] * 9), (91, None), (92, [1.0, 2.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = base.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    unit = vectors.unit
    plain = base.select("vec_id", unit("embedding").alias("e")).join(asked.select("query_id", unit("q").alias("q")), F.col("vec_id") != F.col("query_id"))
    plain = plain.select("query_id", "vec_id", vectors.dot("q", "e").alias("similarity"))
    for k in (3, 91):
        found = vectors.nearest(base, asked, k)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "zip_with" not in plan
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.withColumn("_r", place).where(F.col("_r") <= k).drop("_r").collect()), key=str)
