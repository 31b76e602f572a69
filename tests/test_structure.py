"""Structural rules, write-back and examples on annotation small enough to check by eye."""

from pyspark.sql import functions as F

from tessera.operators import evaluation, features, sets, structure, text

ENT = "doc_id int, id string, type string, given boolean"
REL = "doc_id int, id string, type string, a string, b string"


def test_validate_reaches_fixpoint(spark):
    ents = spark.createDataFrame([(1, "g", "Gene", True), (1, "x", "Bind", False), (1, "y", "Reg", False), (1, "z", "Reg", False)], ENT)
    rels = spark.createDataFrame([(1, "r1", "Theme", "y", "x"), (1, "r2", "Theme", "z", "g"), (1, "r3", "Cause", "x", "g")], REL)
    schema = spark.createDataFrame([("Theme", "Reg", "Bind"), ("Theme", "Reg", "Gene"), ("Theme", "Bind", "Gene")], "type string, type_a string, type_b string")
    needs = spark.createDataFrame([("Reg", "Theme", 1), ("Bind", "Theme", 1)], "type string, argument string, least int")
    e, r = structure.validate(ents, rels, schema, needs)
    # r3 is not in the schema, so x lacks its theme and goes, then r1 and with it y
    assert sorted(x.id for x in e.collect()) == ["g", "z"]
    assert [x.id for x in r.collect()] == ["r2"]


def test_grown_events_drop_cycles(spark):
    ev = spark.createDataFrame([(1, "e1", ["p"]), (1, "e2", ["e1", "p"]), (1, "e3", ["e4"]), (1, "e4", ["e3"]), (1, "e5", ["nowhere"])], "doc_id int, id string, arguments array<string>")
    given = spark.createDataFrame([(1, "p")], "doc_id int, id string")
    assert {r.id: r.level for r in structure.grown_events(ev, given).collect()} == {"e1": 0, "e2": 1}


def test_modifiers(spark):
    ev = spark.createDataFrame([(1, "e1"), (1, "e2"), (1, "e3")], "doc_id int, id string")
    p = spark.createDataFrame([(1, "e1", "negation---speculation"), (1, "e2", "neg")], "doc_id int, id string, class string")
    assert {r.id: (r.negation, r.speculation) for r in structure.with_modifiers(ev, p).collect()} == {"e1": (True, True), "e2": (False, False), "e3": (False, False)}


def test_deduplicated_moves_relations(spark):
    ents = spark.createDataFrame([(1, "a", "Gene", "0-3", True), (1, "b", "Gene", "0-3", False), (1, "c", "Site", "5-9", False)], "doc_id int, id string, type string, spans string, given boolean")
    rels = spark.createDataFrame([(1, "r1", "T", "a", "c"), (1, "r2", "T", "b", "c"), (1, "r3", "T", "c", "gone")], REL)
    e, r = structure.deduplicated(ents, rels)
    assert sorted(x.id for x in e.collect()) == ["a", "c"]
    assert sorted((x.id, x.a, x.b) for x in r.collect()) == [("r1", "a", "c"), ("r3", "c", "gone")]


def test_chased(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (32, 30)], "id int, target int")
    got = {r.id: r.root for r in structure.chased(links).collect()}
    assert all(got[i] == 20 for i in range(20))
    assert got[30] is None
    assert got[32] is None


def test_nesting(spark):
    ev = spark.createDataFrame([(1, "e1", "Reg", ["e2", "p"]), (1, "e2", "Bind", ["p"]), (1, "e3", "Loc", ["p"])], "doc_id int, id string, type string, arguments array<string>")
    assert {r.chain: r.n for r in structure.nesting(ev).collect()} == {"Reg>Bind": 1, "Loc": 1}


def test_unmerging(spark):
    args = spark.createDataFrame([(1, "t", "Bind", "Theme", "p"), (1, "t", "Bind", "Theme", "q"), (1, "t", "Bind", "Site", "s")], "doc_id int, trigger string, type string, role string, arg string")
    gold = spark.createDataFrame([(1, "t", ["Theme:q", "Theme:p"])], "doc_id int, trigger string, arguments array<string>")
    got = {tuple(r.arguments): r["class"] for r in structure.unmerging_examples(args, gold, lambda _: {"Theme": (1, 2), "Site": (0, 1)}).collect()}
    assert len(got) == 6
    assert got["Theme:p", "Theme:q"] == "Bind"
    assert sum(c == "Bind" for c in got.values()) == 1


def test_undirected_edges_merge_types(spark):
    ents = spark.createDataFrame([(1, 0, i) for i in (1, 2, 3)], "doc_id int, sent int, id int")
    rels = spark.createDataFrame([(1, 0, 2, 1, "B"), (1, 0, 1, 2, "A")], "doc_id int, sent int, a int, b int, type string")
    got = {(r.a, r.b): r["class"] for r in features.edge_examples(ents, rels, directed=False).collect()}
    assert got == {(1, 2): "A---B", (1, 3): "neg", (2, 3): "neg"}


def test_cosine(spark):
    counts = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 2), (3, "z", 1)], "doc int, word string, n int")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    got = {(r.a, r.b): round(r.cosine, 6) for r in features.similarity(counts, "a", "b", "word", "n", pairs).collect()}
    assert got == {(1, 2): 0.707107, (1, 3): 0.0}


def test_l1_of_zero(spark):
    got = spark.range(1).select(features.l1(F.create_map(F.lit("a"), F.lit(0.0))).alias("m"), features.l1(F.create_map(F.lit("a"), F.lit(-1.0), F.lit("b"), F.lit(3.0))).alias("w")).first()
    assert got.m == {"a": 0.0}
    assert got.w == {"a": -0.25, "b": 0.75}


def test_boost_search_takes_first_of_equals(spark):
    rows = [("a", {"a": 0.5, "neg": 0.6}), ("neg", {"a": 0.1, "neg": 0.9}), ("a", {"a": 0.4, "neg": 0.45})]
    df = spark.createDataFrame(rows, "truth string, scores map<string,double>")
    got = evaluation.boost_search(df, "scores", "truth", "neg", [1.0, 0.8, 0.7])
    assert tuple(got.first()) == (0.8, 1.0)


def test_divide_and_grid(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "devel"), (3, None), (4, "test")], "k int, set string")
    assert sets.divide(df, str(tmp_path / "d"), {"train-and-devel": ["train", "devel"]}) == 1
    got = sorted((r.k, r.set) for r in spark.read.parquet(str(tmp_path / "d")).collect())
    assert got == [(1, "train"), (1, "train-and-devel"), (2, "devel"), (2, "train-and-devel"), (4, "test")]
    assert sets.grid(c=[1, 2], d=["x"]) == [{"c": 1, "d": "x"}, {"c": 2, "d": "x"}]


def test_matched_phrases(spark):
    phrases = spark.createDataFrame([(1, "p", 3, 6), (1, "q", 40, 41)], "doc_id int, phrase string, begin int, end int")
    ents = spark.createDataFrame([(1, "e1", 0, 9, False), (1, "e3", 3, 7, False), (1, "e2", 2, 6, False), (1, "g", 3, 6, True)], "doc_id int, id string, begin int, end int, given boolean")
    assert [tuple(r) for r in text.matched_phrases(phrases, ents).collect()] == [(1, "p", "e2")]
