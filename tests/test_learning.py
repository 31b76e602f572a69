"""Learning on tables that a linear model separates, and chains of steps."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import learning, text
from tessera.plans import steps


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(i, ["neg", "Gene", "Site"][i % 3], [f"word{i % 3}", f"noise{i % 7}"]) for i in range(120)]
    return spark.createDataFrame(rows, "id int, class string, names array<string>").coalesce(1).cache()


@pytest.mark.parametrize("kind", ["svm", "logistic"])
def test_learns_and_survives_saving(examples, tmp_path, kind):
    train, held = examples.where("id < 90"), examples.where("id >= 90")
    model = learning.train(train, c=10.0, size=1 << 10, kind=kind, iterations=8)
    learning.save(model, str(tmp_path / "m"))
    got = learning.classify(learning.load(str(tmp_path / "m")), held).collect()
    assert len(got) == 30
    assert all(r.predicted == r["class"] for r in got)
    assert all(max(r.scores, key=r.scores.get) == r["class"] and set(r.scores) == {"neg", "Gene", "Site"} for r in got)


def test_search_keeps_first_of_equals(examples):
    grid = [{"c": c, "size": 1 << 10, "kind": "logistic", "iterations": 8} for c in (10.0, 100.0)]
    _, setting, f = learning.search(examples.where("id < 90"), examples.where("id >= 90"), grid)
    assert setting["c"] == 10.0
    assert f == pytest.approx(1.0)


def test_steps(spark):
    docs = spark.createDataFrame([(1, "the Cat met Dog Bob and Eve\n\nno names")], "doc_id long, text string")
    assert steps.expanded(["ENTITY_PAIRS"], stop="FIND_NAMES", omit=["TOKENIZE"]) == ["SPLIT_SENTENCES", "FIND_NAMES"]
    got = sorted((r.first_a, r.first_b, r.distance) for r in steps.run(docs, ["ENTITY_PAIRS"]).collect())
    assert got == [(1, 3, 2), (1, 6, 5), (3, 6, 2)]
    same = text.tokens(text.sentences(docs)).count()
    assert steps.run(docs, ["PREPROCESS"]).count() == same
    gone = steps.run(docs, ["REMOVE_TEXTS"]).where(F.col("text").isNull()).count()
    assert gone == 1
    with pytest.raises(KeyError):
        steps.run(docs, ["NOTHING"])


def test_steps_that_merge(spark):
    own = spark.createDataFrame([(1, "train"), (2, None)], "id long, set string")
    other = spark.createDataFrame([(3, None)], "id long, set string")
    merged = steps.run(own, ["MERGE_SETS"], {"MERGE_SETS": {"name": "train", "others": {"devel": other}, "allow_none": True}})
    assert {(r.id, r.set) for r in merged.collect()} == {(1, "train"), (2, "train"), (3, "devel")}
    events = spark.createDataFrame([(0, 1, "A", []), (0, 2, "A", []), (0, 3, "B", [1]), (0, 4, "B", [2])], "g int, event long, kind string, arguments array<long>")
    assert {r.event for r in steps.run(events, ["MERGE_EVENTS"], {"MERGE_EVENTS": {"group": "g"}}).collect()} == {1, 3}
    docs = spark.createDataFrame([(1, "One here. Two there.")], "doc_id long, text string")
    assert [r.text for r in steps.run(docs, ["SPLIT_BY_RULE"]).orderBy("sent").collect()] == ["One here.", "Two there."]
