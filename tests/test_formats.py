"""Readers and writers on small files; round trips where both exist."""

import struct

from pyspark.sql import functions as F

from tessera.functions import alignment
from tessera.operators import graphs
from tessera.sources import formats


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_standoff_round_trip(spark, tmp_path):
    text = "T1\tProtein 0 3;5 8\tabc fgh\nE1\tBinding:T1 Theme:T2 Cause:E2\nR1\tPart Arg1:T1 Arg2:T2\nE3\tGone:T4"
    path = put(tmp_path, "a.a2", text + "\n")
    lines = [r.value for r in formats.standoff_lines(formats.read_standoff(spark, path)).collect()]
    assert sorted(lines) == sorted(text.split("\n"))


def test_conllu_round_trip(spark, tmp_path):
    text = "1\tHe\the\tPRON\t_\t_\t2\tsubj\t_\t_\n2\truns\trun\tVERB\t_\t_\t0\troot\t_\t_\n"
    got = formats.conllu_lines(formats.read_conllu(spark, put(tmp_path, "a.conllu", text))).collect()
    assert [r.value for r in got] == [text]


def test_predictions(spark, tmp_path):
    got = formats.read_predictions(spark, put(tmp_path, "p", "2 -0.5 1.25\n1 3 -1\n"), ["neg", "Near"]).collect()
    assert [(r.predicted, r.scores) for r in got] == [("Near", {"neg": -0.5, "Near": 1.25}), ("neg", {"neg": 3.0, "Near": -1.0})]


def test_dependencies(spark, tmp_path):
    got = formats.read_dependencies(spark, put(tmp_path, "d", "nsubj(runs-2, He-1)\nnoise\n\ndobj(see-1, x-y-3)\n")).collect()
    assert [(r.sent, r.type, r.gov, r.dep) for r in got] == [(0, "nsubj", 1, 0), (1, "dobj", 0, 2)]


def test_trees(spark, tmp_path):
    got = formats.read_trees(spark, put(tmp_path, "t", "(S1 (S (NP (DT The) (NN cat)) (VP (VBZ runs))))\n\n")).collect()
    assert len(got) == 1
    assert got[0].tokens == ["The", "cat", "runs"]
    assert [tuple(p) for p in got[0].phrases] == [("NP", 0, 1), ("VP", 2, 2), ("S", 0, 2), ("S1", 0, 2)]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(b"3 2\n" + b"".join(w + b" " + struct.pack("<2f", x, -x) + b"\n" for w, x in ((b"a", 1.0), (b"b\xc3\xa9", 2.5), (b"c", 0.0))))
    got = formats.read_vectors(spark, str(tmp_path / "v.bin"), most=2).collect()
    assert [(r["rank"], r.word, r.vector) for r in got] == [(0, "a", [1.0, -1.0]), (1, "bé", [2.5, -2.5])]


def test_ontology_with_ancestors(spark, tmp_path):
    text = 'format-version: 1.2\n\n[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nname: soil\nsynonym: "earth" EXACT []\nis_a: X:1 ! root\n\n[Term]\nid: X:3\nname: clay\nis_a: X:2 ! soil\n'
    terms = formats.load(spark, put(tmp_path, "o.obo", text), "ontology")
    assert {r.id: (r.name, r.synonyms) for r in terms.collect()} == {"X:1": ("root", []), "X:2": ("soil", ["earth"]), "X:3": ("clay", [])}
    up = graphs.ancestors(terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent")))
    assert sorted(map(tuple, up.collect())) == [("X:2", "X:1"), ("X:3", "X:1"), ("X:3", "X:2")]


def test_small_writers(spark):
    df = spark.createDataFrame([("d_1", "Near", 0.5), ("d2", "neg", None)], "id string, type string, score double")
    assert [r.value for r in formats.submission_lines(df, ["id", "type"]).collect()] == ["d_1\tNear"]
    assert formats.json_lines(df).first().value == '{"id":"d_1","type":"Near","score":0.5}'
    assert r"d\_1 & Near & 0.5 \\" in formats.latex_table(df)


def test_alignment():
    assert alignment.aligned("abc", "abc") == [(0, 0), (1, 1), (2, 2)]
    assert alignment.aligned("abc", "ac") == [(0, 0), (1, -1), (2, 1)]
    assert alignment.aligned("", "x") == [(-1, 0)]
    assert alignment.token_offsets("The  cat.", ["The", "cat", "."]) == [(0, 3), (5, 8), (8, 9)]
    assert alignment.token_offsets('a "b" c', ["a", "``", "b", "''", "c"])[::2] == [(0, 1), (3, 4), (6, 7)]


def test_offsets_column(spark):
    df = spark.createDataFrame([("ab c", ["ab", "c"]), (None, ["x"]), ("", [])], "text string, toks array<string>")
    got = [r.o for r in df.select(alignment.offsets("text", "toks").alias("o")).collect()]
    assert [tuple(x) for x in got[0]] == [(0, 2), (3, 4)]
    assert got[1:] == [None, []]


def test_heads(spark):
    toks = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate(["big", "red", "dog", "-"])], "doc_id int, sent int, idx int, token string")
    deps = spark.createDataFrame([(1, 0, 2, 0, "amod"), (1, 0, 2, 1, "amod"), (1, 0, 1, 0, "x")], "doc_id int, sent int, gov int, dep int, type string")
    ents = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 0, 1)], "doc_id int, sent int, first int, last int")
    assert {(r.first, r.last): r.head for r in alignment.heads(ents, toks, deps).collect()} == {(0, 3): 2, (0, 1): 1}
    assert max(alignment.head_scores(["a", "b"], [(0, 1, "nn"), (1, 0, "nn")])) < 60


def test_split_at(spark):
    got = spark.range(1).select(alignment.split_at(F.lit(2), F.lit(9), F.array(F.lit(5), F.lit(2), F.lit(7), F.lit(5), F.lit(11))).alias("s")).first().s
    assert [tuple(x) for x in got] == [(2, 5), (5, 7), (7, 9)]


def test_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "adoption": "adopt", "effective": "effect", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll", "generalizations": "gener"}
    assert {w: alignment.stem(w) for w in known} == known
    df = spark.createDataFrame([("Cats",), (None,)], "w string")
    assert {r.w: r.stem for r in alignment.stemmed(df, "w").collect()} == {"Cats": "cat", None: None}
