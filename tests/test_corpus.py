"""Corpus files, parses, archives, paths and models on fixtures small enough to check by eye."""

import io
import random
import tarfile
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import alignment, inference, strings
from tessera.operators import corpora, evaluation, graphs, learning, paths, search, structure, text
from tessera.sources import archives, corpus, exports, formats, parses
from tessera.streaming import windows

XML = """<corpus source="TS">
  <document id="TS.d4" origId="ART-7" set="train">
    <sentence charOffset="0-31" id="TS.d4.s0" tail="&#10;" text="Kelp9 blocks transport of Fuco2">
      <entity charOffset="0-5" headOffset="0-5" id="TS.d4.s0.e0" isName="True" text="Kelp9" type="Enzyme" />
      <entity charOffset="26-31" headOffset="26-31" id="TS.d4.s0.e1" isName="True" text="Fuco2" type="Enzyme" />
      <entity charOffset="6-12" headOffset="6-12" id="TS.d4.s0.e5" isName="False" event="True" text="blocks" type="Inhibition" />
      <entity charOffset="13-22" headOffset="13-22" id="TS.d4.s0.e6" isName="False" event="True" text="transport" type="Inhibition" />
      <entity charOffset="13-22" headOffset="13-22" id="TS.d4.s0.e7" text="transport" type="neg" />
      <interaction directed="True" e1="TS.d4.s0.e5" e2="TS.d4.s0.e6" id="TS.d4.s0.i0" type="Theme" />
      <interaction directed="True" e1="TS.d4.s0.e5" e2="TS.d4.s0.e0" id="TS.d4.s0.i1" type="Cause" />
      <interaction directed="True" e1="TS.d4.s0.e6" e2="TS.d4.s0.e1" id="TS.d4.s0.i2" type="Theme" />
      <interaction directed="True" e1="TS.d4.s0.e6" e2="TS.d4.s1.e1" id="TS.d4.s0.i3" type="Theme" />
      <pair e1="TS.d4.s0.e0" e2="TS.d4.s0.e1" id="TS.d4.s0.p0" interaction="True" />
      <pair e1="TS.d4.s0.e0" e2="TS.d4.s0.e1" id="TS.d4.s0.p1" interaction="False" />
      <analyses>
        <tokenization tokenizer="other"><token POS="X" charOffset="0-31" id="o_0" text="all" /></tokenization>
        <tokenization tokenizer="McCC">
          <token POS="NN" charOffset="0-5" headScore="1" id="tk_0" text="Kelp9" />
          <token POS="VBZ" charOffset="6-12" headScore="1" id="tk_1" text="blocks" />
          <token POS="NN" charOffset="13-22" headScore="1" id="tk_2" text="transport" />
          <token POS="IN" charOffset="23-25" headScore="0" id="tk_3" text="of" />
          <token POS="NN" charOffset="26-31" headScore="1" id="tk_4" text="Fuco2" />
        </tokenization>
        <parse parser="McCC" tokenizer="McCC" pennstring="(S1)">
          <dependency id="dp_0" t1="tk_1" t2="tk_0" type="nsubj" />
          <dependency id="dp_1" t1="tk_1" t2="tk_2" type="dobj" />
          <dependency id="dp_2" t1="tk_2" t2="tk_4" type="prep_of" />
          <phrase begin="0" charOffset="0-5" end="0" id="bp_0" type="NP" />
        </parse>
      </analyses>
    </sentence>
    <sentence charOffset="32-36" id="TS.d4.s1" text="Gone"></sentence>
  </document>
</corpus>
"""


@pytest.fixture()
def loaded(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    return corpus.load(spark, str(tmp_path / "c.xml"))


def test_corpus_tables(loaded):
    assert [(r.sent_id, r.begin, r.end) for r in loaded.sentences.orderBy("idx").collect()] == [("TS.d4.s0", 0, 31), ("TS.d4.s1", 32, 36)]
    assert {(r.ent_id[-3:].strip("."), r.given) for r in loaded.entities.collect()} == {("e0", True), ("e1", True), ("e5", False), ("e6", False)}
    assert {(r.int_id[-2:], r.type) for r in loaded.interactions.collect()} == {("i0", "Theme"), ("i1", "Cause"), ("i2", "Theme"), ("p0", "undefined")}
    assert [r.int_id for r in loaded.split.collect()] == ["TS.d4.s0.i3"]
    assert [r.text for r in loaded.tokens.orderBy("idx").collect()] == ["Kelp9", "blocks", "transport", "of", "Fuco2"]
    assert [(r.type, r.t1, r.t2) for r in loaded.dependencies.orderBy("place").collect()] == [("nsubj", "tk_1", "tk_0"), ("dobj", "tk_1", "tk_2"), ("prep_of", "tk_2", "tk_4")]


def test_corpus_round_trip(spark, loaded, tmp_path):
    corpus.write(loaded, str(tmp_path / "out"))
    back = corpus.load(spark, str(tmp_path / "out"))
    for name in loaded.names():
        assert sorted(map(str, getattr(loaded, name).collect())) == sorted(map(str, getattr(back, name).collect())), name
    corpus.write(loaded, str(tmp_path / "out"), mode="append")
    assert corpus.load(spark, str(tmp_path / "out")).documents.count() == 2


def test_corpus_by_element(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    path = str(tmp_path / "c.xml")
    assert corpus.read_elements(spark, path, limit=0).count() == 0
    assert [len(r["sentence"]) for r in corpus.iterate(spark, path, "McCC")] == [2]
    assert [r["sentence"][0]["tokens"] for r in corpus.iterate(spark, path, "none")] == [None]


def test_marks_of_tokens(loaded):
    marks = {r.idx: (r.is_entity, r.is_name, [h[-3:].strip(".") for h in r.heads]) for r in corpora.token_marks(loaded.tokens, loaded.entities).collect()}
    assert marks == {0: (True, True, ["e0"]), 1: (True, False, ["e5"]), 2: (True, False, ["e6"]), 3: (False, False, []), 4: (True, True, ["e1"])}


def test_emptied_corpus_has_no_answers(loaded):
    ents, ints = corpora.emptied(loaded.entities, loaded.interactions, "non-given")
    assert {r.type for r in ents.collect()} == {"Enzyme"} and ints.count() == 0
    with pytest.raises(ValueError):
        corpora.emptied(loaded.entities, loaded.interactions, "some")


def test_every_dependency_decides_heads():
    assert alignment.head_scores(["a", "b"], [(0, 1, "nsubj")]) == [2, 1]
    assert alignment.head_scores(["a", "-", "c", "d"], [(1, 0, "x"), (2, 1, "y")]) == [1, 2, 3, 0]
    # a cycle is cut off after 21 passes
    assert alignment.head_scores(["a", "b"], [(0, 1, "x"), (1, 0, "x")]) == [42, 43]


def test_ties_and_walks_of_a_small_graph():
    edges = [("s", "p", "one"), ("s", "q", "two"), ("q", "s", "two"), ("p", "t", "x"), ("q", "t", "y"), ("q", "t", "z"), ("t", "v", "w"), ("v", "p", "u")]
    found = graphs.shortest_paths(["s", "p", "q", "t", "v", "lone"], [(a, b) for a, b, _ in edges], directed=True)
    assert found["s", "t"] == [["s", "p", "t"], ["s", "q", "t"]] and ("t", "lone") not in found
    assert [[e[2] for e in w] for w in paths.walks(["s", "q", "t"], edges, directed=True)] == [["two", "y"], ["two", "z"]]
    assert [[e[2] for e in w] for w in paths.walks(["t", "q", "s"], edges)] == [["y", "two"], ["y", "two"], ["z", "two"], ["z", "two"]]


def random_graph(rng, n):
    kinds = ["a", "b", "c"]
    return [(rng.randrange(n), rng.randrange(n), rng.choice(kinds)) for _ in range(rng.randint(0, 2 * n))]


def test_search_against_all_paths(monkeypatch):
    monkeypatch.setattr(search, "CELLS", 20)
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 9)
        edges = [(a, b) for a, b, _ in random_graph(rng, n)]
        for directed in (False, True):
            want = graphs.shortest_paths(list(range(n)), [e for e in edges if e[0] != e[1]], directed)
            graph = search.Graph(n, *np.array(edges, np.int64).reshape(-1, 2).T, directed)
            for sources, depth, ties in graph.searches(np.arange(n)):
                for i, a in enumerate(sources.tolist()):
                    for b in range(n):
                        if a != b:
                            assert (depth[i, b], ties[i, b]) == ((len(want[a, b][0]) - 1, len(want[a, b])) if (a, b) in want else (-1, 0))
                    if not directed:
                        near = [b for b in range(n) if (a, b) in want]
                        nodes, at = graph.first_paths(depth, np.full(len(near), i), np.array(near, np.int64))
                        assert [nodes[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [min(want[b, a]) for b in near]
                        assert all(list(graph.tied_paths(depth[i], b)) == sorted(want[b, a]) for b in near)


def test_ties_of_many_diamonds():
    # each of 80 diamonds doubles the paths: they are counted, and only the one asked for is made
    edges = [(3 * i + a, 3 * i + b) for i in range(80) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    graph = search.Graph(241, *np.array(edges).T)
    depth, ties = graph.search(np.array([240]))
    assert depth[0, 0] == 160 and ties[0, 0] == 2.0**80 and search.counts(ties)[0, 0] == 2**62
    nodes, _ = graph.first_paths(depth, np.array([0]), np.array([0]))
    assert nodes.tolist() == [x for i in range(80) for x in (3 * i, 3 * i + 1)] + [240]
    assert next(graph.tied_paths(depth[0], 0)) == nodes.tolist()


def test_features_of_a_path():
    words, tags = ["Kelp9", "blocks", "transport", "of", "Fuco2"], ["NN", "VBZ", "NN", "IN", "NN"]
    edges = {(1, 0): ["nsubj"], (1, 2): ["dobj"], (2, 4): ["prep_of"]}
    types = [["Enzyme"], ["Reg"], ["Reg"], [], ["Enzyme"]]
    f = paths.path_features(words, tags, types, edges, [0, 1, 2, 4])
    assert f["len"] == 4 and f["len_tokens_4"] == 1 and "edge_directions_RFF" in f
    assert {"tokTerm1_txt_Kelp9", "tokTerm2_txt_Fuco2", "dep_nsubjForward_", "dep_Reverse_dobj", "internalTxt_blocks", "internalDep_dobj", "depGram_RF_nsubj_dobj", "Enzyme_depGram_FF_dobj_prep_of_Enzyme", "gov_blocks_Kelp9", "triple_Reg_dobj_Reg"} <= set(f)
    assert "depGram_RFF_nsubj_dobj_prep_of" in f and not any(k.startswith("depGram_RFFF") for k in f)


def test_grams_are_those_of_all_walks():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(2, 6)
        edges = [(i + a, i + 1 - a, rng.choice("xyz")) for i in range(n - 1) for a in rng.choices((0, 1), k=rng.randint(1, 3))]
        by_step = {}
        for g, d, t in edges:
            by_step.setdefault((g, d), []).append(t)
        got = paths.path_features(["w"] * n, ["T"] * n, [[]] * n, by_step, range(n))
        want = set()
        for walk in paths.walks(range(n), edges):
            way = "".join("F" if e[0] == k else "R" for k, e in enumerate(walk))
            want.add(f"edge_directions_{way}")
            want |= {f"depGram_{way[k : k + m]}" + "".join(f"_{e[2]}" for e in walk[k : k + m]) for m in (2, 3, 4) for k in range(n - m)}
        assert {f for f in got if f.startswith(("depGram_", "edge_"))} == want


def test_kernel_of_a_chain():
    k = paths.kernel_matrix(2, [(0, 1, "x")], on_path=[0, 1], weight=0.5)
    # the dependency node is reached with 0.5 from the governor, the dependent with 0.25
    assert k.shape == (5, 5) and k[0, 4] == 0.5 and k[4, 1] == 0.5 and k[0, 1] == 0.25 and k[2, 3] == 0.5


def test_paths_with_an_edge_filter(spark):
    toks = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("abcd")], "doc_id long, sent long, idx long, token string")
    deps = spark.createDataFrame([(1, 0, 0, 1, "x"), (1, 0, 1, 2, "punct"), (1, 0, 2, 3, "x")], "doc_id long, sent long, gov long, dep long, type string")
    found = {(r.a, r.b): r.path for r in paths.path_rows(toks, deps, lambda t: t != "punct", toks.select("doc_id", "sent", F.col("idx").alias("a"), F.lit(3).alias("b")).union(spark.createDataFrame([(1, 0, 0, 1)], "d long, s long, a long, b int"))).collect()}
    assert found == {(0, 1): [0, 1], (2, 3): [2, 3]}
    assert {(r.a, r.b, r.length) for r in paths.path_rows(toks, deps).collect()} == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_line_starts_of_many_lines(spark):
    rng = random.Random(1)
    lines = ["x" * rng.randint(0, 5) for _ in range(1000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id long, text string")
    want, at = {}, 0
    for i, x in enumerate(lines):
        if x:
            want[i] = (at, at + len(x))
        at += len(x) + 1
    got = text.sentences(df).collect()
    assert {r.sent: (r.begin, r.end) for r in got} == want and {r.doc_id for r in got} == {1}


def test_nesting_has_no_depth_limit(spark):
    n = 40
    rows = [(1, f"e{i}", "A" if i % 2 else "B", [f"e{i + 1}"] if i < n - 1 else []) for i in range(n)]
    got = structure.nesting(spark.createDataFrame(rows, "doc_id int, id string, type string, arguments array<string>")).collect()
    assert [(r.chain.count(">"), r.n) for r in got] == [(n - 1, 1)]


def test_loops_raise_when_cut_short(spark):
    rows = [(1, f"e{i}", [f"e{i - 1}"] if i else []) for i in range(6)]
    events = spark.createDataFrame(rows, "doc_id int, id string, arguments array<string>")
    given = spark.createDataFrame([], "doc_id int, id string")
    assert structure.grown_events(events, given).count() == 6
    with pytest.raises(RuntimeError, match="still changes"):
        structure.grown_events(events, given, rounds=3)


def test_kendall_against_all_pairs(spark):
    rng = random.Random(4)
    xy = [(rng.randrange(200), rng.randrange(150)) for _ in range(300)]
    sign = lambda v: (v > 0) - (v < 0)
    e = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(xy) for b in xy[:i])
    n = len(xy) * (len(xy) - 1) / 2
    tied = lambda k: sum(c * (c - 1) / 2 for c in Counter(v[k] for v in xy).values())
    got = inference.kendall(spark.createDataFrame(xy, "x long, y long"), "x", "y", blocks=8).first()
    assert got.n == 300 and abs(got.tau - e / ((n - tied(0)) * (n - tied(1))) ** 0.5) < 1e-12


def test_linear_model_of_two_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    beta, f, df_model, df_error = inference.linear_model(df, "y", ["a", "b"])
    want, rest, *_ = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)
    assert np.allclose(beta, want) and (df_model, df_error) == (2, 77)
    assert abs(f - (((y - y.mean()) ** 2).sum() - rest[0]) / 2 / (rest[0] / 77)) < 1e-6
    assert inference.f_multivariate(np.eye(2) * 3, np.eye(2), 2, 4) == pytest.approx(16.0)


def test_relaxed_entities_may_be_a_token_off(spark):
    cols = "sent long, id string, type string, begin long, end long, head_begin long, head_end long, given boolean"
    p = spark.createDataFrame([(1, "p1", "A", 4, 7, 4, 7, False), (1, "p2", "A", 12, 15, 12, 15, False)], cols)
    g = spark.createDataFrame([(1, "g1", "A", 8, 11, 8, 11, False)], cols)
    toks = spark.createDataFrame([(1, i, 4 * i, 4 * i + 3) for i in range(6)], "sent long, idx long, begin long, end long")
    found = evaluation.mapped_entities(p, g, ["sent"], "relaxed", toks).collect()
    assert {(r.p, r.g) for r in found} == {("p1", "g1"), ("p2", "g1")}
    assert {(r.p, r.g) for r in evaluation.mapped_entities(p, g, ["sent"]).collect()} == {("p1", None), ("p2", None), (None, "g1")}


def test_auc_is_0_without_a_class(spark):
    m = spark.createDataFrame([(0, 0, 5), (0, 1, 2)], "truth int, predicted int, n long")
    assert evaluation.binary(m, 0).first().auc == 0


def test_standoff_of_all_kinds(spark, tmp_path):
    lines = ["T1\tProtein 0 3;5 8\tabc fgh", "W2\tWord 1 2\tx", "E1\tBinding:T1 Theme:T2 Cause:E2", "M1\tNegation E1", "N1\tGene_Identifier Annotation:T1 Referent:Entrez:12", "*\tEquiv T1 T2 T3"]
    (tmp_path / "a.a2").write_text("\n".join([*lines, "#1\tnote"]) + "\n")
    rows = formats.read_standoff(spark, str(tmp_path / "a.a2"))
    assert sorted(r.value for r in formats.standoff_lines(rows).collect()) == sorted(lines)
    assert {r.id: [a.target for a in r.arguments] for r in rows.where("kind in ('N', '*')").collect()} == {"N1": ["T1", "Entrez:12"], "*": ["T1", "T2", "T3"]}


def test_annotated_archives(spark, tmp_path):
    files = {"set/a.txt": "abc def", "set/a.a1": "T1\tGene 0 3\tabc\n", "set/a.a2": "E1\tBind:T1\n", "set/b.a2": "E1\tLost:T9\n"}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as t:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content.encode()))
    (tmp_path / "plain").mkdir()
    for name, content in files.items():
        (tmp_path / "plain" / name.split("/")[1]).write_text(content)
    for path in ("x.zip", "y.tar.gz", "plain"):
        docs, lines = formats.load(spark, str(tmp_path / path))
        assert [(r.doc, r.text) for r in docs.collect()] == [("a", "abc def")]
        assert sorted((r.part, r.id, r.type) for r in lines.collect()) == [("a1", "T1", "Gene"), ("a2", "E1", "Bind")]


def test_articles_and_drugs(spark, tmp_path):
    (tmp_path / "p.nxml").write_text('<article><front><article-meta><article-id pub-id-type="pmid">7</article-id><title-group><article-title>On <b>cells</b></article-title></title-group></article-meta></front><body><sec id="s1"><title>Start</title><p>One.</p><fig>no</fig></sec></body></article>')
    rows = archives.read_articles(spark, str(tmp_path / "p.nxml")).orderBy("section").collect()
    assert [(r.doc_id, r.type) for r in rows][:1] == [("PMC.d7", "article-title")]
    assert {(r.type, r.text) for r in rows} >= {("title", "Start"), ("p", "One.")} and not any("fig" in r.path for r in rows)
    (tmp_path / "d.xml").write_text("<drugbank><drug><drugbank-id>D1</drugbank-id><name>Aspirin</name><synonyms><synonym>ASA</synonym></synonyms><drug-interactions><drug-interaction><drug>D2</drug></drug-interaction></drug-interactions></drug></drugbank>")
    names, links = archives.read_drugs(spark, str(tmp_path / "d.xml"))
    assert {(r.name, r.id) for r in names.collect()} == {("Aspirin", "D1"), ("ASA", "D1")} and [(r.a, r.b) for r in links.collect()] == [("D1", "D2")]


def test_column_formats(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# id = 1\n1\tHe\the\tPRON\t_\t_\t2\tsubj\t_\t_\n2\truns\trun\t_\tVBZ\t_\t0\troot\t1:back\t_\n\n1\tYes\t_\tINTJ\t_\t_\t0\troot\t_\t_\n")
    words = parses.read_conll(spark, str(tmp_path / "a.conllu"))
    assert [(r.sent, r.token, r.pos) for r in words.orderBy("sent", "idx").collect()] == [(0, "He", "PRON"), (0, "runs", "VBZ"), (1, "Yes", "INTJ")]
    deps = {(r.type, r.gov, r.dep, r.secondary) for r in parses.conll_dependencies(words).collect()}
    assert deps == {("subj", "2", "1", False), ("back", "1", "2", True)}
    docs = spark.createDataFrame([("C.d0", "a")], "doc_id string, orig_id string")
    assert {r.doc_id for r in parses.imported(words, docs).collect()} == {"C.d0"}
    (tmp_path / "b.conllx").write_text("1\tHe\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        parses.read_conll(spark, str(tmp_path / "b.conllx")).collect()


def test_submission_lines(spark, loaded):
    lines = {r.value for r in exports.pair_lines(loaded.entities, loaded.interactions).collect()}
    assert "TS.d4.s0|TS.d4.s0.e5|TS.d4.s0.e6|1|Theme" in lines and "TS.d4.s0|TS.d4.s0.e1|TS.d4.s0.e6|1|Theme" in lines and len(lines) == 6
    assert "TS.d4.s0|0-4|Kelp9|Enzyme" in {r.value for r in exports.entity_lines(loaded.entities).collect()}
    row = spark.createDataFrame([(["a", "<b"], [(1, 0, "x")])], "words array<string>, edges array<struct<gov:int,dep:int,type:string>>")
    picture = row.select(exports.arc_picture(F.col("words"), F.col("edges"))).first()[0]
    assert picture.startswith("<svg") and "&lt;b" in picture and picture.count("<path") == 1


def test_parameter_strings():
    assert strings.parameters("a:b=1,2:c=(x:y),z:d='p:q'") == {"a": True, "b": ["1", "2"], "c": ["(x:y)", "z"], "d": "'p:q'"}
    assert strings.parameter_string({"b": ["1", "2"], "a": True, "c": None}) == "a:b=1,2"
    assert strings.with_defaults("c=2", {"c": "1", "k": None}) == {"c": "2", "k": None}
    with pytest.raises(KeyError):
        strings.with_defaults("x", {"c": 1})


def test_models_are_packed_with_tables(spark, tmp_path):
    rows = [(["a", f"n{i % 3}"], "pos" if i % 2 else "neg") for i in range(40)]
    rows = [(names + (["good"] if c == "pos" else ["bad"]), c) for names, c in rows]
    df = spark.createDataFrame(rows, "names array<string>, class string")
    model = learning.train(df, size=64)
    exports.save_model(model, str(tmp_path / "m"), {"task": "x"}, {"labels": df.select("class").distinct()})
    back, about, tables = exports.load_model(str(tmp_path / "m"))
    assert about == {"task": "x"} and sorted(r[0] for r in tables["labels"].collect()) == ["neg", "pos"]
    found = learning.classify(back, df)
    assert found.where("predicted = class").count() == 40
    assert {r["class"] for r in learning.weights(model).collect()} == {"neg", "pos"}


def test_events_are_detected_in_two_steps(spark):
    trig = spark.createDataFrame([(i, ["up"] if i % 2 else ["of"], "Reg" if i % 2 else "neg") for i in range(40)], "id long, names array<string>, class string")
    edge = spark.createDataFrame([(i, j, ["near"] if j else ["far"], "Theme" if j else "neg") for i in range(40) for j in (0, 1)], "id long, arg int, names array<string>, class string")
    triggers, edges = learning.detect_events((trig, edge), (trig, edge), ["id"])
    assert {r.id % 2 for r in triggers.collect()} == {1}
    assert {(r.id % 2, r.arg, r["class"]) for r in edges.collect()} == {(1, 1, "Theme")}
    assert learning.detector("edges")[0].__name__ == "edge_examples"


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 1, 2, 20, 21, 59])]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit(1).alias("k"), F.col("t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windows.sessions(stream, "ts", "10 minutes", ["k"], {"n": F.count("*")}, late="0 minutes")
    query = out.writeStream.format("memory").queryName("sessions_seen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    closed = sorted(r.n for r in spark.table("sessions_seen").collect())
    whole = sorted(r.n for r in windows.sessions(df, "ts", "10 minutes", ["k"], {"n": F.count("*")}).collect())
    # the last session is still open behind the watermark
    assert whole == [1, 2, 3] and closed == [2, 3]


def test_results_of_logs(spark, tmp_path):
    line = " ==[ALL-TOTAL]==   10 (   5)   8 (   5)    50.00    62.50    55.56"
    for name in ("m1", "m2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.txt").write_text(f"start\ndevel set results\n{line}\ntest set results\n{line.replace('55.56', '44.00')}\n")
    rows = formats.read_results(spark, str(tmp_path))
    assert rows.count() == 4 and {r.category for r in rows.collect()} == {"==[ALL-TOTAL]=="}
    out = formats.combined_results(rows, "==[ALL-TOTAL]==").orderBy("submission").collect()
    assert [(r.submission, r["fscore:devel"], r["fscore:test"]) for r in out] == [("m1", 55.56, 44.0), ("m2", 55.56, 44.0)]


def test_chains_of_steps_on_elements(spark, tmp_path):
    from tessera.plans import steps

    (tmp_path / "c.xml").write_text(XML)
    elements = corpus.read_elements(spark, str(tmp_path / "c.xml"))
    bare = steps.run(elements, ["CLEAR_PARSE"], omit=["REMOVE_HEADS"])
    assert "analyses" not in bare.schema["sentence"].dataType.elementType.names
    assert steps.expanded(["CLEAR_PARSE"]) == ["REMOVE_ANALYSES", "REMOVE_HEADS"]
