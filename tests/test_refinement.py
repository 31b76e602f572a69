"""Classes of equal nodes, digests of event trees and their comparison against plain versions."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessera.operators import features, refinement

NODES = "doc_id long, id long, label string"
ARGS = "doc_id long, id long, role string, arg long"


def plain_keepers(labels, args):
    keeper = {n: n for n in labels}
    while True:
        first, new = {}, {}
        for n in sorted(labels):
            new[n] = first.setdefault((labels[n], tuple(sorted((r, keeper.get(a, a)) for r, a in args.get(n, ())))), n)
        if new == keeper:
            return keeper
        keeper = new


def random_nodes(rng, n):
    labels = {i: rng.choice("ab") for i in range(n)}
    args = {i: [(rng.choice("xy"), rng.choice([rng.randrange(n), max(0, i - rng.randint(1, 4)), 1000])) for _ in range(rng.randint(0, 2))] for i in labels}
    return labels, args


def tables(spark, docs):
    nodes = [(d, i, x) for d, (labels, _) in docs.items() for i, x in labels.items()]
    args = [(d, i, r, a) for d, (_, args) in docs.items() for i, found in args.items() for r, a in found]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(args, ARGS)


def test_keepers_of_random_graphs(spark):
    rng = random.Random(3)
    docs = {d: random_nodes(rng, rng.randint(1, 30)) for d in range(40)}
    # a chain of equal pairs: each round merges one more level
    docs[99] = ({i: "n" for i in range(12)}, {i: [("x", i - 2)] for i in range(2, 12)})
    want = {(d, i): k for d, x in docs.items() for i, k in plain_keepers(*x).items()}
    found = refinement.keepers(*tables(spark, docs), ["doc_id"]).collect()
    assert {(r.doc_id, r.id): r.keeper for r in found} == want and len(found) == len(want)
    assert want[99, 11] == 0 or want[99, 11] == 10


def test_endless_merging_raises(spark):
    docs = {1: ({i: "n" for i in range(8)}, {i: [("x", i - 2)] for i in range(2, 8)})}
    with pytest.raises(RuntimeError, match="still changes"):
        refinement.keepers(*tables(spark, docs), ["doc_id"], rounds=1)


def tree(i, events, entities, args, seen=()):
    if i in entities:
        return ("entity", entities[i])
    if i not in events or i in seen:
        return None
    parts = [(r, tree(a, events, entities, args, (*seen, i))) for r, a in args.get(i, ())]
    return None if any(p is None for _, p in parts) else (events[i], tuple(sorted(parts, key=repr)))


def test_digests_are_equal_for_equal_trees(spark):
    rng = random.Random(6)
    events = {i: (rng.choice("AB"), rng.choice("st")) for i in range(60)}
    entities = {i: ("E", rng.choice("uv")) for i in range(100, 108)}
    args = {i: [(rng.choice("xy"), rng.choice([rng.randrange(60), rng.randint(100, 107), 999 if rng.random() < 0.1 else 101])) for _ in range(rng.randint(0, 2))] for i in events}
    rows = lambda named: spark.createDataFrame([(0, i, *x) for i, x in named.items()], "doc_id long, id long, type string, span string")
    links = spark.createDataFrame([(0, i, r, a) for i, found in args.items() for r, a in found], ARGS)
    found = {r.id: r.digest for r in refinement.digests(rows(events), links, rows(entities), ["doc_id"]).collect()}
    want = {i: t for i in events if (t := tree(i, events, entities, args))}
    assert set(found) == set(want) and len(set(found.values())) == len(set(want.values()))
    assert len({(found[i], want[i]) for i in want}) == len(set(want.values()))


def test_outcomes_match_one_to_one(spark):
    schema = "doc_id long, id long, type string, digest string"
    p = spark.createDataFrame([(0, 1, "A", "h"), (0, 2, "A", "h"), (0, 3, "A", None), (1, 4, "B", "k")], schema)
    g = spark.createDataFrame([(0, 7, "A", "h"), (0, 8, "A", None), (2, 9, "B", "k")], schema)
    rows = refinement.scored(refinement.nested_outcomes(p, g, ["doc_id"])).collect()
    assert Counter((r.type, r.tp, r.fp, r.fn) for r in rows) == Counter([("A", 1, 2, 1), ("B", 0, 1, 1), ("micro", 1, 3, 2)])
    assert {r.type: round(r.fscore, 4) for r in rows} == {"A": 0.4, "B": 0.0, "micro": 0.2857}


def test_no_events(spark):
    nodes, args = spark.createDataFrame([], NODES), spark.createDataFrame([], ARGS)
    assert refinement.keepers(nodes, args, ["doc_id"]).count() == 0
    events = spark.createDataFrame([], "doc_id long, id long, type string, span string")
    assert refinement.digests(events, args, events, ["doc_id"]).count() == 0


def test_gram_counts_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    sents = [(d, rng.choices(["a", "b", "_", "c"], k=rng.randint(1, 14))) for d in range(30)]
    marks = {d: sorted(rng.sample(range(len(w)), rng.randint(0, len(w)))) for d, w in sents}
    toks = spark.createDataFrame([(d, 0, i, x) for d, w in sents for i, x in enumerate(w)], "doc_id long, sent long, idx int, token string")
    at = spark.createDataFrame([(d, 0, i) for d, m in marks.items() for i in m], "doc_id long, sent long, idx int")
    rows = spark.createDataFrame([(w, a, b) for d, w in sents for a in marks[d] for b in marks[d] if a < b], "tokens array<string>, a int, b int")
    each = rows.select(F.explode(features.token_grams("tokens", F.col("a"), F.col("b"))).alias("f"))
    found = {r.feature: r.n for r in features.token_gram_counts(toks, at).collect()}
    assert found == Counter(r.f for r in each.collect())


def test_region_means_of_pairs(spark):
    rng = random.Random(7)
    words = {w: [rng.random(), rng.random(), 1.0] for w in "abc"}
    sents = {d: rng.choices("abcx", k=rng.randint(1, 9)) for d in range(12)}
    pairs = [(d, 0, *rng.choices(range(len(w)), k=2)) for d, w in sents.items() for _ in range(3)]
    toks = spark.createDataFrame([(d, 0, i, x.upper()) for d, w in sents.items() for i, x in enumerate(w)], "doc_id long, sent long, idx int, token string")
    vectors = spark.createDataFrame(list(words.items()), "word string, vector array<double>")
    asked = spark.createDataFrame(pairs, "doc_id long, sent long, first_a int, first_b int")
    want = Counter()
    for d, _, a, b in pairs:
        lo, hi = min(a, b), max(a, b)
        for region, part in (("fore", sents[d][:lo]), ("between", sents[d][lo + 1 : hi]), ("after", sents[d][hi + 1 :])):
            known = [words[w] for w in part if w in words]
            if known:
                want[d, a, b, region, tuple(round(sum(x) / len(known), 9) for x in zip(*known, strict=True))] += 1
    found = features.pair_vectors(toks, asked, vectors).collect()
    assert Counter((r.doc_id, r.first_a, r.first_b, r.region, tuple(round(x, 9) for x in r.vector)) for r in found) == want
    assert features.pair_vectors(toks, asked, vectors.where("false")).count() == 0


def test_neighbour_counts_are_those_of_every_token(spark):
    rng = random.Random(12)
    rows = [([rng.choice("abcd") for _ in range(k)], [rng.random() < 0.3 for _ in range(k)], ["x"] * k) for k in (0, 1, 2, 3, 5, 9, 14)]
    df = spark.createDataFrame(rows, "tokens array<string>, given array<boolean>, tags array<string>")
    every = lambda c: Counter(r.f for r in df.select(F.explode(c).alias("f")).collect())
    counted = lambda *a, **k: {r.feature: r.n for r in features.neighbour_counts(df, "tokens", *a, **k).collect()}
    assert counted(3) == every(features.linear_in_row("tokens", 3))
    assert counted(2, first=True, tags="tags", names="given") == every(F.flatten(features.order_features("tokens", "tags", "given", 2)))


def test_sums_of_pairs_make_no_pair(spark, monkeypatch):
    from tessera.operators import text

    monkeypatch.setattr(features, "CELLS", 4)
    rng = random.Random(9)
    rows = [(d, 0, rng.choices("abcXYZ", k=rng.randint(0, 14))) for d in range(30)]
    sents = spark.createDataFrame(rows, "doc_id long, sent int, tokens array<string>").withColumn("names", text.capitalised_in_row("tokens"))
    toks = sents.select("doc_id", "sent", F.posexplode("tokens").alias("idx", "token"))
    caps = text.capitalised(toks)
    marks = F.col("names")["first"]
    grams = features.token_gram_counts_in_row(sents, marks)
    want = features.token_gram_counts(toks, caps.select("doc_id", "sent", F.col("first").alias("idx")))
    assert sorted(map(tuple, grams.collect())) == sorted(map(tuple, want.collect())) and grams.count() > 9
    assert "Window" not in grams._jdf.queryExecution().optimizedPlan().toString()
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abxy")], "word string, vector array<double>")
    sums = {(r.doc_id, r.region): (r.pairs, [round(x, 9) for x in r.vector]) for r in features.pair_vector_sums(sents, marks, vectors).collect()}
    every = {}
    for r in features.pair_vectors(toks, text.pairs(caps), vectors).collect():
        n, total = every.get((r.doc_id, r.region), (0, [0.0, 0.0]))
        every[r.doc_id, r.region] = n + 1, [x + y for x, y in zip(total, r.vector, strict=True)]
    assert sums == {k: (n, [round(x, 9) for x in total]) for k, (n, total) in every.items()} and sums


def test_region_counts_look_at_each_name_once(spark):
    from tessera.operators import text

    words = "a B c d E F g h i J k".split()
    sents = spark.createDataFrame([(1, 0, words), (2, 0, ["a", "B", "c"]), (3, 0, "x B C y D".split())], "doc_id long, sent int, tokens array<string>").withColumn("names", text.capitalised_in_row("tokens"))
    found = features.region_counts(sents)
    assert "exists" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.region, r.gram): r.n for r in found.collect()}
    assert got["fore", "c_d"] == 3 and got["between", "c_d"] == 2 and got["after", "h_i"] == 3 and got["fore", "h_i"] == 2
    assert got["fore", "a"] == 3 and ("between", "a_c") not in got and got["fore", "a_c"] == 1
    assert got["between", "y"] == 1 and ("after", "y") in got and ("fore", "x_y") not in got


def test_deep_trees_are_put_together_in_layers(spark, monkeypatch):
    monkeypatch.setattr(refinement, "LAYERS", 2)
    events = spark.createDataFrame([(0, i, "A", "s") for i in range(12)], "doc_id long, id long, type string, span string")
    # two chains of equal trees; an event of two arguments waits for the deeper one
    links = [(0, i, "x", i - 2) for i in range(2, 12)] + [(0, 10, "y", 0), (0, 11, "y", 1)]
    args = spark.createDataFrame(links, ARGS)
    found = {r.id: r.digest for r in refinement.digests(events, args, events.where("false"), ["doc_id"]).collect()}
    assert len(found) == 12 and len(set(found.values())) == 6 and all(found[i] == found[i + 1] for i in range(0, 12, 2))


def test_nodes_above_a_cycle_are_refined_after_the_others(spark, monkeypatch):
    monkeypatch.setattr(refinement, "LAYERS", 2)
    labels = {i: "n" for i in range(16)}
    args = {i: [("x", i - 2)] for i in range(2, 10)} | {10: [("x", 11)], 11: [("x", 10)]} | {i: [("x", 10), ("y", i % 2)] for i in range(12, 14)} | {i: [("x", i - 2)] for i in range(14, 16)}
    want = {(0, i): k for i, k in plain_keepers(labels, args).items()}
    found = refinement.keepers(*tables(spark, {0: (labels, args)}), ["doc_id"]).collect()
    assert {(r.doc_id, r.id): r.keeper for r in found} == want and want[0, 15] == 14
