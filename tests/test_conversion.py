"""Standoff rows through the flat tables and back, compared as trees."""

import random
from collections import Counter

from tessera.sources import conversion, formats


def random_document(rng, doc):
    lines = [f"T{i}\t{rng.choice('AB')} {5 * i} {5 * i + 3}\tw{i}" for i in range(1, 5)]
    n = rng.randint(0, 6)
    triggers = [f"T{10 + i}\t{'Bind' if i % 2 else 'Reg'} {100 + i} {101 + i}\tt{i}" for i in range(3)]
    used = set()
    for e in range(1, n + 1):
        t = rng.randrange(3)
        used.add(t)
        targets = [f"T{rng.randint(1, 4)}", *([f"E{rng.randrange(1, e)}"] if e > 1 else [])]
        args = " ".join(f"{rng.choice(['Theme', 'Cause'])}:{x}" for x in rng.sample(targets, rng.randint(0, len(targets))))
        lines.append(f"E{e}\t{'Bind' if t % 2 else 'Reg'}:T{10 + t}" + (f" {args}" if args else ""))
        if rng.random() < 0.3:
            lines.append(f"M{e}\t{rng.choice(['Negation', 'Speculation'])} E{e}")
    lines += [triggers[t] for t in used]
    if n and rng.random() < 0.7:
        lines.append("R1\tSame Arg1:T1 Arg2:E1")
    return [(doc, x) for x in lines]


def trees(rows, doc):
    own = {r.id: r for r in rows if r.doc == doc}
    place = lambda i: (own[i].type, tuple((s.b, s.e) for s in own[i].spans), own[i].text)

    def tree(i):
        r = own[i]
        return place(i) if r.kind == "T" else (r.type, place(r.trigger), tuple(sorted((a.role, tree(a.target)) for a in r.arguments or ())))

    out = Counter()
    for r in own.values():
        if r.kind == "E":
            marks = tuple(sorted(m.type for m in own.values() if m.kind == "M" and m.arguments[0].target == r.id))
            out["E", str(tree(r.id)), marks] += 1
        elif r.kind == "T":
            out["T", str(place(r.id))] += 1
        elif r.kind == "R":
            out["R", r.type, str([(a.role, tree(a.target)) for a in r.arguments])] += 1
    return out


def test_round_trip_of_random_documents(spark):
    rng = random.Random(9)
    lines = [x for d in range(25) for x in random_document(rng, d)]
    rows = formats.parse_standoff(spark.createDataFrame(lines, "doc long, value string"), ["doc"]).cache()
    back = conversion.standoff(*conversion.flat(rows, ["doc"]), ["doc"]).collect()
    before = rows.collect()
    for d in range(25):
        assert trees(back, d) == trees(before, d)
    assert len({(r.doc, r.id) for r in back}) == len(back)


def test_one_entity_a_trigger(spark):
    lines = ["T1\tA 0 3\tabc", "T2\tReg 5 8\tups", "E1\tReg:T2 Theme:T1", "E2\tReg:T2 Theme:T1 Cause:E1", "M1\tNegation E2", "E3\tReg"]
    rows = formats.parse_standoff(spark.createDataFrame([(1, x) for x in lines], "doc long, value string"), ["doc"])
    entities, links = conversion.flat(rows, ["doc"], by_trigger=True)
    assert {(r.id, r.given, r.event, r.negation) for r in entities.collect()} == {("T1", True, False, False), ("T2", False, True, True)}
    assert {(r.e1, r.e2, r.type) for r in links.collect()} == {("T2", "T1", "Theme"), ("T2", "T2", "Cause")} and links.count() == 2


def test_no_annotation(spark):
    rows = formats.parse_standoff(spark.createDataFrame([], "doc long, value string"), ["doc"])
    assert conversion.standoff(*conversion.flat(rows, ["doc"]), ["doc"]).count() == 0
