"""Turn reassembly, fill-in-the-middle and contextual extraction against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
import regex

from tessera.llm import common, contextual_pii, fill_middle, queries, turn_reassembly


@pytest.mark.parametrize("name", ["op11_turn_reassembly", "op12_fill_middle"])
def test_larger_tables_match_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.compare(spark, oracle.duck(sf), name, sf) == ""


# --- conversations


def plain_events(rows, batches=12, idle=3):
    """Events by a simulation of all batches, a conversation at a time."""
    rows = [("" if c is None else str(c), t, role or "", text or "") for c, t, role, text in rows if t is not None]
    first = {}
    for c, t, _, _ in rows:
        first[c] = min(t, first.get(c, t))
    came = defaultdict(dict)
    for c, t, role, text in rows:
        h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
        for b, r in [(h % batches, role)] + [((h + 3) % batches, "user")] * (h % 7 < 2):
            new = (f"{r}|{text}", r)
            old = came[b].get((c, t))
            came[b][c, t] = min(old or new, new, key=lambda x: (x[0].encode(), x[1].encode()))
    kept, heard, closed, released, out = defaultdict(dict), {}, set(), defaultdict(int), []

    def close(c, b):
        closed.add(c)
        turns = sorted(t for t in kept[c] if t >= first[c] + released[c])
        missing = max(kept[c]) - first[c] + 1 - len(kept[c])
        breaks = sum(t - 1 in kept[c] and kept[c][t][1] == kept[c][t - 1][1] for t in kept[c])
        out.append(("close", ",".join(map(str, turns)), c, -1, b, missing, breaks))

    for b in range(batches):
        for (c, t), x in came[b].items():
            if c in closed:
                out.append(("reject", x[0], c, t, b, None, None))
            else:
                heard[c] = b
                kept[c].setdefault(t, x)
        for c in [c for c in heard if c not in closed]:
            while (t := first[c] + released[c]) in kept[c]:
                out.append(("release", kept[c][t][0], c, t, b, None, None))
                released[c] += 1
            if b - heard[c] == idle:
                close(c, b)
    for c in heard:
        if c not in closed:
            close(c, batches)
    return Counter(out)


def stream_events(spark, rows, **how):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # further columns, whatever their names, are not read
    table = table.selectExpr("*", "7 as batch", "'x' as conv", "turn as first", "text as payload", "true as tick")
    found = turn_reassembly.reassemble(turn_reassembly.arrivals(table), **how).collect()
    return Counter((r.event, r.unreleased if r.event == "close" else r.payload, r.conv, r.turn, r.batch, r.n_missing, r.n_breaks) for r in found)


def test_odd_conversations(spark):
    rng = random.Random(5)
    rows = [(None, 0, "user", "no conversation"), (None, 1, None, None), (7, None, "user", "dropped"), (8, -3, "system", "ß"), (8, -3, "system", "a")]
    rows += [(8, -2, "", ""), (9, 5, "a|b", "c"), (9, 5, "a", "b|c"), (9, 2**40, "user", "far"), (3, 0, "user", "x" * 300_000)]
    rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", None])) for c in range(20, 60) for t in range(rng.randint(1, 9))]
    rows += [(1, t, "user", f"turn {t}") for t in range(400)] + rows[10:60]
    want = plain_events(rows)
    assert {x[0] for x in want} == {"release", "reject", "close"}
    assert stream_events(spark, rows, bucket=3) == want


def test_no_conversation(spark):
    assert not stream_events(spark, [])
    assert not stream_events(spark, [(1, None, "user", "x")])


def test_wheel_visits_the_due_slot_only():
    bucket = turn_reassembly.Bucket(3)
    arrive = lambda b, *rows: list(bucket.arrive(b, list(rows)))
    arrive(0, ("a", 0, 1, "user"), ("b", 0, 0, "user"))
    assert [len(x) for x in bucket.wheel] == [0, 0, 0, 2]
    arrive(2, ("a", 0, 1, "user"))  # a repeat files the conversation anew and leaves the entry before
    assert [len(x) for x in bucket.wheel] == [0, 1, 0, 2]
    assert [(e[1], e[3]) for e in bucket.tick(3, False)] == [("b", 3)]
    packed = turn_reassembly.Bucket(3, bucket.packed())
    assert [e[:6] for e in packed.tick(5, False)] == [("close", "a", -1, 5, None, "1")]
    assert list(packed.arrive(6, [("a", 0, 0, "user")])) == [("reject", "a", 0, 6, 6, None, None, None)]


# --- fill in the middle


def plain_middle(doc_id, text, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(tokens), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, len(tokens), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def test_middle_of_odd_texts(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é", "<P>", "x<S", "<", "\n\n", "ab" * 70_000, "ß€𝄞a b\u0000c", "word " * 30_000, "<M", "a<S>b"]
    texts += ["".join(rng.choices("ab é€𝄞\n<SPM>", k=rng.randint(0, 40))) for _ in range(300)]
    rows = [(None if i % 50 == 3 else i // 2, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string")
    found = fill_middle.fill_in_middle(docs)
    assert Counter(map(tuple, found.collect())) == Counter(plain_middle(r[0], r[1]) for r in rows)
    back = found.select("output", fill_middle.restored(found.output, found.form).alias("text")).collect()
    assert Counter(r.text for r in back) == Counter(t or "" for t in texts)
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            bits = rng.random(n) < share
            vector, before = fill_middle.BitVector(bits), np.concatenate([[0], np.cumsum(bits)])
            assert (vector.rank(np.arange(n + 1)) == before).all()
            assert (vector.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


# --- personal data

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            ip = kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
            if kind == "email" or ip or kind == "card" and 16 <= len(digits) <= 19 and luhn or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def plain_spans(texts, rounds=3, seeds=3, confident=0.5, accept=0.5):
    """All spans of each text by dictionaries over the whole corpus."""
    plain = lambda t: re.sub("[0-9]+", "0", t.lower())
    space = "[\x20\x09-\x0d]+"
    base = [plain_base(t) for t in texts]
    places, counts = [], Counter()
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in re.split(space, plain(t)) if w]
        counts.update((None, w) for w in words)
        counts.update(zip(words, words[1:], strict=False))
        for loose, forms in ((False, contextual_pii.BASE), (True, contextual_pii.LOOSE)):
            for k, form in enumerate(forms):
                after = 0
                for m in regex.finditer(form, t):
                    start, lead, after = m.start(), t[after : m.start()], m.end()
                    digits = len(re.sub("[^0-9]", "", m[0]))
                    if not loose and (contextual_pii.KINDS[k], start, after) not in base[i] or loose and k == 3 and not 7 <= digits <= 15:
                        continue
                    if loose and any(a < after and start < b for _, a, b in base[i]):
                        continue
                    last = [w for w in re.split(space, plain(lead[-160:])) if w][-2:]
                    value = (k, re.sub("[^0-9a-z@]", "", m[0].lower()))
                    glued = lead != "" and not re.search(space + "$", lead)
                    places.append((i, value, not loose, start, after, last, glued))
    ctx = lambda last: [(None, last[-1])] * (len(last) > 0) + [tuple(last)] * (len(last) > 1)
    for _, _, _, _, _, last, glued in places:
        if glued:
            counts.update(ctx(last))
    known = {}
    for _ in range(rounds):
        hits, support = Counter(), defaultdict(set)
        for _, v, is_base, _, _, last, _ in places:
            score = 1.0 if is_base else known.get(v, 0.0)
            for c in ctx(last):
                hits[v[0], c] += score
                if score > 0:
                    support[v[0], c].add(v)
        good = {p: min(1.0, hits[p] / counts[p[1]]) for p in hits if len(support[p]) >= seeds and counts[p[1]] and hits[p] / counts[p[1]] >= confident}
        best = defaultdict(dict)
        for _, v, is_base, _, _, last, _ in places:
            if not is_base:
                best[v][tuple(last)] = max([good.get((v[0], c), 0.0) for c in ctx(last)], default=0.0)
        wrong = {v: float(np.prod([1 - min(x, 1 - 1e-6) for x in b.values()])) for v, b in best.items()}
        known = {v: 1 - w for v, w in wrong.items() if 1 - w >= accept - 1e-9}
    out = [set((k, a, b) for k, a, b in base[i]) for i in range(len(texts))]
    best = {}
    for i, v, is_base, a, b, _, _ in places:
        if not is_base and v in known:
            best[i, a, b] = max(best.get((i, a, b), (-1.0, 0)), (known[v], -v[0]))
    for (i, a, b), (_, k) in best.items():
        out[i].add((contextual_pii.KINDS[-k], a, b))
    return out


def contexts_with_hidden_identifiers():
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choices("123456789", k=n))
    word = lambda: rng.choice("the of and blue river stone market evening window garden".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    phones = [f"+49 30 {digits(3)} {digits(4)}" for _ in range(8)]
    texts = [f"{prose(12)} Call me at {x} {prose(8)}" for x in phones]
    texts += [f"{prose(9)} write to {word()}{digits(3)}@mail.example {prose(5)}" for _ in range(6)]
    texts += [f"{prose(6)} tel:+49 40 {digits(7)} {prose(3)}" for _ in range(5)]
    hidden = [f"030 {digits(3)} {digits(4)}" for _ in range(3)]
    texts += [f"{prose(5)} call ME at {x} {prose(5)}" for x in hidden] + [f"{prose(3)} tel:{digits(9)} {prose(4)}", f"so write to anna [at] mail [dot] example {prose(4)}"]
    texts += [f"{prose(4)} {hidden[0]} {prose(4)}", f"{prose(3)} in the year 2024 1031 7755 {prose(9)}", f"{prose(30)} the {digits(9)}", "Call me at 7", None, ""]
    # found through a value that the first round found: its words stand before that value elsewhere
    texts += [f"{prose(3)} under rufnummer {x} {prose(2)}" for x in hidden] + [f"{prose(3)} under rufnummer 0171 {digits(3)} {digits(4)}"]
    return texts


def test_patterns_find_hidden_identifiers(spark):
    texts = contexts_with_hidden_identifiers()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, base long, kind string")
    rows = contextual_pii.digests(*contextual_pii.identifiers(docs)).collect()
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)} for r in rows}
    want = plain_spans(texts)
    assert got == dict(enumerate(want))
    added = {texts[i][a:b] for i in got for k, a, b in got[i] - set(plain_base(texts[i]))}
    assert {"anna [at] mail [dot] example"} < added and sum(x.startswith("030 ") for x in added) == 3
    assert any(x.startswith("0171 ") for x in added) and not any("2024" in x for x in added)


@pytest.mark.parametrize("bound", [0, common.BROADCAST_ROWS])
def test_personal_data_of_documents(spark, monkeypatch, bound):
    monkeypatch.setattr(contextual_pii, "BROADCAST_ROWS", bound)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in contextual_pii.digests(*contextual_pii.identifiers(docs)).collect():
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in CONTRACT]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(9)
    texts = [None, "", "a" * 100_000, "1" * 50_000, "1." * 30_000, "a.b@c.d_e@f.g.h", "x@y 1.2.3.4.5.6.7.8", "+1 (222) 333-4444) +12", "0000.0.0.0255"]
    texts += ["a@" + "b." * 20_000 + "c", "4111 1111 1111 1111-4111111111111111", "4111111111111111", "+1" + "(" * 20_000, "é4111-1111-1111-1111é"]
    texts += ["".join(rng.choices("ab1209.@+- ()_é", k=rng.randint(1, 80))) for _ in range(3000)]
    rows = [(None if i % 100 == 7 else i // 2, t) for i, t in enumerate(texts)]
    found = contextual_pii.digests(*contextual_pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = Counter((d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t)).encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in found) == want


def test_no_documents_have_no_spans(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contextual_pii.digests(*contextual_pii.identifiers(empty)).count() == 0


def test_queries_are_registered():
    assert {"op11_turn_reassembly", "op12_fill_middle", "op13_contextual_pii"} <= set(queries.queries())
