"""Each training-data operator against brute force on small fixtures, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    hilbert_shards,
    language_id,
    latent_decontamination,
    line_quality,
    line_spread,
    piece_counts,
    queries,
    shingle_join,
    source_mix,
    substring_dedup,
    weak_quality,
)

WORD = "[^\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, cell int, target double, kept boolean"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    long = some(60_000)
    base = some(300)
    rows = [(0, None, "en", "a", None), (1, "", None, None, 0), (2, " \t\n ", "en", "a", 4), (3, "one", "en", None, 3), (4, "one two", "de", "b", 7)]
    rows += [(5, long, "en", "a", len(long)), (6, long, "en", "a", len(long)), (7, base, "de", "b", 9), (7, base, "de", "b", 9)]
    rows += [(None, base, "de", "b", 9), (8, base + " tail", None, "c", 9), (9, "é " * 30 + "\u0000x", "fr", "c", 60), (10, "12 34 !!", "fr", "c", 8)]
    rows += [(20 + i, some(40) + "\n" + "the same old line of many words here\n" + some(20), "en", f"s{i % 7}", 300) for i in range(30)]
    return [(*r, 1, 2, 3, 4.0, True) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "op1": lambda d: hilbert_shards.assign(d),
    "op2": lambda d: line_spread.remove_boilerplate(d),
    "op3": lambda d: piece_counts.count_pieces(d),
    "op4": lambda d: language_id.predict(d),
    "op5": lambda d: substring_dedup.dedup(d),
    "op6": lambda d: shingle_join.link(d)[0],
    "op7": lambda d: source_mix.mix(d),
    "op8": lambda d: line_quality.judge(d),
    "op10": lambda d: weak_quality.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(name, odd, empty):
    assert Counter(r.doc_id for r in OPERATORS[name](odd).select("doc_id").collect()) == Counter(r[0] for r in odd_rows())
    assert OPERATORS[name](empty).count() == 0


def test_odd_tables_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, odd_rows()[7][1][:200]), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.leaks(odd, bench).collect()}
    assert {(7, 1), (8, 1)} <= got
    assert latent_decontamination.leaks(empty, bench).count() == 0
    assert latent_decontamination.leaks(odd, bench.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.duck(sf), name, sf) == ""


def test_hilbert_neighbours_touch():
    points = {hilbert_shards.hilbert_index((x, y, z), 2): (x, y, z) for x in range(4) for y in range(4) for z in range(4)}
    assert sorted(points) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(points[i], points[i + 1], strict=True)) == 1 for i in range(63))


def test_shards_hold_the_rows_law(odd):
    rows = hilbert_shards.assign(odd, shards=7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r[0]: r[1] or "" for r in odd_rows()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in rows)


def test_spread_counts_sites_not_documents(spark):
    line = "a line that stands on many sites of the web"
    rows = [(i, f"own text number {i} stays here\n{line}", f"s{i % 6}") for i in range(12)]
    rows += [(100 + i, "a line that stands often on one site only", "s0") for i in range(50)]
    out = {r.doc_id: r for r in line_spread.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].text == f"own text number {i} stays here" and out[i].n_removed == 1 for i in range(12))
    assert all(out[100 + i].n_removed == 0 for i in range(50))


def test_pieces_equal_greedy_word_pieces(texts):
    from tokenizers import Tokenizer, models

    path, end = "/opt/tokenizers/word_bpe_49k.json", "☃"
    pieces = piece_counts.read_vocabulary(path)
    show = {b: c for c, b in piece_counts.byte_symbols().items()} | {piece_counts.END: end}
    vocabulary = {"".join(show[s] for s in p): i for i, p in enumerate(pieces)} | {end: len(pieces)}
    model = Tokenizer(models.WordPiece(vocab=vocabulary, unk_token="!", continuing_subword_prefix="", max_input_chars_per_word=10**6))
    automaton = piece_counts.Automaton(pieces)
    for word in {w for t in list(texts.values())[:60] for w in piece_counts.normal_words(t)}:
        ids = model.encode("".join(show[b] for b in word.encode()) + end).ids
        assert automaton.count(word.encode()) == len([i for i in ids if i != len(pieces)])


def test_language_held_out_accuracy(spark, documents):
    rows = language_id.predict(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_backs_off_to_shorter_ngrams(spark):
    rows = [(i, "haus maus laus baum" if i % 2 else "chat rat plat quai", "de" if i % 2 else "fr") for i in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "klaus"), (2, "quat"), (3, "4 !"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(test, model).collect()}
    assert got == {1: "de", 2: "fr", 3: "und", 4: "und"}


def brute_dedup(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        cover, new = bytearray(len(raw)), set()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            if w in seen:
                cover[i : i + 50] = b"\1" * 50
            new.add(w)
        seen |= new
        kept = bytes(c for c, k in zip(raw, cover, strict=True) if not k)
        out[d] = (len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, documents, texts):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(documents).collect()}
    assert got == brute_dedup(texts)


def test_substrings_of_few_letters(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("ab", weights=[9, 1], k=rng.choice([49, 50, 51, 120, 400]))) for _ in range(25)]
    texts = {i: rng.choice(base) + rng.choice(base)[: rng.randint(0, 90)] + "é" * rng.randint(0, 40) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(df).collect()} == brute_dedup(texts)


def brute_components(texts, n=3, num=9, den=10):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in texts.items():
        w = re.findall(WORD, t.translate(lower))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_join_equals_brute_force(spark, documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.link(documents)[0].collect()}
    assert got == brute_components(texts)


def test_join_of_many_near_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    texts = {0: " ".join(base)}
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.link(df)[0].collect()} == brute_components(texts)


def test_apportionment_is_sainte_lague_for_every_house(spark):
    goals = {"a": 530.0, "b": 240.0, "c": 230.0, "d": 7.0}
    df = spark.createDataFrame(list(goals.items()), "src string, target double")
    got = {r.src: r.quotas for r in source_mix.apportion(df, 10, 5).collect()}
    for h in range(6):
        seats = dict.fromkeys(goals, 0)
        for _ in range(int(sum(goals.values()) * h / 5 / 10 + 0.5)):
            best = max(goals, key=lambda s: (goals[s] / (2 * seats[s] + 1), [-ord(c) for c in s]))
            seats[best] += 1
        assert {s: got[s][h] for s in goals} == seats


def test_mix_meets_targets_and_repeats(documents):
    rows = source_mix.mix(documents).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * 32 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(documents).collect()))
    words = source_mix.mixed_documents(documents).select("text").collect()
    assert sum(len(re.findall(WORD, r.text)) for r in words) == sum(taken.values())


def test_frequent_lines_of_a_host_deplete(spark):
    rng = random.Random(2)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    line = own(30)
    rows = [(i, f"{line}\n{own(10)}", "h") for i in range(40)] + [(100 + i, f"{line}\n{own(60)}", "h") for i in range(10)]
    rows += [(200 + i, f"{line}\n{own(10)}", "other") for i in range(5)] + [(300, line, "copies")] * 30
    kept = {r.doc_id: r.kept for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # the line goes from all documents of its host, copies are documents; those with enough of their own stay, as do other hosts
    assert not any(kept[i] for i in (*range(40), 300))
    assert all(v for d, v in kept.items() if 100 <= d < 300)


def test_leaks_against_brute_force(spark, sf, documents, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    verbatim = {(d, r.item_id) for d, t in texts.items() for r in items.collect() if norm(r.text) in norm(t)}
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.leaks(documents, items).collect()}
    assert len(verbatim & got) >= 0.9 * len(verbatim)
    assert len(got - verbatim) <= 0.1 * len(got)


def test_leaks_of_paraphrases(spark, documents, texts):
    rng = random.Random(4)
    item = " ".join("".join(rng.choices("bcdfgaeiou", k=7)) for _ in range(30))
    w = item.split()
    changed = " ".join(x.upper() for i, x in enumerate(w) if i % 5)  # a fifth of the words is gone
    docs = spark.createDataFrame([(10**6, texts[1] + " " + changed + " " + texts[2]), (10**6 + 1, texts[3])], "doc_id long, text string")
    docs = docs.union(documents.select("doc_id", "text"))
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in latent_decontamination.leaks(docs, bench).collect()] == [(10**6, 5)]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (rng.choices(range(6), k=rng.randint(0, 40)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert latent_decontamination.common_subsequence(a, b) == table[-1][-1]


def test_weak_labels_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = weak_quality.score(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    hit = rows.where(F.col("kept") == (F.col("quality") == 1)).count()
    assert hit >= 0.9 * rows.count()


def test_pipeline_stages(spark, sf, documents):
    import corpus_pipeline as p

    docs = documents
    for i, (_, stage) in enumerate(p.STAGES[:4]):
        before, docs = docs, stage(spark, docs, sf)
        docs = docs.cache()
        assert docs.columns == documents.columns
        if i == 0:
            want = brute_clean([(r.doc_id, r.text, r.source) for r in before.collect()], 20, 0.02)
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
        if i == 1:
            want = {d for d, (_, c) in brute_components({r.doc_id: r.text for r in before.collect()}, 5, 4, 5).items() if d == c}
            assert {r.doc_id for r in docs.collect()} == want
        if i == 2:
            bad = {r.doc_id for r in latent_decontamination.leaks(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in before.collect()} - bad == {r.doc_id for r in docs.collect()}
        if i == 3:
            # words of a document in the mix: no more than twice its own
            size = {r.doc_id: len(r.text.split()) for r in before.collect()}
            mixed = Counter()
            for r in docs.collect():
                mixed[r.doc_id] += len(r.text.split())
            assert all(n <= 2 * size[d] for d, n in mixed.items())
    out = p.STAGES[4][1](spark, docs, sf).collect()
    assert len(out) == docs.count()


def test_pipeline_joins_on_five_words(spark, sf, documents, texts):
    import corpus_pipeline as p

    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    # about 0.87 of the shingles are shared: below 0.9, above 0.8
    rows = [(10**6, " ".join(base)), (10**6 + 1, " ".join(base + [f"tail{i}" for i in range(30)])), (10**6 + 2, " ".join(base[:60]))]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {d for d, (_, c) in brute_components(texts | dict(rows), 5, 4, 5).items() if d == c}
    assert 10**6 + 1 not in want and 10**6 + 2 in want
    assert {r.doc_id for r in p.STAGES[1][1](spark, docs, sf).collect()} == want


def brute_clean(rows, min_docs, share):
    """(doc_id, text) of the rows kept, lines above the limit cut; ``rows`` has (doc_id, text, source)."""
    normal = lambda x: " ".join(re.findall(WORD, re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))))
    hosts, having = Counter(h for _, _, h in rows), defaultdict(set)
    for k, (_, t, h) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(normal(x).split(" ")) >= 3:
                having[h, normal(x)].add(k)
    above = {k for k, v in having.items() if len(v) > max(min_docs, share * hosts[k[0]])}
    out = []
    for d, t, h in rows:
        w = re.findall(WORD, t or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
        lines = (t or "").split("\n")
        bad = [(h, normal(x)) in above for x in lines]
        lost = sum(len(normal(x).split(" ")) for x, b in zip(lines, bad, strict=True) if b)
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and lost <= 0.5 * len(w):
            out.append((d, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("bound", [10**6, -1])
def test_clean_documents_cut_lines_of_a_host(spark, monkeypatch, bound):
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", bound)
    rng = random.Random(6)
    own = lambda n: " ".join("".join(rng.choices("abcdéfgh", k=6)) for _ in range(n))
    shared = [own(12), "Page 7 of the site", own(25)]
    rows = []
    for i in range(60):
        lines = [own(40), own(12), "", "a b"] + [x.replace("7", str(i)) for x in shared if rng.random() < 0.8]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice("xy")))
    rows += [(100 + i, *rows[3][1:]) for i in range(3)] + [(200, shared[2] + "\n" + own(3), "x")]
    want = brute_clean(rows, 5, 0.02)
    assert 40 < len(want) < len(rows) and sum(len(t) for _, t in want) < 0.9 * sum(len(t) for d, t, _ in rows if d in dict(want))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = line_quality.clean_documents(df, min_docs=5).collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.doc_id for r in line_quality.judge(df, min_docs=5).where("kept").collect()} == {d for d, _ in want}


def test_odd_tables_in_stages(spark, odd, empty):
    base = odd_rows()[7][1]
    bench = spark.createDataFrame([(1, base[:200])], "item_id long, text string")
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert ids(line_quality.clean_documents(odd)) == Counter(d for d, _ in brute_clean([(r[0], r[1], r[3]) for r in odd_rows()], 20, 0.02))
    assert ids(shingle_join.unique_documents(odd)) == Counter({r[0] for r in odd_rows()} - {None, 6, 8})
    assert ids(latent_decontamination.clean_documents(odd, bench)) == Counter(r[0] for r in odd_rows() if r[0] not in (None, 7, 8))
    taken = source_mix.mix(odd).agg(F.sum("taken")).first()[0]
    mixed = source_mix.mixed_documents(odd).collect()
    assert sum(len(re.findall(WORD, r.text)) for r in mixed) == taken and None in {r.doc_id for r in mixed}
    for stage in (line_quality.clean_documents, shingle_join.unique_documents, source_mix.mixed_documents):
        assert stage(empty).count() == 0 and stage(empty).columns == empty.columns


def test_weak_quality_sample_is_bounded_in_copies(spark, monkeypatch):
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))
    import pyarrow as pa

    drawn = lambda x: next(weak_quality._voted(0.1)([pa.record_batch({"text": [x]})])).column("drawn")[0].as_py()
    hot = next(x for x in iter(own, None) if drawn(x))
    docs = spark.createDataFrame([(i, hot if i % 3 == 0 else own()) for i in range(1500)], "doc_id long, text string")
    sizes, train = [], weak_quality.train
    monkeypatch.setattr(weak_quality, "FIT", 150)
    monkeypatch.setattr(weak_quality, "train", lambda lists, soft, *a: sizes.append((len(lists), *(x.sum() for x in a))) or train(lists, soft, *a))
    assert weak_quality.score(docs).count() == 1500
    assert 50 < sizes[0][0] < 200 and sizes[0][1] == sizes[0][0] - 1 + 500
