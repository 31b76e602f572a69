"""Operators against plain versions of themselves, on odd tables, texts longer than a chunk, and names that clash."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, brute_clean, brute_components, brute_dedup

from tessera.llm import common, hilbert_shards, language_id, latent_decontamination, line_quality, line_spread, piece_counts, shingle_join, source_mix, substring_dedup, textcore, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_row", "_cut", "_id", "_p", "_copy", "_size", "n_lines", "n_removed", "doc", "cut", "key", "sub", "size", "row", "host", "pieces", "text_a", "component", "shard", "taken"]


def rows_of():
    """Nulls, empty and blank texts, ties, repeats, two texts under one id, and a text longer than a chunk."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(900)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    huge = "\n".join(some(30) for _ in range(3400))
    assert len(huge) > textcore.CHUNK
    base, line = some(200), "one line that " + some(9)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, huge, "en", "a"), (5, huge + " " + some(40), "en", "b")]
    rows += [(6, base, "de", "b"), (6, base, "de", "b"), (6, some(120), "de", "b"), (None, base + " " + some(3), "de", None), (None, None, None, None)]
    rows += [(7 + i, f"{some(30)}\n{line}\n{some(20)}", "en", f"s{i % 9}") for i in range(45)]
    return [(*r, len(r[1]) if r[1] else None) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.lit(f"x{c}") for c in CLASHING})


def order(values):
    return sorted(values, key=lambda r: tuple((x is None, str(x)) for x in r))


OUTPUTS = {
    "op1": lambda d: hilbert_shards.assign(d, shards=5).select("doc_id", "shard", "slot"),
    "op2": lambda d: line_spread.remove_boilerplate(d).select("doc_id", "text", "n_lines", "n_removed"),
    "op3": piece_counts.count_pieces,
    "op4": language_id.predict,
    "op5": substring_dedup.dedup,
    "op6": lambda d: shingle_join.link(d)[0],
    "op7": lambda d: source_mix.mix(d).select("doc_id", "size", "source_size", "target", "taken"),
    "op8": line_quality.judge,
    "op10": weak_quality.score,
}
STAGES = {
    "quality": lambda d: line_quality.clean_documents(d),
    "near": lambda d: shingle_join.unique_documents(d),
    "mix": lambda d: source_mix.mixed_documents(d),
    "lines": lambda d: line_spread.remove_boilerplate(d),
}


@pytest.mark.parametrize("name", OUTPUTS)
def test_clashing_names_change_nothing(name, odd, clashing):
    made = OUTPUTS[name]
    a, b = (order(map(tuple, made(d).collect())) for d in (odd, clashing))
    if name != "op1":  # rows equal in identifier, size and checksum may change places
        assert a == b
    assert len(a) == len(b) == odd.count()


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_clashing_columns(name, odd, clashing):
    plain, full = (STAGES[name](d) for d in (odd, clashing))
    own = [c for c in clashing.columns if name != "lines" or c not in ("n_lines", "n_removed")]
    assert full.select(*own).columns == own
    kept = full.collect()
    assert all(r[c] == f"x{c}" for r in kept for c in CLASHING if c in own)
    assert order((r.doc_id, r.text) for r in kept) == order((r.doc_id, r.text) for r in plain.collect())


def test_decontamination_keeps_clashing_columns(spark, rows, clashing):
    bench = spark.createDataFrame([(1, rows[5][1][:300])], "item_id long, text string")
    kept = latent_decontamination.clean_documents(clashing, bench).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in rows if not (r[1] or "").startswith(rows[5][1]))


def test_lines_against_brute_force(odd, rows):
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if len(x.strip(" \t\r\v\f")) >= 20:
                sites[x.strip(" \t\r\v\f").lower()].add(s)
    bad = {x for x, v in sites.items() if len(v) >= 5}
    want = []
    for d, t, _, _, _ in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for x in lines if x.strip(" \t\r\v\f").lower() not in bad]
        want.append((d, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    got = line_spread.remove_boilerplate(odd).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert order(map(tuple, got)) == order(want) and bad


def test_substrings_of_long_texts(spark, rows):
    texts = {i: r[1] or "" for i, r in enumerate(rows) if i not in (6, 7, 8, 9)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(df).collect()} == brute_dedup(texts)


def test_substrings_of_rows_of_one_id(spark):
    a, b = "x" * 30 + "abcdefghij" * 8, "qrstuvwxyz" * 9
    df = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b + a), (None, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert got == Counter([(1, 110, 0), (2, 90, 0), (2, 110, 110), (3, 200, 200), (None, 110, 0)])


def test_join_of_rows_without_own_ids(odd, rows):
    """Rows are compared as rows; a component is named by its smallest doc_id."""
    groups = brute_components({i: r[1] or "" for i, r in enumerate(rows)})
    ids = lambda i: rows[i][0]
    least = {}
    for i, (_, c) in groups.items():
        if ids(i) is not None:
            least[c] = min(least.get(c, ids(i)), ids(i))
    want = order((ids(i), n, least.get(c)) for i, (n, c) in groups.items())
    got = shingle_join.link(odd)[0].select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == want


def test_quality_of_odd_rows(odd, rows):
    got = line_quality.clean_documents(odd, min_docs=20).collect()
    want = brute_clean([(r[0], r[1], r[3]) for r in rows], 20, 0.02)
    assert order((r.doc_id, r.text) for r in got) == order(want)


def test_mix_takes_runs_of_each_shard(odd):
    found = source_mix.mix(odd).collect()
    by = defaultdict(Counter)
    for r in found:
        assert sum(p.words for p in r.pieces) == r.taken <= 2 * r["size"]
        for p in r.pieces:
            by[r.source][p.shard] += p.words
    for r in found:
        blocks = -(-r.source_size // 32)
        for shard in range(8):
            quota = min(r.quotas[shard + 1], 2 * blocks) - min(r.quotas[shard], 2 * blocks)
            # a seat is 32 words, but for the last block of the source
            assert abs(by[r.source][shard] - 32 * quota) <= 2 * 32


def test_mixed_rows_carry_their_shard(odd):
    mixed = source_mix.mixed_documents(odd, shard="part").collect()
    words, pieces = Counter(), Counter()
    for r in mixed:
        words[r.part] += len(re.findall(WORD, r.text))
    for r in source_mix.mix(odd).collect():
        for p in r.pieces:
            pieces[p.shard] += p.words
    assert words == pieces


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words here at all in any of them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    assert out and all(len(s) == max(s) + 1 for s in _slots(out).values())
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert p.run(spark, str(empty)).count() == 0


def _slots(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.shard].add(r.slot)
    return out


# language ------------------------------------------------------------------------------------------


def plain_languages(examples, texts):
    """Word-first backoff with dictionaries of strings."""
    cut = lambda t: re.findall(r"\0+", "".join("\0" if unicodedata.category(c)[0] in "LM" else " " for c in t))  # noqa: E731, F841

    def words(t):
        out, word = [], ""
        for c in t.lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    langs = sorted({x for _, x in examples}, key=lambda x: x.encode())
    counts = {k: defaultdict(Counter) for k in range(5)}
    for t, lang in examples:
        for w in words(t):
            counts[0][w][lang] += 1
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[k][w[i : i + k]][lang] += 1
    total = {k: {x: sum(c[x] for c in counts[k].values()) for x in langs} for k in counts}
    log = lambda k, u, x: math.log((counts[k][u][x] + 0.5) / (total[k][x] + 0.5 * max(len(counts[k]), 1)))
    out = {}
    for d, t in texts.items():
        own, score = words(t or ""), dict.fromkeys(langs, 0.0)
        for w in own:
            if w in counts[0]:
                for x in langs:
                    score[x] += log(0, w, x)
                continue
            for i in range(len(w)):
                k = next((k for k in range(min(4, len(w) - i), 0, -1) if w[i : i + k] in counts[k]), 0)
                for x in langs if k else ():
                    score[x] += log(k, w[i : i + k], x) / k
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out[d] = ("und", 0.0)
            continue
        best = max(langs, key=lambda x: score[x])
        out[d] = (best, 1 / sum(math.exp((score[x] - score[best]) / math.sqrt(len(own))) for x in langs))
    return out


def test_language_against_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1500")
    extra = [(10**6, "हिन्दी में लिखा गया पाठ", "hi", "x", 9), (10**6 + 1, "यह पाठ हिन्दी में है", "hi", "x", 9), (10**6 + 2, "́ 12", None, "x", 3), (10**6 + 3, None, "en", "x", 0), (10**6 + 4, "qqxyzz", None, "x", 3)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = docs.collect()
    examples = [(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and _fold(r.doc_id) != 2]
    want = plain_languages(examples, {r.doc_id: r.text for r in rows})
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in language_id.predict(docs).collect()}
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in want.items()}
    assert all(abs(got[d][1] - want[d][1]) < 1e-3 and got[d][2] == (_fold(d) == 2) for d in got)


def _fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4


def test_language_keeps_rare_units(spark):
    """No unit of the sample is forgotten, however many there are."""
    rng = random.Random(1)
    common_words = " ".join("".join(rng.choices("abcd", k=9)) for _ in range(25_000))
    rows = [(i, common_words, "xx") for i in range(4)] + [(10, "zweifelhaft", "de"), (11, "zweifelhaft", "de"), (12, "zweifelhaft", "de"), (13, "zweifelhaft", "de")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.keys[0]) > 20_001


# decontamination -----------------------------------------------------------------------------------


def plain_leak(item, doc):
    """Whether some stretch of a document holds the item's words in order, its answer included."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    a, b = cut(item), cut(doc)
    for lo in range(0, max(len(b), 1), 8):
        near = b[lo : lo + max(len(a), 24) + 16]
        tail = a[-max(len(a) // 4, 3) :]
        lcs = lambda x: latent_decontamination.common_subsequence(x, near)  # noqa: E731, B023
        if lcs(a) >= 0.6 * len(a) and lcs(tail) >= 0.5 * len(tail):
            return True
    return False


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_paraphrases_are_found(spark, sf, rate):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rng = random.Random(int(rate * 10))
    vocabulary = " ".join(texts.values()).split()
    planted = []
    for r in items.collect():
        changed = []
        for w in r.text.split():
            turn = rng.random() / rate
            changed += [] if turn < 1 / 3 else [rng.choice(vocabulary)] if turn < 2 / 3 else [w, rng.choice(vocabulary)] if turn < 1 else [w]
        w = " ".join(rng.choices(vocabulary, k=150)).split()
        planted.append((10**6 + r.item_id, " ".join(w[:70] + changed + w[70:]), r.item_id, r.text))
    more = spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.leaks(docs.union(more), items).collect()}
    real = [(d, i) for d, t, i, x in planted if plain_leak(x, t)]
    assert len(real) >= 0.9 * len(planted)
    assert len(set(real) & got) >= 0.9 * len(real)
    wrong = [(d, i) for d, i in got if d >= 10**6 and (d - 10**6) != i and not plain_leak(dict((p[2], p[3]) for p in planted)[i], dict(p[:2] for p in planted)[d])]
    assert len(wrong) <= 0.05 * len(planted)


def test_short_items_and_other_scripts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chinese = "这是一个用来检查数据是否泄漏的基准问题它的答案是四十二"
    rows = [(10**6, "before the Quick, brown fox! after"), (10**6 + 1, "the brown quick fox"), (10**6 + 2, f"他说{chinese}。谢谢大家"), (10**6 + 3, "Yes."), (10**6 + 4, "yes and no"), (10**6 + 5, "Ägypten und ÖSTERREICH sind zwei Länder")]
    items = [(1, "quick brown fox"), (2, chinese), (3, "yes"), (4, "ägypten und österreich"), (5, "..."), (6, None)]
    got = latent_decontamination.leaks(docs.union(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("doc_id >= 1000000").collect()} == {(10**6, 1), (10**6 + 2, 2), (10**6 + 3, 3), (10**6 + 5, 4)}


def test_items_in_blocks(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in latent_decontamination.leaks(docs, items).collect()}
    monkeypatch.setattr(latent_decontamination, "BLOCK", 9)
    monkeypatch.setattr(latent_decontamination, "COLUMNS", 3)
    assert {(r.doc_id, r.item_id) for r in latent_decontamination.leaks(docs, items).collect()} == whole


def test_units_of_any_script():
    rng = random.Random(1)

    def kind(ch):
        c = ord(ch)
        if c > 0xFFFF:
            return 2 if c >= 0x20000 else 0 if c >> 12 == 0x1F else 1
        return (unicodedata.category(ch)[0] in "LNM") * (2 if any(a <= c <= b for a, b in textcore.UNSPACED) else 1)

    texts = ["".join(rng.choices("ab 1.é漢字ไทย —\n😀𝔸𠀀ß،д", k=rng.randint(0, 12))) for _ in range(800)]
    for t in textcore.chunks(pa.array(texts), limit=200):
        w = textcore.units(t)
        for i in range(len(t)):
            want, word = [], ""
            for ch in texts[t.first + i] + " ":
                if kind(ch) == 1:
                    word += ch
                    continue
                want += [word] if word else []
                want += [ch] if kind(ch) == 2 else []
                word = ""
            span = zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)
            assert [t.data[a:b].tobytes().decode() for a, b in span] == want


# weak labels ---------------------------------------------------------------------------------------


def test_estimate_against_plain_em():
    rng = random.Random(3)
    m = len(weak_quality.LABELLERS)
    counts = Counter()
    for _ in range(3000):
        good = rng.random() < 0.7
        votes = [2 if rng.random() < (0.8 if good else 0.2) else rng.choice([0, 1]) for _ in range(m)]
        counts[sum(v * 3**i for i, v in enumerate(votes))] += 1
    got, _ = weak_quality.estimate(dict(counts), rounds=25)
    votes = {k: [k // 3**i % 3 for i in range(m)] for k in counts}
    post = {k: (v.count(2) + 1) / (v.count(2) + 3 * v.count(0) + 2) for k, v in votes.items()}
    for _ in range(25):
        prior = min(max(sum(counts[k] * post[k] for k in counts) / 3000, 0.01), 0.99)
        rates = {}
        for c in (0, 1):
            for i in range(m):
                seen = [1.0, 1.0, 1.0]
                for k, v in votes.items():
                    seen[v[i]] += counts[k] * (post[k] if c else 1 - post[k])
                rates[c, i] = [x / sum(seen) for x in seen]
        new = {}
        for k, v in votes.items():
            like = [math.log((1 - prior, prior)[c]) + sum(math.log(rates[c, i][v[i]]) for i in range(m)) for c in (0, 1)]
            new[k] = 1 / (1 + math.exp(min(max(like[0] - like[1], -50), 50)))
        if max(abs(new[k] - post[k]) for k in counts) < 1e-6:
            break
        post = new
    assert all(abs(got[k] - post[k]) < 1e-5 for k in counts)


def test_scores_are_a_linear_sum(spark, documents_small):
    """A score is the logistic of the weights of a text's own features, counted word by word."""
    texts = documents_small
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=weak_quality.DIMS), 0.3

    class Shared:
        value = ({}, w, b)

    batch = pa.record_batch({"doc_id": list(texts), "text": list(texts.values())})
    got = {r["doc_id"]: r["score"] for out in weak_quality._scored(Shared)(iter([batch])) for r in out.to_pylist()}
    for d, t in texts.items():
        raw = t.encode()
        if not raw:
            continue
        words = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", raw) if x]
        one = lambda x, fold: int(textcore.Prefix(np.frombuffer(x, np.uint8), fold).hashes(np.array([0]), np.array([len(x)]))[0])
        families = [
            [one(x, textcore.LOWER) >> 50 for x in words],
            [(one(x[-6:], weak_quality._SHAPE) ^ 0x5555555555555555) >> 50 for x in words],
            [(((c + 1) * 0x9E3779B97F4A7C15) % 2**64) >> 50 for c in raw],
        ]
        z = b + sum(w[s] * math.sqrt(n / len(f)) for f in families for s, n in Counter(f).items())
        assert abs(got[d] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-6


@pytest.fixture(scope="module")
def documents_small(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").limit(40).collect()}


def test_sample_is_bounded_in_features(spark, documents_small, monkeypatch):
    monkeypatch.setattr(weak_quality, "FEATURES", 2000)
    sizes, train = [], weak_quality.train
    monkeypatch.setattr(weak_quality, "train", lambda lists, *a: sizes.append(sum(len(s) for s, _ in lists)) or train(lists, *a))
    df = spark.createDataFrame([(i, f"{t} {i}") for i, t in enumerate(documents_small.values())], "doc_id long, text string")
    assert weak_quality.score(df).count() == len(documents_small)
    assert sizes and sizes[0] < 8000


# pieces --------------------------------------------------------------------------------------------


def test_piece_counts_of_whole_documents(spark, sf):
    path = "/opt/tokenizers/word_bpe_49k.json"
    pieces = set(piece_counts.read_vocabulary(path)) | {(piece_counts.END,)}
    longest, known = max(map(len, pieces)), {}

    def count(word):
        if word not in known:
            s, at, n = (*word.encode(), piece_counts.END), 0, 0
            while at < len(s):
                k = next(k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in pieces)
                n += s[at : at + k] != (piece_counts.END,)
                at += k
            known[word] = n
        return known[word]

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (len(w := piece_counts.normal_words(r.text or "")), sum(map(count, w))) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in piece_counts.count_pieces(docs).collect()} == want


def test_vocabulary_must_have_all_bytes(tmp_path):
    (tmp_path / "v.json").write_text('{"added_tokens": [], "model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "b</w>": 1}}}')
    with pytest.raises(ValueError, match="bytes"):
        piece_counts.read_vocabulary(str(tmp_path / "v.json"))


# plumbing ------------------------------------------------------------------------------------------


def test_ranks_and_sums_over_ranges(spark):
    rng = random.Random(2)
    values = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(values, "k long, v long")
    got = {r.k: (r.r, r.before) for r in common.ranked(df, [F.desc("v"), F.col("k")], "r", {"before": "v"}).collect()}
    total, want = 0, {}
    for place, (k, v) in enumerate(sorted(values, key=lambda x: (-x[1], x[0]))):
        want[k] = (place, total)
        total += v
    assert got == want


def test_frequent_keys_are_attached_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(200)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).where("k <> 3")
    got = {(r.k, r.v): r.top for r in common.attached(rows, table, ["k"], "n", 200).collect()}
    tops = {r.k: r.top for r in table.collect()}
    assert got == {(k, v): tops.get(k) for k, v in ((r.k, r.v) for r in rows.collect())}


def test_intermediate_tables_can_go(spark):
    df = common.durable(spark.range(5), "gone")
    assert df.count() == 5
    common.forget(df)
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        df.count()


def test_digest_of_kept_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 60 + "ü")], "doc_id long, text string")
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.dedup(df).collect()}
    assert got == {1: hashlib.sha256(b"a" * 60).hexdigest(), 2: hashlib.sha256("bü".encode()).hexdigest()}


@pytest.mark.parametrize("n", [3, 5, 9])
def test_order_of_shingles_keeps_common_words_last(n):
    hashes = np.array([5 << 20, 7 << 40, 2**64 - 1], np.uint64)
    rare, common = (np.full(3, n * level, np.uint64) for level in (40, shingle_join.WORD_LEVEL))
    low = np.zeros(3, np.uint8)
    assert shingle_join._order(hashes, low, rare, n).max() < shingle_join._order(hashes, low, common, n).min()
    # what is counted as frequent comes after whatever the words say
    assert shingle_join._order(hashes, low, common, n).max() < shingle_join._order(hashes, low + 1, rare * np.uint64(0), n).min()
