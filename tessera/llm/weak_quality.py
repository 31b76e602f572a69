"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns (at most 3 ^ labellers, whatever
the corpus) estimates each labeller's accuracy in each class and a posterior for
each pattern. The posteriors of a bounded sample train a linear scorer on hashed
words, word shapes and characters, which then scores every document over its
whole text. A document is kept if its score is ``KEEP`` or more.

The sample is drawn by a hash of the text: about ``FIT`` distinct texts, each
with its number of copies for a weight, and fewer where they would have more than
``FEATURES`` features in all (the documented bounds of the classifier).

Defined results: a null or empty text has no features, gets the posterior of its
votes as score and is judged by it; a very long text is scored whole; a null
doc_id stays null, repeated rows give repeated rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable
from tessera.llm.textcore import LOWER, SAME, SPACE, U64, Prefix, Texts, chunks, lut, words

DIMS, FIT, FEATURES, KEEP = 1 << 14, 8_000, 8_000_000, 0.5
_UPPER, _DIGIT = lut(bytes(range(65, 91))), lut(bytes(range(48, 58)))
_LETTER = _UPPER | lut(bytes(range(97, 123))) | (np.arange(256) >= 128)
_SYMBOL, _BANG, _PIPE, _STOP = lut(b"#*$%&|<>{}=_~^\\"), lut(b"!"), lut(b"|"), lut(b".?!:;\"'")
#: Bytes by class, so that equal shapes of words hash alike.
_SHAPE = SAME.copy()
_SHAPE[_LETTER] = 97
_SHAPE[_UPPER] = 65
_SHAPE[_DIGIT] = 48

LABELLERS = ["length", "word_length", "symbols", "shouting", "bangs", "tables", "repetition", "lines", "sentences"]


def votes(t: Texts) -> np.ndarray:
    """(texts x labellers) of 1 good, -1 bad, 0 no vote."""
    w = words(t)
    n = np.diff(w.first).astype(float)
    some = np.maximum(n, 1)
    per_doc = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[t.bounds])
    letters, chars = per_doc(_LETTER[t.data]), np.maximum(per_doc(~SPACE[t.data]), 1)
    h = Prefix(t.data, LOWER).hashes(w.start, w.end)
    distinct, dup_lines = np.ones(len(t)), np.zeros(len(t))
    for i in range(len(t)):
        if n[i]:
            distinct[i] = len(np.unique(h[w.first[i] : w.first[i + 1]])) / n[i]
            lines = [x for x in t.raw(i).split(b"\n") if x.strip()]
            dup_lines[i] = 1 - len(set(lines)) / max(len(lines), 1)
    last = t.data[w.end - 1] if len(w.end) else t.data[:0]
    stops = np.diff(np.concatenate(([0], np.cumsum(_STOP[last])))[w.first]) / some
    mean = chars / some
    rate = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    symbols, upper = per_doc(_SYMBOL[t.data]) / some, per_doc(_UPPER[t.data]) / np.maximum(letters, 1)
    bangs, pipes = per_doc(_BANG[t.data]) / some, per_doc(_PIPE[t.data]) / some
    expected = np.minimum(1.0, 3 / np.sqrt(some))  # distinct words thin out with length
    return np.stack(
        [
            rate(n < 15, n >= 40),
            rate((mean < 2.5) | (mean > 12), (mean > 3.5) & (mean < 9)),
            rate(symbols > 0.2, symbols < 0.03),
            rate(upper > 0.4, upper < 0.15),
            rate(bangs > 0.2, np.zeros(len(t), bool)),
            rate(pipes > 0.1, np.zeros(len(t), bool)),
            rate(distinct < expected * 0.5, distinct > expected),
            rate(dup_lines > 0.3, dup_lines < 0.05),
            rate((stops < 0.02) & (n >= 40), (stops > 0.04) & (stops < 0.5)),
        ],
        axis=1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good for each vote pattern, and the labellers' vote rates by class.

    Labellers are taken as independent given the class, each with its own rates
    of the three votes; the start is the share of good votes.
    """
    m = len(LABELLERS)
    keys = np.array(sorted(counts))
    n = np.array([counts[k] for k in keys], float)
    v = keys[:, None] // 3 ** np.arange(m) % 3  # 0 bad, 1 none, 2 good
    good, bad = (v == 2).sum(1), (v == 0).sum(1)
    post = (good + 1) / (good + 3 * bad + 2)
    rates = np.zeros((2, m, 3))
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        for c, p in enumerate((1 - post, post)):
            for x in range(3):
                rates[c, :, x] = ((n * p)[:, None] * (v == x)).sum(0) + 1
        rates /= rates.sum(2, keepdims=True)
        logs = np.log(rates)[:, np.arange(m), v].sum(2)
        now = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -50, 50)))
        if np.abs(now - post).max() < 1e-6:
            break
        post = now
    return dict(zip(keys.tolist(), post.tolist(), strict=True)), rates


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each feature, its slot, and its value: square roots of shares, three families a text."""
    w = words(t)
    owner = np.repeat(np.arange(len(t)), np.diff(w.first))
    place = np.repeat(np.arange(len(t)), np.diff(t.bounds))
    families = [
        (owner, Prefix(t.data, LOWER).hashes(w.start, w.end)),
        (owner, Prefix(t.data, _SHAPE).hashes(np.maximum(w.end - 6, w.start), w.end) ^ U64(0x5555555555555555)),
        (place, (t.data.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)),
    ]
    rows, slots, values = [], [], []
    for who, h in families:
        key, n = np.unique(who * DIMS + (h >> U64(50)).astype(np.int64), return_counts=True)
        row = key // DIMS
        rows.append(row)
        slots.append(key % DIMS)
        values.append(np.sqrt(n / np.maximum(np.bincount(who, minlength=len(t)), 1)[row]))
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def _voted(share: float):
    limit = U64(min(int(share * 2**63), 2**63 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for t in chunks(batch.column("text")):
                whole = Prefix(t.data).hashes(t.bounds[:-1], t.bounds[1:])
                drawn = whole >> U64(1) <= limit
                # a task writes the features of a drawn text once
                new = np.zeros(len(t), bool)
                for i in np.flatnonzero(drawn).tolist():
                    new[i] = (h := int(whole[i])) not in seen
                    seen.add(h)
                row, slot, value = (
                    features(t) if new.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                )
                use = new[row]
                order = np.argsort(row[use], kind="stable")
                ends = np.searchsorted(row[use][order], np.arange(len(t) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[use][order].astype(k))) for x, k in ((slot, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pattern(votes(t))), pa.array(np.where(drawn, whole.view(np.int64), 0), mask=~drawn), *lists],
                    names=["pattern", "drawn", "slots", "share"],
                )

    return run


def train(lists: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, copies: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer by full gradient steps with momentum on soft labels, each as often as it has copies."""
    row = np.repeat(np.arange(len(lists)), [len(s) for s, _ in lists])
    slot = np.concatenate([s for s, _ in lists]).astype(np.int64)
    value = np.concatenate([v for _, v in lists]).astype(float)
    # both classes weigh the same
    good = copies[soft >= 0.5].sum()
    weight = copies * np.where(soft >= 0.5, 0.5 / max(good, 1), 0.5 / max(copies.sum() - good, 1))
    w, b, vw, vb = np.zeros(DIMS), 0.0, np.zeros(DIMS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[slot], minlength=len(lists)) + b, -30, 30)))
        g = weight * (p - soft)
        vw = 0.9 * vw - 4.0 * (np.bincount(slot, value * g[row], minlength=DIMS) + 1e-5 * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w, b = shared.value
        for batch in batches:
            for t in chunks(batch.column("text")):
                weak = np.array([posterior.get(k, 0.5) for k in pattern(votes(t)).tolist()])
                row, slot, value = features(t)
                z = np.bincount(row, value * w[slot], minlength=len(t)) + b
                score = np.where(np.diff(t.bounds) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), weak)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.first, len(t)), pa.array(weak), pa.array(score), pa.array(score >= KEEP)],
                    names=["doc_id", "weak", "score", "kept"],
                )

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, weak, score, kept) of every row; ``weak`` is the posterior of the votes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = rows.count()
    voted = rows.select("text").mapInArrow(_voted(FIT / max(n, 1)), "pattern long, drawn long, slots array<int>, share array<float>")
    voted = durable(voted, "votes")
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, w, b = {}, np.zeros(DIMS), 0.0
    if counts:
        posterior, _ = estimate(counts)
        # copies become one row before they reach the driver
        sample = voted.where("drawn is not null").groupBy("drawn").agg(F.max(F.struct("pattern", "slots", "share")).alias("x"), F.count("*").alias("n"))
        sample = durable(sample.where("size(x.slots) > 0").select("drawn", "x.*", "n"), "sample")
        size = sample.agg(F.sum(F.size("slots"))).first()[0] or 0
        part = F.pmod(F.xxhash64("drawn"), F.lit(1 << 30)) < min(1.0, FEATURES / max(size, 1)) * (1 << 30)
        sample = sample.where(part).orderBy("drawn").toArrow()
        lists = [(np.asarray(s.values), np.asarray(v.values)) for s, v in zip(sample["slots"], sample["share"], strict=True)]
        if lists:
            w, b = train(lists, np.array([posterior[k] for k in sample["pattern"].to_pylist()]), np.array(sample["n"].to_pylist(), float))
    shared = docs.sparkSession.sparkContext.broadcast((posterior, w, b))
    return rows.mapInArrow(_scored(shared), "doc_id long, weak double, score double, kept boolean")
