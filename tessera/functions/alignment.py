"""Alignment of tokens to text, head scores and word stems: sequential, so in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alignment scores.
MATCH, MISMATCH, GAP = 2, -2, -1


def aligned(a: str, b: str) -> list[tuple[int, int]]:
    """Global alignment of two strings: (place in a, place in b), -1 for a gap; diagonal before a gap in b before one in a.

    Each row is a vector: only the gaps along the row depend on the row itself,
    and they are a running maximum of scores freed of the gap's slope.
    """
    n, m = len(a), len(b)
    codes = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32) if m else np.zeros(0, np.uint32)
    slope = GAP * np.arange(m + 1)
    table = np.empty((n + 1, m + 1), dtype=np.int32)
    table[0] = slope
    for i, ch in enumerate(a, 1):
        best = np.empty(m + 1, dtype=np.int64)
        best[0] = GAP * i
        best[1:] = np.maximum(table[i - 1, :-1] + np.where(codes == ord(ch), MATCH, MISMATCH), table[i - 1, 1:] + GAP)
        table[i] = np.maximum.accumulate(best - slope) + slope
    out, i, j = [], n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i, j] == table[i - 1, j] + GAP:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def token_offsets(text: str, tokens: Sequence[str]) -> list[tuple[int, int] | None]:
    """Half-open offsets of tokens in a text, None for one without a character there.

    Tokens found one after the other, with only white space between, are exact;
    otherwise the token string is aligned to the text.
    """
    found, at = [], 0
    for token in tokens:
        start = text.find(token, at) if token else -1
        if start < 0 or text[at:start].strip():
            break
        found.append((start, start + len(token)))
        at = start + len(token)
    if len(found) == len(tokens):
        return found
    owner = [k for k, t in enumerate(tokens) for _ in t]
    spans: list[tuple[int, int] | None] = [None] * len(tokens)
    for i, j in aligned("".join(tokens), text):
        if i >= 0 and j >= 0:
            k = owner[i]
            spans[k] = (min(spans[k][0], j), max(spans[k][1], j + 1)) if spans[k] else (j, j + 1)
    return spans


def offsets(text: str, tokens: str) -> Column:
    """``token_offsets`` of a text and an array of tokens, as an array of structs (b, e)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([None if t is None or ts is None else [None if s is None else {"b": s[0], "e": s[1]} for s in token_offsets(t, list(ts))] for t, ts in zip(texts, lists, strict=True)])

    return F.pandas_udf(run, "array<struct<b:int,e:int>>")(F.col(text), F.col(tokens))


# Token texts that are hardly ever a head.
NEVER_HEAD = ["\\", "/", "-"]


def head_scores(tokens: Sequence[str], deps: Sequence[tuple[int, int, str]], rounds: int = 21, never: Sequence[str] = NEVER_HEAD) -> list[int]:
    """A score a token, higher nearer the root: every governor ends above its dependents.

    Tokens in any dependency start at 1, others at 0, those of ``never`` at -1; cycles
    are cut off after ``rounds``. Dependencies count in the given order.
    """
    score = [0] * len(tokens)
    for g, d, _ in deps:
        score[g] = score[d] = 1
    score = [-1 if t in never else s for t, s in zip(tokens, score, strict=True)]
    for _ in range(rounds):
        changed = False
        for g, d, _kind in deps:
            if score[g] <= score[d]:
                score[g], changed = score[d] + 1, True
        if not changed:
            break
    return score


def heads(entities: DataFrame, toks: DataFrame, deps: DataFrame, never: Sequence[str] = NEVER_HEAD) -> DataFrame:
    """(doc_id, sent, first, last, head): the token of an entity with the highest head score, the last of equals."""
    words = toks.groupBy("doc_id", "sent").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]).alias("_words"))
    links = deps.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("gov", "dep", "type"))).alias("_deps"))
    names = entities.groupBy("doc_id", "sent").agg(F.collect_list(F.struct("first", "last")).alias("names"))
    return heads_in_row(words.join(links, ["doc_id", "sent"], "left").join(names, ["doc_id", "sent"]), "_words", F.col("_deps"), never)


def heads_in_row(sents: DataFrame, tokens: str, deps: Column, never: Sequence[str] = NEVER_HEAD) -> DataFrame:
    """``heads`` of sentences with their tokens, names (first, last) and dependencies (gov, dep, type) as arrays."""

    def run(ws: pd.Series, gs: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([head_scores(list(w), [] if d is None else [(x, y, "") for x, y in zip(g.tolist(), d.tolist(), strict=True)], never=never) for w, g, d in zip(ws, gs, ds, strict=True)])

    scores = F.pandas_udf(run, "array<int>")(F.col(tokens), deps["gov"], deps["dep"])
    rows = sents.select("doc_id", "sent", "names", scores.alias("_scores")).select("doc_id", "sent", "_scores", F.explode("names").alias("n")).select("doc_id", "sent", "_scores", "n.first", "n.last")
    best = F.array_max(F.transform(F.sequence("first", "last"), lambda i: F.struct(F.get("_scores", i).alias("s"), i.alias("i"))))
    return rows.select("doc_id", "sent", "first", "last", best["i"].alias("head"))


def split_at(token_begin: Column, token_end: Column, cuts: Column) -> Column:
    """A token's span as an array of structs (b, e), cut at the places inside it (name boundaries, hyphens)."""
    inner = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c > token_begin) & (c < token_end))))
    edges = F.concat(F.array(token_begin), inner, F.array(token_end))
    return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).alias("b"), F.get(edges, i + 1).alias("e")))


# The suffix rules of Porter (1980): (suffix, replacement) of steps 2 and 3, suffixes of step 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    fit = [e for e in endings if word.endswith(e)]
    return max(fit, key=len) if fit else None


def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (e := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        e = _longest(word, [r[0] for r in rules])
        if e and _measure(word[: -len(e)]):
            word = word[: -len(e)] + dict(rules)[e]
    e = _longest(word, STEP4)
    if e and _measure(word[: -len(e)]) > 1 and (e != "ion" or word[: -len(e)].endswith(("s", "t"))):
        word = word[: -len(e)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(df: DataFrame, column: str, out: str = "stem") -> DataFrame:
    """Column ``out``: stems of lower-case words; each distinct word is stemmed once."""

    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    words = df.select(F.lower(column).alias("_w")).where("_w is not null").distinct().withColumn(out, F.pandas_udf(run, "string")("_w"))
    return df.join(words, F.lower(F.col(column)) == F.col("_w"), "left").drop("_w")
