"""From documents to sentences and tokens with exact offsets, and features of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed token pattern: letters, digits, or one other visible character.
TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"


#: Lines whose offsets are added up at once.
LINES = 256


def _before(lengths: Column) -> Column:
    """For each number of an array the sum of those before it."""
    start = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s"))
    step = lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).alias("s"))
    return F.aggregate(lengths, start, step, lambda acc: acc["a"])


def line_starts(lines: Column) -> Column:
    """Offset of each line in the text that the lines make, line breaks included; in blocks, so that many lines stay linear."""
    lengths = F.transform(lines, lambda x: F.length(x) + 1)
    blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(LINES)), lambda k: F.slice(lengths, k, F.lit(LINES)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, _before(sums), lambda b, s: F.transform(_before(b), lambda x: x + s)))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, begin, end, text): lines, with the offsets of each in its document.

    Offsets are in characters, half-open; an empty line is no sentence. They come
    from the row itself, so nothing is shuffled.
    """
    rows = docs.where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    rows = rows.select("doc_id", F.posexplode(F.zip_with("lines", line_starts(F.col("lines")), lambda t, b: F.struct(t.alias("t"), b.alias("b")))).alias("sent", "x"))
    rows = rows.select("doc_id", "sent", F.col("x.b").alias("begin"), (F.col("x.b") + F.length("x.t")).alias("end"), F.col("x.t").alias("text"))
    return rows.where("text <> ''")


# Abbreviations whose full stop doesn't end a sentence.
ABBREVIATIONS = ["e.g", "i.e", "i.v", "vs", "cf", "Dr", "Mr", "Ms", "Mrs"]


def with_breaks(text: Column) -> Column:
    """The text with a line break in place of the last space between sentences, so that its length and all offsets stay.

    A sentence ends with a full stop, question or exclamation mark before spaces
    and a capital letter or a digit, but not after a listed abbreviation.
    """
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    held = F.regexp_replace(text, rf"\b({names})\. ", "$1\u0001 ")
    broken = F.regexp_replace(held, r"([.?!] *) ([A-Z0-9])", "$1\n$2")
    return F.replace(broken, F.lit("\u0001"), F.lit("."))


def split_sentences(docs: DataFrame) -> DataFrame:
    """``sentences`` of the text cut by rule: (doc_id, sent, begin, end, text, tail), the text without spaces at its end, which are its tail."""
    rows = sentences(docs.withColumn("text", with_breaks(F.col("text"))))
    bare = F.rtrim("text")
    rows = rows.withColumns({"tail": F.substr("text", F.length(bare) + 1), "text": bare}).where("text <> ''")
    return rows.select("doc_id", "sent", "begin", (F.col("begin") + F.length("text")).alias("end"), "text", "tail")


def spread(docs: DataFrame) -> DataFrame:
    """The documents dealt over the tasks: work inside of rows stays where the rows are, and few large files would be few tasks."""
    return docs.repartition("doc_id")


def tokens_of(text: str | Column) -> Column:
    """The tokens of a text as an array."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"))


def token_arrays(sents: DataFrame) -> DataFrame:
    """(doc_id, sent, tokens): the tokens of each sentence in one row; no shuffle."""
    return sents.select("doc_id", "sent", tokens_of("text").alias("tokens"))


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sent, idx, token) of each sentence; no shuffle."""
    return sents.select("doc_id", "sent", F.posexplode(tokens_of("text")).alias("idx", "token"))


def bag_of_words(toks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, n) of lower-case tokens."""
    return toks.groupBy(*keys, F.lower("token").alias("word")).agg(F.count("*").alias("n"))


def ngrams(toks: DataFrame, n: int) -> DataFrame:
    """(doc_id, sent, idx, gram): the token and the n - 1 before it; none where fewer precede."""
    w = Window.partitionBy("doc_id", "sent").orderBy("idx")
    parts = [F.lag("token", k).over(w) for k in range(n - 1, 0, -1)] + [F.col("token")]
    rows = toks.select("doc_id", "sent", "idx", F.array(*parts).alias("p"))
    return rows.where(F.col("idx") >= n - 1).select("doc_id", "sent", "idx", F.array_join("p", " ").alias("gram"))


def context(toks: DataFrame, reach: int = 3) -> DataFrame:
    """(doc_id, sent, idx, shift, token): neighbours up to ``reach`` places away; the first token is never one."""
    w = Window.partitionBy("doc_id", "sent").orderBy("idx")
    shifts = [k for k in range(-reach, reach + 1) if k]
    near = F.array(*[F.struct(F.lit(k).alias("shift"), F.lag("token", -k).over(w).alias("token")) for k in shifts])
    rows = toks.select("doc_id", "sent", "idx", near.alias("near")).select("doc_id", "sent", "idx", F.explode("near").alias("x"))
    return rows.where((F.col("idx") + F.col("x.shift") > 0) & F.col("x.token").isNotNull()).select("doc_id", "sent", "idx", "x.shift", "x.token")


def context_counts(rows: DataFrame, tokens: str, reach: int = 3, first: bool = False) -> DataFrame:
    """(shift, token, n): how often ``context`` has each token at each shift, of arrays of tokens; with ``first`` also the first token of each.

    A token is a neighbour of those up to ``reach`` places before and after it, so
    it is counted by how many there are on either side, and shifts are made of the counts.
    """
    each = rows.select((F.size(tokens) - 1).alias("last"), F.posexplode(tokens).alias("i", "token"))
    each = each if first else each.where("i > 0")
    sides = F.least("i", F.lit(reach)).alias("before"), F.least(F.col("last") - F.col("i"), F.lit(reach)).alias("after")
    counts = each.groupBy("token", *sides).agg(F.count("*").alias("n")).where("before + after > 0")
    shifts = F.filter(F.sequence(-F.col("after"), F.col("before")), lambda k: k != 0)
    return counts.select("token", "n", F.explode(shifts).alias("shift")).groupBy("shift", "token").agg(F.sum("n").alias("n"))


def shapes(token: str = "token") -> list[Column]:
    """Flags and character n-grams of a token."""
    t = F.col(token)
    grams = lambda n: F.when(
        F.length(t) >= n, F.array_join(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))), " ")
    )
    return [
        t.rlike("^[A-Z]").alias("upper_start"),
        t.rlike("^.+[A-Z]").alias("upper_inside"),
        t.rlike("[0-9]").alias("has_digit"),
        F.lower(F.regexp_replace(t, r"[-/,\\ ]", "")).alias("normal"),
        grams(2).alias("bigrams"),
        grams(3).alias("trigrams"),
    ]


def capitalised(toks: DataFrame) -> DataFrame:
    """(doc_id, sent, first, last): entities by rule, runs of capitalised tokens that don't open the sentence."""
    caps = toks.where((F.col("idx") > 0) & F.col("token").rlike("^[A-Z]"))
    run = F.col("idx") - F.row_number().over(Window.partitionBy("doc_id", "sent").orderBy("idx"))
    return caps.withColumn("run", run).groupBy("doc_id", "sent", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("run")


def held(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed once: the optimiser doesn't copy an expression into the lambdas that read it."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def capitalised_in_row(tokens: str | Column) -> Column:
    """``capitalised`` as an array of (first, last) of an array of tokens."""
    arr = F.col(tokens) if isinstance(tokens, str) else tokens
    cap = lambda i: (i > 0) & F.coalesce(F.get(arr, i), F.lit("")).rlike("^[A-Z]")
    places = F.filter(F.transform(arr, lambda _, i: i), cap)
    firsts, lasts = F.filter(places, lambda i: ~cap(i - 1)), F.filter(places, lambda i: ~cap(i + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def near_in_row(names: str | Column, reach: int) -> Column:
    """The ``pairs`` no farther apart than ``reach``, as an array, of an array of (first, last) in order that don't overlap.

    Each name is a place or more behind the one before it, so the next ``reach`` are all that can be near.
    """
    arr = F.col(names) if isinstance(names, str) else names
    pair = lambda a, b: F.struct(a["first"].alias("first_a"), b["first"].alias("first_b"), (b["first"] - a["last"]).alias("distance"))
    following = lambda a, i: F.filter(F.transform(F.slice(arr, i + 2, F.lit(reach)), lambda b: pair(a, b)), lambda p: p["distance"] <= reach)
    return F.flatten(F.transform(arr, following))


def pairs(entities: DataFrame) -> DataFrame:
    """(doc_id, sent, first_a, first_b, distance): entity pairs of a sentence, earlier first."""
    a, b = (entities.select("doc_id", "sent", F.col("first").alias(f"first_{x}"), F.col("last").alias(f"last_{x}")) for x in "ab")
    both = a.join(b, ["doc_id", "sent"]).where("first_a < first_b")
    return both.select("doc_id", "sent", "first_a", "first_b", (F.col("first_b") - F.col("last_a")).alias("distance"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides whose half-open spans (begin, end) overlap under equal keys."""
    a = left.withColumnsRenamed({"begin": "begin_a", "end": "end_a"})
    b = right.withColumnsRenamed({"begin": "begin_b", "end": "end_b"})
    return a.join(b, keys).where("begin_a < end_b and begin_b < end_a")


def best(rows: DataFrame, keys: list[str], score: str, index: str) -> DataFrame:
    """One row for each key: the highest score, the last index on ties; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(score, index)).alias("_x"))
    return top.select(*keys, "_x.*").select(*rows.columns)


def best_in_row(items: Column, score: Callable[[Column], Column]) -> Column:
    """``best`` of an array: its (score, idx, token) with the highest score, the last of equals."""
    return F.array_max(F.transform(items, lambda w, i: F.struct(score(w).alias("score"), i.alias("idx"), w.alias("token"))))


def merged(sents: DataFrame) -> DataFrame:
    """(doc_id, text, stop): a document's sentences joined by line breaks, and the end of the last one."""
    rows = F.array_sort(F.collect_list(F.struct("sent", "text")))
    return sents.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"), F.max("end").alias("stop"))


def into_sentences(entities: DataFrame, sents: DataFrame) -> DataFrame:
    """Document-level entities (doc_id, id, begin, end) with the first sentence they overlap and their offsets in it.

    Offsets are cut to the sentence; entities that overlap none are left out.
    """
    both = overlaps(entities.select("doc_id", "id", "begin", "end"), sents.select("doc_id", "sent", "begin", "end"), ["doc_id"])
    first = both.groupBy("doc_id", "id").agg(F.min(F.struct("sent", "begin_a", "end_a", "begin_b", "end_b")).alias("x")).select("doc_id", "id", "x.*")
    begin = F.greatest(F.col("begin_a") - F.col("begin_b"), F.lit(0))
    return first.select("doc_id", "id", "sent", begin.alias("begin"), (F.least("end_a", "end_b") - F.col("begin_b")).alias("end"))


def matched_phrases(phrases: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, phrase, entity): the entity around a phrase whose ends differ least, the least id of equals.

    ``phrases`` has (doc_id, phrase, begin, end), ``entities`` (doc_id, id, begin, end, given); given ones are left out.
    """
    a = phrases.select("doc_id", "phrase", F.col("begin").alias("_b"), F.col("end").alias("_e"))
    both = a.join(entities.where("not given").select("doc_id", "id", "begin", "end"), "doc_id").where("begin <= _b and _e <= end")
    off = F.abs(F.col("begin") - F.col("_b")) + F.abs(F.col("end") - F.col("_e"))
    return both.groupBy("doc_id", "phrase").agg(F.min(F.struct(off.alias("o"), "id")).alias("x")).select("doc_id", "phrase", F.col("x.id").alias("entity"))
