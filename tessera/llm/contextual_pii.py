"""Personal data: identifiers of known form, and others that stand where such ones stand.

Base: four regular expressions with a check of what they match, ``KINDS``. The
method, bootstrapped contextual extraction, adds spans to these:

1. Seeds are the base identifiers; candidates are further strings of a loose form
   of the same kind (``LOOSE``) that touch no base span.
2. The one or two words before a seed are its lexical patterns, of the seed's kind.
3. Patterns and values make a graph. A pattern's confidence is the sum of the
   reliabilities of the values in its slot, over all places of those words in
   the corpus, whatever follows them; it also needs ``seeds`` distinct reliable
   values. A value's reliability is the chance that one of its contexts is right:
   1 less the product of 1 less the better confidence of each distinct context;
   that of a seed is 1.
4. Each round rates the patterns anew; values of ``accept`` or more count in the
   next. Rounds end when no value is new, or after ``rounds``. Candidates of
   reliable values are spans, at all their places.

So a pattern is held against every place of its words: words that usually stand
before something else find nothing. Everything is DataFrame code. Offsets come
from the lengths of what ``split`` leaves between matches, added up over the
matches of a row. Graph tables hold identifiers and not texts; each is written
to the shared folder, and sums combine before they shuffle, so a frequent word or
value reaches a task as one row a partition. Patterns are broadcast up to
``BROADCAST_ROWS``, else the places of all words are counted first and joined.

The regular expressions find what those in the contract find, without their
repeated scans of a long run of one sort of characters: quantifiers are
possessive where what follows can't match inside the run, and a match of e-mail,
ip and card begins where its run begins, or where the match before ended.

Defined results: a null text is empty and has no span; rows without doc_id,
repeated rows and different texts under one doc_id are rows of their own; very
long texts are read whole; ties of kind for one candidate go to the better
value, then to the kind listed first; empty tables give an empty result; further
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, durable, keyed

KINDS = ("email", "ip", "card", "phone")
#: The four base forms, in the order of ``KINDS``.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Looser forms: spelt-out signs, other separators, no check digit, no country code.
LOOSE = (
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({]at[\])}]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]{1,63}+){0,8}+",
    r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|[-_,])[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])(?<![0-9][\x20._/-])[0-9](?:[\x20._/-]?[0-9]){12,18}(?![\x20._/-]?[0-9])",
    r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?(?:[\x20./-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])",
)
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
#: Characters before a match in which its words are looked for.
CONTEXT = 160
SPACE = r"[\x20\x09-\x0D]+"
MATCH = "array<struct<kind:int,base:boolean,pos:int,lead:int,tail:string,match:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: Column, base: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    strict = F.when(kind == 0, F.lit(True)).when(kind == 1, match.rlike(OCTETS)).when(kind == 2, _luhn(digits)).otherwise(n.between(8, 15))
    loose = F.when(kind == 3, n.between(7, 15)).otherwise(F.lit(True))
    return F.when(base, strict).otherwise(loose)


def _plain(text: Column) -> Column:
    """Words as patterns have them: lower case, digits as 0."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def matches(rows: DataFrame) -> DataFrame:
    """(_row, kind, base, start, end, match, prev, last, glued) of all base spans and candidates of rows (_row, text).

    ``last`` is the word before the match and ``prev`` the one before that;
    ``glued`` says that no space stands between ``last`` and the match.
    """
    forms = [(k, base, p) for base, patterns in ((True, BASE), (False, LOOSE)) for k, p in enumerate(patterns)]
    text = rows.select("_row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{i}") for i, (_, _, p) in enumerate(forms)])

    def pieces(i: int, kind: int, base: bool, pattern: str) -> Column:
        zipped = F.arrays_zip(F.col(f"m{i}").alias("m"), F.split("text", pattern, -1).alias("p"))
        each = F.transform(
            zipped,
            lambda x, pos: F.struct(F.lit(kind), F.lit(base), pos, F.length(x["p"]), F.substring(x["p"], -CONTEXT, CONTEXT), x["m"]),
        )
        return F.when(F.size(f"m{i}") > 0, each).otherwise(F.array()).cast(MATCH)

    each = found.select("_row", F.explode(F.flatten(F.array(*[pieces(i, *f) for i, f in enumerate(forms)]))).alias("f")).select("_row", "f.*")
    before = Window.partitionBy("_row", "kind", "base").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.length("match")
    start = F.coalesce(F.sum(F.col("lead") + F.coalesce(own, F.lit(0))).over(before), F.lit(0)) + F.col("lead")
    each = each.withColumn("start", start).where("match is not null")
    each = each.where(_valid(F.col("kind"), F.col("base"), F.col("match")))
    tail = _plain(F.col("tail"))
    words = F.split(F.regexp_replace(tail, f"^{SPACE}|{SPACE}$", ""), SPACE)
    word = lambda back: F.when(F.size(words) >= back, F.nullif(F.try_element_at(words, F.lit(-back)), F.lit("")))
    return each.select(
        "_row", "kind", "base", "start", (F.col("start") + own).alias("end"), "match", word(2).alias("prev"), word(1).alias("last"),
        ((F.length("tail") > 0) & ~F.col("tail").rlike(SPACE + "$")).alias("glued"),
    )


def _apart(found: DataFrame) -> DataFrame:
    """Candidates that touch no base span of their row."""
    spans = found.where("base").groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rest = found.where("not base").join(spans, "_row", "left")
    return rest.where(F.expr("spans is null or not exists(spans, s -> s.start < end and start < s.end)")).drop("spans")


def _places(rows: DataFrame, contexts: DataFrame, glued: DataFrame) -> DataFrame:
    """(prev, last, places) for each of ``contexts``, prev null for single words: how often the words stand in the texts."""
    words = F.split(_plain(F.coalesce(F.col("text").cast("string"), F.lit(""))), SPACE)
    words = rows.select(words.alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "w").alias("a"), F.col("w").alias("b"))).alias("x"))
    pairs = pairs.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.lit(1).alias("n")).where("b is not null and b <> ''")
    few = contexts.count() <= BROADCAST_ROWS
    if not few:
        pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = pairs.join(F.broadcast(contexts) if few else contexts, F.expr("b = last and (prev is null or prev = a)"))
    stuck = glued.select(F.col("prev").alias("a"), F.col("last").alias("b"), "n").join(
        F.broadcast(contexts) if few else contexts, F.expr("b = last and (prev is null or prev = a)")
    )
    return both.select("prev", "last", "n").unionByName(stuck.select("prev", "last", "n")).groupBy("prev", "last").agg(F.sum("n").alias("places"))


def _both(graph: DataFrame) -> DataFrame:
    """A row for each pattern of a place: the last word alone, and with the word before it."""
    one = F.struct(F.lit(None).cast("string").alias("prev"), F.col("last"))
    two = F.struct("prev", "last")
    return graph.withColumn("p", F.explode(F.when(F.col("prev").isNull(), F.array(one)).otherwise(F.array(one, two)))).select(
        "kind", "value", "base", "n", "at", F.col("p.prev").alias("prev"), F.col("p.last").alias("last")
    )


def reliable_values(rows: DataFrame, found: DataFrame, rounds: int = 3, seeds: int = 3, confident: float = 0.5, accept: float = 0.5) -> DataFrame:
    """(kind, value, score) of the candidates' values that patterns find; ``found`` are the places (kind, value, base, prev, last, glued)."""
    graph = found.groupBy("kind", "value", "base", "prev", "last", "glued").agg(F.count("*").alias("n"))
    graph = durable(graph.withColumn("at", F.xxhash64("prev", "last")), "places")
    edges = _both(graph.where("last is not null"))
    # patterns that could find something: enough distinct values, a candidate among them
    open_ = edges.groupBy("kind", "prev", "last").agg(F.count_distinct("value").alias("values"), F.max(~F.col("base")).alias("any_new"))
    open_ = durable(open_.where((F.col("values") >= seeds) & F.col("any_new")).select("kind", "prev", "last"), "patterns")
    contexts = durable(open_.select("prev", "last").distinct(), "contexts")
    places = _places(rows, contexts, graph.where("glued and last is not null"))
    same = lambda a, b: (a["last"] == b["last"]) & a["prev"].eqNullSafe(b["prev"])
    patterns = open_.join(places, same(open_, places)).select("kind", open_["prev"], open_["last"], "places")
    linked = edges.join(patterns, (edges["kind"] == patterns["kind"]) & same(edges, patterns))
    linked = durable(linked.select(*[edges[c] for c in edges.columns], "places"), "graph")
    known = None
    for _ in range(rounds):
        if known is None:
            rated = linked.withColumn("score", F.when(F.col("base"), 1.0).otherwise(0.0))
        else:
            rated = linked.join(known, ["kind", "value"], "left")
            rated = rated.withColumn("score", F.when(F.col("base"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        good = rated.groupBy("kind", "prev", "last").agg(
            (F.sum(F.col("n") * F.col("score")) / F.max("places")).alias("confidence"),
            F.count_distinct(F.when(F.col("score") > 0, F.col("value"))).alias("support"),
        )
        good = durable(good.where((F.col("support") >= seeds) & (F.col("confidence") >= confident)), "confident").select(
            F.col("kind").alias("_kind"), F.col("prev").alias("_prev"), F.col("last").alias("_last"), F.least("confidence", F.lit(1.0)).alias("confidence")
        )
        new = linked.where("not base")
        new = new.join(good, (new["kind"] == good["_kind"]) & (new["last"] == good["_last"]) & new["prev"].eqNullSafe(good["_prev"]))
        # a context counts once, with its better pattern
        new = new.groupBy("kind", "value", "at").agg(F.max("confidence").alias("best"))
        wrong = F.exp(F.sum(F.log1p(-F.least("best", F.lit(1 - 1e-6)))))
        new = durable(new.groupBy("kind", "value").agg((1 - wrong).alias("score")).where(F.col("score") >= accept - 1e-9), "reliable")
        if known is not None and new.count() == known.count():
            return new
        known = new
        if known.isEmpty():
            return known
    return known


def identifiers(docs: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Rows (_row, doc_id), and their spans (_row, kind, start, end, base, match): code points, end exclusive; ``kind`` is a place in ``KINDS``."""
    rows = keyed(docs.select("doc_id", "text")).select("_row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    found = durable(matches(rows), "matches")
    value = F.regexp_replace(F.lower("match"), "[^0-9a-z@]", "")
    base, rest = found.where("base"), durable(_apart(found), "candidates")
    both = base.unionByName(rest).withColumn("value", value)
    reliable = reliable_values(rows.select("text"), both, **limits)
    added = rest.withColumn("value", value).join(reliable, ["kind", "value"])
    best = Window.partitionBy("_row", "start", "end").orderBy(F.col("score").desc(), "kind")
    added = added.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    spans = base.unionByName(added.select(*base.columns))
    return rows.select("_row", "doc_id"), spans.select("_row", "kind", "start", "end", "base", "match")


def digests(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row: counts and digest are those of the base spans."""
    own = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("s"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    of_base = F.filter("s", lambda x: x["base"])
    both = rows.join(own, "_row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")))
    count = lambda base, kinds: F.size(F.filter("s", lambda x: (x["base"] == base) & x["kind"].isin(*kinds))).cast("long")
    counts = [count(True, [k]).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = count(False, range(len(KINDS))).alias("n_added")
    return both.select(F.col("doc_id").cast("long"), *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), added)
