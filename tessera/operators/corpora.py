"""Operators on the tables of a corpus: marks, entity graphs, copies between corpora, merging, statistics.

Tables have the columns that ``sources.corpus`` gives them; ``key`` names the
columns that tell a sentence, so that the derived corpora work as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import ranked

SENT = ("sent_id",)


def token_marks(tokens: DataFrame, entities: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """The tokens with ``is_entity``, ``is_name`` and ``heads``, the ids of the entities whose head they overlap.

    ``entities`` has ent_id, given, spans and head; spans are half-open.
    """
    spans = entities.select(*key, "ent_id", "given", "head", F.explode("spans").alias("s"))
    own = [*key, "idx"]
    both = tokens.select(*own, "begin", "end").join(spans, list(key)).where("s.b < end and begin < s.e or head.b < end and begin < head.e")
    inside = F.expr("s.b < end and begin < s.e")
    marks = both.groupBy(*own).agg(
        F.bool_or(inside).alias("is_entity"),
        F.bool_or(inside & F.col("given")).alias("is_name"),
        F.array_sort(F.collect_set(F.when(F.expr("head.b < end and begin < head.e"), F.col("ent_id")))).alias("heads"),
    )
    none = F.array().cast("array<string>")
    out = tokens.join(marks, own, "left")
    return out.withColumns({"is_entity": F.coalesce("is_entity", F.lit(False)), "is_name": F.coalesce("is_name", F.lit(False)), "heads": F.coalesce("heads", none)})


def token_marks_in_row(tokens: str | Column, names: str | Column) -> Column:
    """``token_marks`` of an array of tokens as an array of (is_entity, is_name, heads).

    ``names`` is an array of (first, last, ent_id, given) in order that don't
    overlap; the last token of each is its head.
    """
    arr = F.col(names) if isinstance(names, str) else names
    mark = lambda entity, name, heads: F.struct(entity.alias("is_entity"), name.alias("is_name"), heads.alias("heads"))
    none = F.array().cast("array<string>")
    plain = lambda n: F.array_repeat(mark(F.lit(False), F.lit(False), none), n)
    head = lambda n, i: F.when(i == n["last"], F.array(n["ent_id"].cast("string"))).otherwise(none)
    inside = lambda n: F.transform(F.sequence(n["first"], n["last"]), lambda i: mark(F.lit(True), n["given"], head(n, i)))
    after = lambda k: F.coalesce(F.get(arr, k)["last"] + 1, F.lit(0))
    parts = F.flatten(F.transform(arr, lambda n, k: F.concat(plain(n["first"] - after(k - 1)), inside(n))))
    return F.concat(parts, plain(F.size(tokens) - after(F.size(arr) - 1)))


def head_links(interactions: DataFrame, heads: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """(key, t1, t2, type, int_id): interactions between head tokens, the first of each type and pair of tokens.

    ``heads`` has (key, ent_id, head); interactions with an end that has none are left out.
    """
    end = lambda e, t: heads.select(*key, F.col("ent_id").alias(e), F.col("head").alias(t))
    rows = interactions.select(*key, "int_id", "e1", "e2", "type").join(end("e1", "t1"), [*key, "e1"]).join(end("e2", "t2"), [*key, "e2"])
    return rows.groupBy(*key, "t1", "t2", "type").agg(F.min("int_id").alias("int_id"))


def merged_ids(entities: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """(key, ent_id, main_id): the first entity with equal type and spans; given ones are never merged into another."""
    same = Window.partitionBy(*key, "type", "spans").orderBy("place")
    first = F.first(F.when(~F.col("given"), F.col("ent_id")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return entities.select(*key, "ent_id", F.when(F.col("given"), F.col("ent_id")).otherwise(first).alias("main_id"))


def entity_graph(entities: DataFrame, interactions: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """(key, e1, e2, type): edges between merged entities, one for each type of an ordered pair."""
    ids = merged_ids(entities, key)
    rows = interactions.select(*key, "e1", "e2", "type")
    for end in ("e1", "e2"):
        rows = rows.join(ids.select(*key, F.col("ent_id").alias(end), F.col("main_id").alias("_m")), [*key, end], "left").withColumn(end, F.coalesce("_m", end)).drop("_m")
    return rows.distinct()


def unconnected_removed(entities: DataFrame, interactions: DataFrame) -> DataFrame:
    """Entities that are given or stand at an end of an interaction of any sentence."""
    ends = interactions.select(F.explode(F.array("e1", "e2")).alias("ent_id")).distinct()
    return entities.join(ends.withColumn("_c", F.lit(True)), "ent_id", "left").where("given or _c").drop("_c")


def emptied(entities: DataFrame, interactions: DataFrame, scope: str = "all") -> tuple[DataFrame, DataFrame]:
    """Entities and interactions without the annotation to be predicted: ``all``, ``non-given`` entities, or ``interactions`` only."""
    if scope not in ("all", "non-given", "interactions"):
        raise ValueError(f"no scope {scope}")
    kept = {"all": "false", "non-given": "given", "interactions": "true"}[scope]
    return entities.where(kept), interactions.where("false")


def without_attributes(df: DataFrame, *columns: str) -> DataFrame:
    """Attributes deleted: null in every row, so that the table keeps its shape."""
    return df.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) for c in columns if c in df.columns})


def renamed_columns(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(names))


def one_given_type(entities: DataFrame, label: str) -> DataFrame:
    """All given entities under one type."""
    return entities.withColumn("type", F.when(F.col("given"), F.lit(label)).otherwise(F.col("type")))


def retyped(df: DataFrame, rules: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Rows of a type get the values that its rule names, the new type among them."""
    columns = sorted({c for r in rules.values() for c in r})
    cases = {c: reduce(lambda acc, t, c=c: acc.when(F.col("type") == t, F.lit(rules[t][c])) if c in rules[t] else acc, rules, F.when(F.lit(False), None)).otherwise(F.col(c)) for c in columns}
    return df.withColumns(cases)


def catenated(parts: Sequence[DataFrame], doc: str = "doc_id", origin: str = "part") -> DataFrame:
    """Corpora one after the other; documents are numbered anew as ``origin.dN``, by part and then by old id."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_corpus", F.lit(i)) for i, p in enumerate(parts)])
    docs = ranked(rows.select("_corpus", doc).distinct(), ["_corpus", doc], "_n")
    new = docs.select("_corpus", doc, F.concat(F.lit(f"{origin}.d"), F.col("_n").cast("string")).alias("_new"))
    return rows.join(new, ["_corpus", doc]).withColumn(doc, F.col("_new")).drop("_corpus", "_new")


def merged_sets(parts: Mapping[str, DataFrame], allow_none: bool = False) -> DataFrame:
    """Tables of single sets as one with column ``set``; a row that names another set than its table is an error."""
    out = None
    for name, df in parts.items():
        if "set" in df.columns:
            wrong = F.col("set").isNull() | (F.col("set") != name)
            wrong = wrong & F.col("set").isNotNull() if allow_none else wrong
            df = df.withColumn("set", F.when(wrong, F.raise_error(F.lit(f"a row of set {name} names another"))).otherwise(F.lit(name)))
        else:
            df = df.withColumn("set", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def unique_dependencies(dependencies: DataFrame, key: Sequence[str] = SENT, order: str = "place") -> DataFrame:
    """The first dependency of each (type, governor, dependent) of a sentence."""
    own = [*key, "type", "t1", "t2"]
    rest = [c for c in dependencies.columns if c not in own]
    first = dependencies.groupBy(*own).agg(F.min_by(F.struct(*rest), order).alias("_x"))
    return first.select(*own, "_x.*").select(*dependencies.columns)


def copied_elements(source: DataFrame, target: DataFrame, key: str, match: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Target rows with the columns of the source row under the same key; each key stands once in both.

    A pair whose ``match`` columns differ, and a key that stands twice, are errors.
    """
    once = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    a = once(source).select(key, F.col("_n").alias("_ns"), *[F.col(c).alias(f"_m_{c}") for c in match], *[F.col(c).alias(f"_c_{c}") for c in columns])
    both = once(target).join(a, key, "left")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in match], F.lit(True))
    bad = F.col("_ns").isNotNull() & ((F.col("_ns") > 1) | (F.col("_n") > 1) | ~same)
    new = {c: F.when(bad, F.raise_error(F.lit("elements don't match"))).when(F.col("_ns").isNotNull(), F.col(f"_c_{c}")).otherwise(F.col(c) if c in target.columns else F.lit(None)) for c in columns}
    rest = [c for c in target.columns if c not in columns]
    return both.select(*rest, *[e.alias(c) for c, e in new.items()])


def copied_parses(source: DataFrame, target: DataFrame, parse: str, order: str) -> DataFrame:
    """Target sentences with the parse of the source sentence of equal text where they have none; of equal texts the last in ``order``."""
    last = source.where(F.col(parse).isNotNull()).groupBy("text").agg(F.max_by(parse, order).alias("_p"))
    return target.join(last, "text", "left").withColumn(parse, F.coalesce(parse, "_p")).drop("_p").select(*target.columns)


# Event types that a trigger's text can negate, and what in the text does.
EPI_TYPES = ["Phosphorylation", "Hydroxylation", "Ubiquitination", "DNA_methylation", "Glycosylation", "Acetylation", "Methylation"]
EPI_NEGATED = ["Dephosphorylation", "Dehydroxylation", "Deubiquitination", "DNA_demethylation", "Deglycosylation", "Deacetylation", "Demethylation"]
EPI_WORDS = ["remov", "loss", "erasure"]


def epi_type(kind: Column, trigger: Column) -> Column:
    """Merged types with each part set by the trigger's text: negated if it says removal or contains ``de`` at a word's start, else positive."""
    low = F.lower(trigger)
    negative = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in EPI_WORDS]) | low.startswith("de")
    base = F.create_map(*[F.lit(x) for a, b in zip(EPI_TYPES, EPI_NEGATED, strict=True) for x in (a, a, b, a)])
    other = F.create_map(*[F.lit(x) for a, b in zip(EPI_TYPES, EPI_NEGATED, strict=True) for x in (a, b)])
    part = lambda t: F.coalesce(F.when(negative, F.element_at(other, F.element_at(base, t))).otherwise(F.element_at(base, t)), t)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(kind, "---"), part))), "---")


def annotation_counts(rows: DataFrame, set_: str = "set", kind: str = "type", given: str = "given") -> DataFrame:
    """(set, type, n, given): counts by set and type, with ``total`` for all sets or all types, by one grouping-sets aggregate."""
    cube = rows.cube(set_, kind).agg(F.count("*").alias("n"), F.sum(F.col(given).cast("long")).alias("given"), F.grouping(set_).alias("_gs"), F.grouping(kind).alias("_gk"))
    return cube.select(
        F.when(F.col("_gs") == 1, F.lit("total")).otherwise(F.col(set_)).alias("set"), F.when(F.col("_gk") == 1, F.lit("total")).otherwise(F.col(kind)).alias("type"), "n", "given"
    )


def parse_coverage(elements: DataFrame) -> DataFrame:
    """(what, n): sentences, those without analyses, parses and tokenizations by name, and which of them are empty; of nested documents, in one pass."""
    s = elements.select(F.explode("sentence").alias("s")).select("s.analyses")
    some = F.col("analyses").isNotNull()
    lacks = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0

    def parse(p: Column) -> Column:
        name = F.concat(F.lit("parse:"), p["_parser"])
        empty = [(F.coalesce(p["_pennstring"], F.lit("")) == "", "(no penn)"), (lacks(p["dependency"]), "(no dependencies)"), (lacks(p["phrase"]), "(no phrases)")]
        return F.concat(F.array(name), F.filter(F.array(*[F.when(test, F.concat(name, F.lit(tag))) for test, tag in empty]), lambda x: x.isNotNull()))

    def tokenization(k: Column) -> Column:
        name = F.concat(F.lit("tokenization:"), k["_tokenizer"])
        return F.concat(F.array(name), F.filter(F.array(F.when(lacks(k["token"]), F.concat(name, F.lit("(no tokens)")))), lambda x: x.isNotNull()))

    own = F.array_compact(F.array(F.lit("sentence"), F.when(~some, "sentence-no-analyses"), F.when(some & F.col("analyses.parse").isNull(), "sentence-no-parses")))
    none = F.array().cast("array<string>")
    every = F.concat(own, *[F.coalesce(F.flatten(F.transform(f"analyses.{c}", one)), none) for c, one in (("parse", parse), ("tokenization", tokenization))])
    return s.select(F.explode(every).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def element_counts(elements: DataFrame) -> DataFrame:
    """(tag, n) of nested documents, in one pass."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    inside = lambda x: F.aggregate("sentence", F.lit(0).cast("long"), lambda n, s: n + size(s[x]))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    both = elements.agg(F.count("*").alias("document"), n(size(F.col("sentence"))).alias("sentence"), *[n(inside(x)).alias(x) for x in ("entity", "interaction", "pair")])
    return both.unpivot([], ["document", "sentence", "entity", "interaction", "pair"], "tag", "n")


def type_counts(marked: DataFrame, entities: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """(key, type, n): tokens of a sentence by the types of the entities they head; ``noAnnType`` for the others.

    ``marked`` are tokens of ``token_marks``.
    """
    rows = marked.select(*key, F.explode_outer("heads").alias("ent_id")).join(entities.select(*key, "ent_id", "type"), [*key, "ent_id"], "left")
    return rows.groupBy(*key, F.coalesce("type", F.lit("noAnnType")).alias("type")).agg(F.count("*").alias("n"))


def type_counts_in_row(marks: str, types: Column) -> Column:
    """``type_counts`` of a sentence as an array of (type, n), of ``token_marks_in_row`` and the types of its names."""
    bare = F.size(F.filter(marks, lambda m: F.size(m["heads"]) == 0))
    n = lambda k: F.size(F.filter(types, lambda x: x == k))
    found = F.transform(F.array_distinct(types), lambda k: F.struct(k.alias("type"), n(k).cast("long").alias("n")))
    return F.filter(F.concat(found, F.array(F.struct(F.lit("noAnnType").alias("type"), bare.cast("long").alias("n")))), lambda x: x["n"] > 0)


def compared_parses(a: DataFrame, b: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """(key, both, only_a, only_b): dependencies that two parses of a sentence share and that one has alone."""
    cols = [*key, "type", "t1", "t2"]
    side = lambda df, own: df.select(*cols, F.lit(own).alias("_a"), F.lit(not own).alias("_b"))
    # dependencies of one sentence share a task from the first shuffle on
    every = side(a, True).unionByName(side(b, False)).repartition(*key)
    each = every.groupBy(*cols).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    n = lambda test: F.sum(F.when(F.expr(test), 1).otherwise(0)).alias
    return each.groupBy(*key).agg(n("_a and _b")("both"), n("not _b")("only_a"), n("not _a")("only_b"))


def merged_parses(a: DataFrame, b: DataFrame, key: Sequence[str] = SENT) -> DataFrame:
    """Dependencies of two parses of the same tokens, each once."""
    cols = [*key, "type", "t1", "t2"]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def sites_of(arguments: DataFrame, parents: DataFrame, core: Sequence[str] = ("Theme", "Cause")) -> DataFrame:
    """(event, site, site_of): the core argument that each site argument of an event belongs to; sites without one are left out.

    ``arguments`` has (event, place, type, target), ``parents`` (target, parent),
    what the sites lie in. The only core argument needs no parent; of several, the
    first is taken whose target is a parent of the site. A core argument has one
    site at most. Arguments of one event, a few, are one row.
    """
    lies_in = parents.groupBy("target").agg(F.collect_set("parent").alias("parents"))
    part = F.struct("place", "type", "target", "parents")
    rows = arguments.join(lies_in, "target", "left").where(F.col("type").isin("Site", *core)).groupBy("event").agg(F.sort_array(F.collect_list(part)).alias("a"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for event, found in zip(frame["event"], frame["a"], strict=True):
                mains = [x for x in found if x["type"] != "Site"]
                taken: set = set()
                for site in (x for x in found if x["type"] == "Site"):
                    inside = () if site["parents"] is None else set(site["parents"])
                    fits = [m["place"] for m in mains if m["place"] not in taken and (len(mains) == 1 or m["target"] in inside)]
                    if fits:
                        taken.add(fits[0])
                        out.append((event, site["place"], fits[0]))
            yield pd.DataFrame(out, columns=["event", "site", "site_of"])

    kinds = dict(arguments.dtypes)
    some = rows.where(F.exists("a", lambda x: x["type"] == "Site") & F.exists("a", lambda x: x["type"] != "Site"))
    return some.mapInPandas(run, f"event {kinds['event']}, site {kinds['place']}, site_of {kinds['place']}")


def trigger_events(triggers: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, trigger, event): the events of each trigger, null for a trigger without one."""
    return triggers.select("doc_id", F.col("id").alias("trigger")).join(events.select("doc_id", "trigger", F.col("id").alias("event")), ["doc_id", "trigger"], "left")


def extended(entities: DataFrame, tokens: DataFrame, part: Column, key: Sequence[str] = SENT) -> DataFrame:
    """(key, ent_id, first, last): an entity's head token grown left and right over the tokens for which ``part`` holds.

    ``entities`` has (key, ent_id, idx). Each run of such tokens is one row, so an
    entity meets the run around its head and the runs next to it.
    """
    runs = tokens.where(part).withColumn("_g", F.col("idx") - F.row_number().over(Window.partitionBy(*key).orderBy("idx")))
    runs = runs.groupBy(*key, "_g").agg(F.min("idx").alias("_from"), F.max("idx").alias("_to"))
    both = entities.select(*key, "ent_id", "idx").join(runs, list(key), "left").withColumn("_near", F.expr("_from - 1 <= idx and idx <= _to + 1"))
    out = both.groupBy(*key, "ent_id", "idx").agg(F.min(F.when(F.col("_near"), F.col("_from"))).alias("_f"), F.max(F.when(F.col("_near"), F.col("_to"))).alias("_t"))
    return out.select(*key, "ent_id", F.least("idx", F.coalesce("_f", "idx")).alias("first"), F.greatest("idx", F.coalesce("_t", "idx")).alias("last"))


def extended_in_row(sents: DataFrame, part: Column, ends: Column, key: Sequence[str]) -> DataFrame:
    """``extended`` of sentences: ``part`` is an array of flags of the tokens, ``ends`` one of (ent_id, idx); no shuffle."""
    rows = sents.select(*key, part.alias("part"), *[ends[c].cast("array<int>").alias(c) for c in ("ent_id", "idx")]).where(F.size("idx") > 0)
    kinds = dict(rows.dtypes)
    names = [*key, "ent_id", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("part", "idx", "ent_id")]
            fine, idx = (x.flatten().to_numpy(zero_copy_only=False) for x in lists[:2])
            at = lists[0].offsets.to_numpy().astype(np.int64)
            begin, end = at[:-1] - at[0], at[1:] - at[0]
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists[1].offsets.to_numpy()))
            owner, place = np.repeat(np.arange(batch.num_rows), end - begin), np.arange(len(fine))
            # the nearest place before and after each that no run holds, at most one outside the sentence
            before = np.maximum.accumulate(np.maximum(np.where(fine, -1, place), begin[owner] - 1))
            after = np.minimum.accumulate(np.minimum(np.where(fine, len(fine), place), end[owner])[::-1])[::-1]
            here = begin[of] + idx
            first = np.where(idx > 0, before[here - 1] + 1, here) - begin[of]
            last = np.where(here + 1 < end[of], after[np.minimum(here + 1, len(fine) - 1)] - 1, here) - begin[of]
            columns = [batch.column(c).take(pa.array(of)) for c in key]
            yield pa.RecordBatch.from_arrays([*columns, lists[2].flatten(), *[pa.array(x, pa.int32()) for x in (first, last)]], names=names)

    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in key], "ent_id int, first int, last int"]))


def disjoint_types(relations: DataFrame) -> list[list[str]]:
    """Groups of relation types whose (type_a, type_b) sets don't overlap, merged greedily in the order of names.

    ``relations`` has (type, type_a, type_b), one small row for each combination
    that the schema has; only that schema comes to the driver.
    """
    ends: dict[str, set] = {}
    for r in relations.select("type", "type_a", "type_b").distinct().collect():
        ends.setdefault(r.type, set()).add((r.type_a, r.type_b))
    groups: list[tuple[list[str], set]] = []
    for kind in sorted(ends):
        for names, used in groups:
            if not used & ends[kind]:
                names.append(kind)
                used |= ends[kind]
                break
        else:
            groups.append(([kind], set(ends[kind])))
    return [names for names, _ in groups]


def sub_phrases(phrases: DataFrame, tokens: DataFrame, split: Sequence[str] = ("IN",), drop: Sequence[str] = ("DT",), key: Sequence[str] = SENT) -> DataFrame:
    """(key, type, first, last): the parts of a phrase between tokens of the ``split`` tags, and phrases without a leading ``drop`` token.

    ``phrases`` has (key, type, first, last). Derived types end in ``-IN`` and ``-DET``; empty parts and equal spans are left out.
    """
    tags = tokens.select(*key, "idx", "pos")
    inside = phrases.join(tags, list(key)).where("first <= idx and idx <= last")
    words = inside.where(~F.col("pos").isin(list(split)))
    own = [*key, "type", "first", "last"]
    run = F.col("idx") - F.row_number().over(Window.partitionBy(*own).orderBy("idx"))
    parts = words.withColumn("_g", run).groupBy(*own, "_g").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    parts = parts.where("a <> first or b <> last").select(*key, F.concat("type", F.lit("-IN")).alias("type"), F.col("a").alias("first"), F.col("b").alias("last"))
    det = inside.where(F.expr("idx = first and first < last") & F.col("pos").isin(list(drop)))
    det = det.select(*key, F.concat("type", F.lit("-DET")).alias("type"), (F.col("first") + 1).alias("first"), "last")
    return parts.unionByName(det).distinct()


def vocabulary(tokens: DataFrame, vectors: DataFrame, word: str = "text") -> DataFrame:
    """(word, n, vector): the distinct words of a corpus in lower case, how often they stand in it, and their vectors if known."""
    words = tokens.groupBy(F.lower(word).alias("word")).agg(F.count("*").alias("n"))
    return words.join(vectors.select("word", "vector"), "word", "left")


def coreference_targets(interactions: DataFrame) -> DataFrame:
    """(e1, targets): the entities that a mention's ``CorefTarget`` links name, each once, in the order of the links."""
    links = interactions.where("type = 'CorefTarget'").groupBy("e1", "e2").agg(F.min("place").alias("place"))
    return links.groupBy("e1").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "e2"))), lambda x: x["e2"]).alias("targets"))


def coreference_expanded(interactions: DataFrame) -> DataFrame:
    """(e1, e2, type): interactions with each end that is a mention replaced by its targets, a row for each choice."""
    targets = coreference_targets(interactions)
    rows = interactions.where("type <> 'CorefTarget'").select("e1", "e2", "type")
    for end in ("e1", "e2"):
        own = targets.select(F.col("e1").alias(end), F.col("targets").alias("_t"))
        rows = rows.join(own, end, "left").withColumn(end, F.explode(F.coalesce("_t", F.array(end)))).drop("_t")
    return rows.select("e1", "e2", "type").distinct()


def event_signatures(events: DataFrame, arguments: DataFrame) -> DataFrame:
    """(type, signature, n): events by type and by the sorted roles of their arguments; events without any have an empty one."""
    roles = arguments.groupBy("doc_id", "id").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("signature"))
    rows = events.select("doc_id", "id", "type").join(roles, ["doc_id", "id"], "left")
    return rows.groupBy("type", F.coalesce("signature", F.lit("")).alias("signature")).agg(F.count("*").alias("n"))
