"""Predictions written back as annotation, and the structural rules they must keep.

Entities have (doc_id, id, type, given), relations (doc_id, id, type, a, b).
Every loop ends when nothing changes any more, and raises beyond its stated
number of rounds: no result is cut short. Each round's table is checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled, unsettled


def split_predictions(predicted: DataFrame, keys: list[str], prefix: str = "e", start: str | None = None) -> DataFrame:
    """A row with a new id for each type of a predicted class; ``neg`` gives none.

    Ids are numbered inside the first key, after ``start``, a column with the
    last number in use.
    """
    rows = predicted.where("class <> 'neg'").select(*predicted.columns, F.posexplode(F.split("class", "---")).alias("_p", "type"))
    place = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:], "_p")) + (F.coalesce(F.col(start), F.lit(-1)) if start else -1)
    return rows.withColumn("id", F.concat(F.lit(prefix), place.cast("string"))).drop("_p", "class")


def relation_schema(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, type_a, type_b): the combinations that occur."""
    return typed(entities, relations).select("type", "type_a", "type_b").distinct()


def typed(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with the types of both ends; those without one of the ends are left out."""
    end = lambda n: entities.select("doc_id", F.col("id").alias(n), F.col("type").alias(f"type_{n}"))
    return relations.join(end("a"), ["doc_id", "a"]).join(end("b"), ["doc_id", "b"])


def valid_relations(entities: DataFrame, relations: DataFrame, schema: DataFrame, keep_neg: bool = False) -> DataFrame:
    """Relations whose types the schema has; with ``keep_neg`` the others stay as ``neg``."""
    rows = typed(entities, relations).join(schema.withColumn("_ok", F.lit(True)), ["type", "type_a", "type_b"], "left")
    if keep_neg:
        rows = rows.withColumn("type", F.when(F.col("_ok"), F.col("type")).otherwise("neg"))
    else:
        rows = rows.where("_ok")
    return rows.select(*relations.columns)


def validate(entities: DataFrame, relations: DataFrame, schema: DataFrame, needs: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that keep the rules, by removal until nothing changes.

    A relation goes if the schema lacks its types or an end is gone. An entity
    that isn't given goes if it has fewer outgoing relations of a type than
    ``needs`` (type, argument, least) says, or more than ``most`` where ``needs``
    has that column, so that a removal can cause others.
    """
    asked = needs.select("type", F.col("argument").alias("_arg"), F.col("least").alias("_least"), (F.col("most") if "most" in needs.columns else F.lit(None).cast("long")).alias("_most"))
    asked = asked.where("_least > 0 or _most is not null")
    n = None
    for _ in range(rounds):
        relations = settled(valid_relations(entities, relations, schema))
        have = relations.groupBy("doc_id", F.col("a").alias("id"), F.col("type").alias("_arg")).agg(F.count("*").alias("_n"))
        lacking = entities.where("not given").join(asked, "type").join(have, ["doc_id", "id", "_arg"], "left").where("coalesce(_n, 0) < _least or coalesce(_n, 0) > _most")
        entities = settled(entities.join(lacking.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti"))
        now = (entities.count(), relations.count())
        if now == n:
            return entities, relations
        n = now
    raise unsettled("validation", rounds)


def grown_events(events: DataFrame, given: DataFrame, rounds: int = 1000) -> DataFrame:
    """(doc_id, id, level): events whose arguments are given or grown before, innermost first.

    ``events`` has (doc_id, id, arguments array); an event in a cycle, or with an
    unknown argument, never grows. There are as many rounds as events nest.
    """
    parts = settled(events.select("doc_id", "id", F.explode_outer("arguments").alias("arg")))
    events = parts.select("doc_id", "id").distinct()
    known = given.select("doc_id", F.col("id").alias("arg"))
    grown, before = None, 0
    for level in range(rounds):
        missing = parts.where("arg is not null").join(known, ["doc_id", "arg"], "left_anti").select("doc_id", "id").distinct()
        ready = events.join(missing, ["doc_id", "id"], "left_anti").withColumn("level", F.lit(level))
        grown = settled(ready if grown is None else grown.unionByName(ready.join(grown, ["doc_id", "id"], "left_anti")))
        now = grown.count()
        if now == before:
            return grown
        before = now
        known = given.select("doc_id", F.col("id").alias("arg")).unionByName(grown.select("doc_id", F.col("id").alias("arg")))
    raise unsettled("growth", rounds)


def with_modifiers(events: DataFrame, predicted: DataFrame) -> DataFrame:
    """Events with negation and speculation from the predicted class (doc_id, id, class)."""
    kinds = F.split(F.coalesce("class", F.lit("neg")), "---")
    rows = events.drop("negation", "speculation").join(predicted.select("doc_id", "id", "class"), ["doc_id", "id"], "left")
    return rows.withColumn("negation", F.array_contains(kinds, "negation")).withColumn("speculation", F.array_contains(kinds, "speculation")).drop("class")


def deduplicated(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with equal (doc_id, type, spans) merged into the first id, and relations moved to it, once each.

    Given entities are never merged away.
    """
    keys = ["doc_id", "type", "spans"]
    first = entities.groupBy(*keys).agg(F.min_by("id", F.struct(~F.col("given"), "id")).alias("_first"))
    marked = entities.join(first, keys).withColumn("_keep", F.when(F.col("given"), F.col("id")).otherwise(F.col("_first"))).select(*entities.columns, "_keep")
    moved = marked.select("doc_id", "id", "_keep")
    rows = relations
    for end in ("a", "b"):
        rows = rows.join(moved.withColumnsRenamed({"id": end, "_keep": "_to"}), ["doc_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    rest = [c for c in relations.columns if c not in ("doc_id", "type", "a", "b")]
    rows = rows.groupBy("doc_id", "type", "a", "b").agg(F.min_by(F.struct(*rest), "id").alias("_x")).select("doc_id", "type", "a", "b", "_x.*").select(*relations.columns)
    return marked.where("id = _keep").drop("_keep"), rows


def chased(links: DataFrame) -> DataFrame:
    """(id, root): where each chain of (id, target) ends, by doubling; null for a chain that runs into a cycle.

    After as many doublings as the number of links has digits, every chain without a cycle has ended.
    """
    found = links.select("id", F.col("target").alias("root")).dropDuplicates(["id"])
    for _ in range(max(1, found.count()).bit_length() + 1):
        on = found.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        found = settled(found.join(on, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_open")))
        if found.where("_open").isEmpty():
            break
        found = found.drop("_open")
    ends = found.select("id", "root").join(links.select(F.col("id").alias("root")).distinct().withColumn("_inner", F.lit(True)), "root", "left")
    return ends.select("id", F.when(F.col("_inner").isNull(), F.col("root")).alias("root"))


def nesting(events: DataFrame, rounds: int = 1000) -> DataFrame:
    """(chain, n): types from each outermost event down through its nested events.

    ``events`` has (doc_id, id, type, arguments array of ids); a chain ends where
    no argument is an event. Events below no outermost one, which are those of
    cycles, are in no chain; an outermost event that leads into a cycle has no
    end, so that is an error after ``rounds`` steps.
    """
    events = settled(events)
    ids = events.select("doc_id", F.col("id").alias("arg"), F.col("type").alias("_type"))
    parts = settled(events.select("doc_id", "id", F.explode("arguments").alias("arg")).join(ids, ["doc_id", "arg"]))
    inner = parts.select("doc_id", F.col("arg").alias("id")).distinct()
    walk = events.join(inner, ["doc_id", "id"], "left_anti").select("doc_id", "id", F.col("type").alias("chain"))
    # chains that have come to one event by the same types go on together, with their number
    walk = walk.withColumn("n", F.lit(1).cast("long"))
    found = None
    for _ in range(rounds):
        step = walk.join(parts, ["doc_id", "id"], "left")
        ended = step.where("arg is null").groupBy("chain").agg(F.sum("n").alias("n"))
        found = ended if found is None else found.unionByName(ended)
        longer = step.where("arg is not null").groupBy("doc_id", F.col("arg").alias("id"), F.concat_ws(">", "chain", "_type").alias("chain"))
        walk = settled(longer.agg(F.sum("n").alias("n")))
        if walk.isEmpty():
            return found.groupBy("chain").agg(F.sum("n").alias("n"))
    raise unsettled("nesting", rounds)


def argument_choices(roles: dict[str, list[str]], limits: dict[str, tuple[int, int]]) -> list[tuple[tuple[str, str], ...]]:
    """Every choice of (role, argument) with between least and most arguments of each role, at least one in all."""
    from itertools import combinations, product

    options = []
    for role, (least, most) in sorted(limits.items()):
        have = sorted(roles.get(role, []))
        options.append([tuple((role, a) for a in c) for k in range(least, min(most, len(have)) + 1) for c in combinations(have, k)])
    return [flat for choice in product(*options) if (flat := tuple(x for part in choice for x in part))]


def unmerging_examples(arguments: DataFrame, gold: DataFrame, limits: Callable[[str], dict[str, tuple[int, int]]]) -> DataFrame:
    """(doc_id, trigger, arguments, class): all valid argument choices of a trigger; its type where gold has the same set, else neg.

    ``arguments`` has (doc_id, trigger, type, role, arg) and ``gold`` (doc_id,
    trigger, arguments array of ``role:arg``). A trigger's arguments, of one
    sentence, are one row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                roles: dict[str, list[str]] = {}
                for x in r.parts:
                    roles.setdefault(x["role"], []).append(x["arg"])
                rows += [(r.doc_id, r.trigger, r.type, sorted(f"{k}:{a}" for k, a in c)) for c in argument_choices(roles, limits(r.type))]
            yield pd.DataFrame(rows, columns=["doc_id", "trigger", "type", "arguments"])

    kinds = dict(arguments.dtypes)
    gathered = arguments.groupBy("doc_id", "trigger").agg(F.min("type").alias("type"), F.collect_set(F.struct("role", "arg")).alias("parts"))
    made = gathered.mapInPandas(run, f"doc_id {kinds['doc_id']}, trigger {kinds['trigger']}, type string, arguments array<string>")
    true = gold.select("doc_id", "trigger", F.array_sort("arguments").alias("arguments")).distinct().withColumn("_g", F.lit(True))
    rows = made.join(true, ["doc_id", "trigger", "arguments"], "left")
    return rows.select("doc_id", "trigger", "type", "arguments", F.when(F.col("_g"), F.col("type")).otherwise("neg").alias("class"))


def nested_scores(scored: DataFrame, nested: DataFrame) -> DataFrame:
    """(id, score): the least standardised score of an event and of all events inside it.

    ``scored`` has (id, kind, score), several scores an event; each kind is brought
    to mean 0 and standard deviation 1. ``nested`` has (id, inner).
    """
    from tessera.operators.graphs import ancestors

    stats = scored.groupBy("kind").agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    own = scored.join(F.broadcast(stats), "kind").groupBy("id").agg(F.min((F.col("score") - F.col("_m")) / F.col("_s")).alias("score"))
    inside = ancestors(nested.select(F.col("id").alias("child"), F.col("inner").alias("parent")))
    deeper = inside.join(own.select(F.col("id").alias("ancestor"), "score"), "ancestor").select(F.col("child").alias("id"), "score")
    return own.unionByName(deeper).groupBy("id").agg(F.min("score").alias("score"))
