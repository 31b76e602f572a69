"""Equality of nested structures as joins: classes of equal nodes, and digests of whole event trees.

Both go from the innermost nodes outwards, a join a level, on tables of all
documents at once. A round looks only at nodes whose arguments are new since the
round before, so the work of all rounds follows the number of arguments and not
that times the depth. Loops end when a round finds nothing, or raise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled, unsettled

#: Rounds whose results are separate tables until they are put together.
LAYERS = 32


def keepers(nodes: DataFrame, arguments: DataFrame, group: list[str], rounds: int = 1000) -> DataFrame:
    """(group, id, keeper): nodes with equal ``label`` and arguments merged into the first, until nothing changes.

    ``nodes`` has (group, id, label), ``arguments`` (group, id, role, arg). An
    argument that is a merged node counts as its keeper; arguments are a bag of
    (role, arg). Nodes of a cycle are equal only if their arguments are already.
    The classes are found from below, each node in the round after its last
    argument's, for equal nodes have equal depths; nodes that lead into a cycle
    are left for the end and refined until nothing changes.
    """
    key = [*group, "id"]
    own = nodes.select(*key, "label")
    some = arguments.select(*key, "role", "arg")
    inner = nodes.select(*group, F.col("id").alias("arg"), F.lit(True).alias("_node")).distinct()
    args = some.join(inner, [*group, "arg"], "left")
    known = args.groupBy(*key).agg(F.count("*").alias("size"), F.collect_list(F.when(F.col("_node").isNull(), F.struct("role", F.col("arg").alias("to")))).alias("parts"))
    none = F.array().cast(dict(known.dtypes)["parts"])
    rows = own.join(known, key, "left").select(*key, "label", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("parts", none).alias("own"))
    rows = settled(rows.repartition(*key))
    inner = settled(args.where("_node").select(*key, "role", "arg").repartition(*group, "arg"))
    bag = lambda df: df.groupBy(*key).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    # equal nodes of one depth, the first of them each one's keeper
    first = lambda df: df.select(*key, F.min("id").over(Window.partitionBy(*group, "label", F.array_sort("_all"))).alias("keeper"))
    ready = settled(first(rows.where(F.size("own") == F.col("size")).withColumn("_all", F.col("own"))))
    found, partial = [ready], None
    for _ in range(rounds):
        new = inner.join(ready.select(*group, F.col("id").alias("arg"), F.col("keeper").alias("to")), [*group, "arg"]).select(*key, F.array(F.struct("role", "to")).alias("parts"))
        met = settled(rows.join(bag(new if partial is None else partial.unionByName(new)), key).withColumn("_all", F.concat("own", "parts")))
        ready = settled(first(met.where(F.size("_all") == F.col("size"))))
        partial = met.where(F.size("_all") < F.col("size")).select(*key, "parts")
        if ready.isEmpty():
            break
        found = [*found, ready] if len(found) < LAYERS else [settled(reduce(DataFrame.unionByName, [*found, ready]))]
    else:
        raise unsettled("merging of equal nodes", rounds)
    done = settled(reduce(DataFrame.unionByName, found))
    rest = settled(own.join(done.select(*key), key, "left_anti"))
    if rest.isEmpty():
        return done
    keeper = done.where("id <> keeper").select(*group, F.col("id").alias("arg"), "keeper")
    left = some.join(rest.select(*key), key, "left_semi").join(keeper, [*group, "arg"], "left")
    return done.unionByName(_refined(rest, left.select(*key, "role", F.coalesce("keeper", "arg").alias("arg")), group, rounds))


def _refined(nodes: DataFrame, arguments: DataFrame, group: list[str], rounds: int) -> DataFrame:
    """``keepers`` round by round: classes are a label and the arguments' keepers, found anew until none merge."""
    key = [*group, "id"]
    args = settled(arguments.select(*key, "role", "arg"))
    own = settled(nodes.select(*key, "label"))
    now = args.withColumn("to", F.col("arg"))
    found = settled(own.select(*key, F.col("id").alias("keeper")))
    for _ in range(rounds):
        bags = now.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("role", "to"))).alias("bag"))
        kinds = settled(own.join(bags, key, "left").select(*key, "label", "bag"))
        same = ["label", "bag"]
        first = kinds.groupBy(*group, *same).agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        left, right = kinds.alias("k"), first.alias("f")
        equal = F.lit(True)
        for c in [*group, *same]:
            equal = equal & F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}"))
        merged = settled(left.join(right, equal).where("k.id <> f.keeper").select(*[F.col(f"k.{c}") for c in key], F.col("f.keeper").alias("_to")))
        if merged.isEmpty():
            return found
        # classes hold their members, so who was merged before goes where its keeper went
        moved = merged.select(*group, F.col("id").alias("keeper"), "_to")
        found = settled(found.join(moved, [*group, "keeper"], "left").select(*key, F.coalesce("_to", "keeper").alias("keeper")))
        own = settled(own.join(merged.select(*key), key, "left_anti"))
        targets = merged.select(*group, F.col("id").alias("to"), "_to")
        now = settled(now.join(merged.select(*key), key, "left_anti").join(targets, [*group, "to"], "left").withColumn("to", F.coalesce("_to", "to")).drop("_to"))
    raise unsettled("merging of equal nodes", rounds)


def digests(events: DataFrame, arguments: DataFrame, entities: DataFrame, group: list[str], core: bool = False, rounds: int = 1000) -> DataFrame:
    """(group, id, type, digest): equal for events whose trees are equal, whatever their ids.

    ``events`` and ``entities`` have (group, id, type, span), span the text that
    states a place; ``arguments`` (group, id, role, arg), arg an event or entity.
    A tree is type and span of the event and, for each argument, its role and the
    tree of its target. With ``core`` a nested event counts by its type and span
    alone. Events that lead into a cycle, or to a target that isn't there, have no
    digest.
    """
    key = [*group, "id"]
    one = lambda kind: F.sha2(F.concat_ws("\u0001", F.lit(kind), "type", "span"), 256)
    last = entities.select(*group, F.col("id").alias("arg"), one("entity").alias("h"))
    if core:
        last = last.unionByName(events.select(*group, F.col("id").alias("arg"), one("event").alias("h")))
    part = F.concat_ws("\u0001", "role", "h")
    bag = lambda df: df.groupBy(*key).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    tree = lambda parts: F.sha2(F.concat_ws("\u0001", F.lit("event"), "type", "span", F.array_join(F.array_sort(parts), "\u0002")), 256)
    args = arguments.select(*key, "role", "arg").join(last, [*group, "arg"], "left")
    # a row an event: the parts that are known from the outset, and how many it waits for
    known = args.groupBy(*key).agg(F.count("*").alias("size"), F.collect_list(F.when(F.col("h").isNotNull(), part)).alias("parts"))
    rows = events.select(*key, "type", "span").join(known, key, "left")
    rows = rows.select(*key, "type", "span", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("parts", F.array().cast("array<string>")).alias("own"))
    rows = settled(rows)
    ready = settled(rows.where(F.size("own") == F.col("size")).select(*key, "type", tree(F.col("own")).alias("digest")))
    if core or ready.isEmpty():
        return ready
    # both are dealt by what a round asks of them, so that it shuffles only what is new in it
    waiting = settled(rows.where(F.size("own") < F.col("size")).repartition(*key))
    inner = settled(args.where("h is null").select(*key, "role", "arg").repartition(*group, "arg"))
    found, partial = [ready], None
    for _ in range(rounds):
        new = inner.join(ready.select(*group, F.col("id").alias("arg"), F.col("digest").alias("h")), [*group, "arg"]).select(*key, F.array(part).alias("parts"))
        met = waiting.join(bag(new if partial is None else partial.unionByName(new)), key)
        met = settled(met.withColumn("_all", F.concat("own", "parts")))
        ready = settled(met.where(F.size("_all") == F.col("size")).select(*key, "type", tree(F.col("_all")).alias("digest")))
        partial = met.where(F.size("_all") < F.col("size")).select(*key, "parts")
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found = [*found, ready] if len(found) < LAYERS else [settled(reduce(DataFrame.unionByName, [*found, ready]))]
    raise unsettled("nesting of events", rounds)


def nested_outcomes(predicted: DataFrame, gold: DataFrame, group: list[str]) -> DataFrame:
    """(type, tp, fp, fn) of events with ``digests``: of equal ones in a group as many match as both sides have.

    Sides are tables (group, id, type, digest); events without a digest match
    nothing, so they are given with a null one.
    """
    by = [*group, "type", "digest"]
    side = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    p, g = side(predicted, "p").alias("p"), side(gold, "g").alias("g")
    same = F.col("p.digest") == F.col("g.digest")
    for c in by[:-1]:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}"))
    both = p.join(g, same, "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = both.select(F.coalesce("p.type", "g.type").alias("type"), F.least(n("p"), n("g")).alias("tp"), n("p").alias("p"), n("g").alias("g"))
    sums = rows.groupBy("type").agg(*[F.sum(c).alias(c) for c in ("tp", "p", "g")])
    return sums.select("type", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def compared_events(predicted: tuple[DataFrame, DataFrame], gold: tuple[DataFrame, DataFrame], entities: tuple[DataFrame, DataFrame], group: list[str], core: bool = False) -> DataFrame:
    """``nested_outcomes`` of two sides (events, arguments), each with its own entities."""

    def side(events: DataFrame, arguments: DataFrame, names: DataFrame) -> DataFrame:
        known = digests(events, arguments, names, group, core).select(*group, "id", "digest")
        return events.select(*group, "id", "type").join(known, [*group, "id"], "left")

    return nested_outcomes(side(*predicted, entities[0]), side(*gold, entities[1]), group)


def scored(outcomes: DataFrame, type_: Column | str = "type") -> DataFrame:
    """Outcomes with precision, recall and f-score, and the row ``micro`` over all types."""
    kind = F.col(type_) if isinstance(type_, str) else type_
    total = outcomes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro").alias("type"), "tp", "fp", "fn")
    rows = outcomes.select(kind.alias("type"), "tp", "fp", "fn").unionByName(total)
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("fscore", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
