"""Standoff annotation as entities and interactions, and back.

Standoff has triggers (text-bound), events that share them, and arguments that are
text-bound or events again. Flat tables have an entity for each event, at its
trigger's place, and an interaction for each argument; or one entity for each
trigger, where the events that share it fall together. The way back makes a
trigger of equal entities' places and an event of each event entity, so standoff
that went through the tables is the same up to ids. All steps are joins by
document and id; ids are numbered inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARGUMENTS = "array<struct<role:string,target:string>>"
# Kinds of modifiers.
MODIFIERS = {"Negation": "negation", "Speculation": "speculation"}


def flat(rows: DataFrame, keys: list[str], by_trigger: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities (keys, id, type, spans, text, given, event, negation, speculation) and interactions (keys, id, type, e1, e2, event, e1_role, e2_role).

    ``rows`` are those of ``parse_standoff``. An event's entity has its id, or with
    ``by_trigger`` that of its trigger, once for all its events. Text-bound rows
    that trigger nothing are given. Events without a trigger, and modifiers of
    what isn't there, are left out.
    """
    bound = rows.where(F.col("kind").isin("T", "W")).select(*keys, "id", "type", "spans", "text")
    events = rows.where("kind = 'E'").select(*keys, "id", "type", "trigger", "arguments")
    places = bound.select(*keys, F.col("id").alias("trigger"), "spans", "text")
    marks = rows.where("kind = 'M'").select(*keys, "type", F.explode("arguments").alias("a")).select(*keys, F.col("a.target").alias("id"), "type")
    marks = marks.groupBy(*keys, "id").agg(F.collect_set("type").alias("marks"))
    placed = events.join(places, [*keys, "trigger"]).join(marks, [*keys, "id"], "left")
    flags = [F.coalesce(F.array_contains("marks", kind), F.lit(False)).alias(name) for kind, name in MODIFIERS.items()]
    own = placed.select(*keys, *([F.col("trigger").alias("id")] if by_trigger else ["id"]), "type", "spans", "text", F.lit(False).alias("given"), F.lit(True).alias("event"), *flags)
    if by_trigger:
        own = own.groupBy(*keys, "id", "type", "spans", "text", "given", "event").agg(*[F.max(n).alias(n) for n in MODIFIERS.values()])
    free = bound.join(events.select(*keys, F.col("trigger").alias("id")).distinct(), [*keys, "id"], "left_anti")
    free = free.select("*", F.lit(True).alias("given"), F.lit(False).alias("event"), *[F.lit(False).alias(n) for n in MODIFIERS.values()])

    ids = events.select(*keys, F.col("id").alias("of"), F.col("trigger").alias("to"))
    moved = lambda df, c: df.join(ids.withColumnsRenamed({"of": c, "to": "_to"}), [*keys, c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    parts = events.where("trigger is not null").select(*keys, F.col("id").alias("e1"), F.explode("arguments").alias("a")).select(*keys, F.col("a.role").alias("type"), "e1", F.col("a.target").alias("e2"))
    parts = parts.withColumn("event", F.lit(True))
    parts = parts.withColumns({c: F.lit(None).cast("string") for c in ("e1_role", "e2_role")})
    a, b = (F.get("arguments", F.lit(i)) for i in (0, 1))
    pairs = rows.where("kind = 'R' and size(arguments) >= 2").select(
        *keys, "type", a["target"].alias("e1"), b["target"].alias("e2"), F.lit(False).alias("event"), a["role"].alias("e1_role"), b["role"].alias("e2_role")
    )
    links = parts.unionByName(pairs)
    if by_trigger:
        links = moved(moved(links, "e1"), "e2").distinct()
    by = Window.partitionBy(*keys).orderBy("e1", "e2", "type", "event")
    links = links.withColumn("id", F.concat(F.lit("i"), (F.row_number().over(by) - 1).cast("string")))
    return free.unionByName(own), links.select(*keys, "id", "type", "e1", "e2", "event", "e1_role", "e2_role")


def standoff(entities: DataFrame, interactions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as ``parse_standoff`` has them, of entities and interactions as ``flat`` has them."""

    def numbered(df: DataFrame, letter: str, *order: str, out: str = "new") -> DataFrame:
        return df.withColumn(out, F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")))

    none = lambda kind: F.lit(None).cast(kind)
    spans = dict(entities.dtypes)["spans"]

    def rows(df: DataFrame, kind: str, ident: Column, type_: Column, place: Column | None = None, text: Column | None = None, trigger: Column | None = None, arguments: Column | None = None) -> DataFrame:
        cells = {"spans": (place, spans), "text": (text, "string"), "trigger": (trigger, "string"), "arguments": (arguments, ARGUMENTS)}
        return df.select(*keys, ident.alias("id"), F.lit(kind).alias("kind"), type_.alias("type"), *[(none(t) if c is None else c.cast(t)).alias(n) for n, (c, t) in cells.items()])

    # a trigger is shared by the events of one type at one place; given entities stand for themselves
    same = F.when(F.col("given"), F.col("id"))
    places = numbered(entities.select(*keys, "spans", "type", "text", same.alias("_own")).distinct(), "T", "spans", "type", "_own")
    at = entities.alias("e").join(places.alias("p"), _equal([*keys, "spans", "type", "text"]) & same.eqNullSafe(F.col("p._own"))).select("e.*", F.col("p.new").alias("_bound"))
    events = numbered(at.where("event"), "E", "id")
    ids = at.where("not event").select(*keys, "id", F.col("_bound").alias("new")).unionByName(events.select(*keys, "id", "new"))
    end = lambda df, c: df.join(ids.select(*keys, F.col("id").alias(c), F.col("new").alias(f"_{c}")), [*keys, c])
    parts = end(interactions.where("event"), "e2").groupBy(*keys, F.col("e1").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("type").alias("role"), F.col("_e2").alias("target")))).alias("arguments"))
    made = events.join(parts, [*keys, "id"], "left").withColumn("arguments", F.coalesce("arguments", F.array().cast(ARGUMENTS)))
    role = lambda c, name: F.struct(F.coalesce(F.col(f"{c}_role"), F.lit(name)).alias("role"), F.col(f"_{c}").alias("target"))
    pairs = numbered(end(end(interactions.where("not event"), "e1"), "e2"), "R", "id")
    kinds = F.filter(F.array(*[F.when(F.col(name), F.lit(kind)) for kind, name in MODIFIERS.items()]), lambda x: x.isNotNull())
    marks = numbered(events.select(*keys, "new", F.explode(kinds).alias("kind")), "M", "new", "kind", out="mark")
    one = F.array(F.struct(F.lit("").alias("role"), F.col("new").alias("target")))
    return (
        rows(places, "T", F.col("new"), F.col("type"), F.col("spans"), F.col("text"))
        .unionByName(rows(made, "E", F.col("new"), F.col("type"), trigger=F.col("_bound"), arguments=F.col("arguments")))
        .unionByName(rows(pairs, "R", F.col("new"), F.col("type"), arguments=F.array(role("e1", "Arg1"), role("e2", "Arg2"))))
        .unionByName(rows(marks, "M", F.col("mark"), F.col("kind"), arguments=one))
    )


def _equal(columns: list[str]) -> Column:
    """Equal values of the tables e and p, null among them."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"e.{c}").eqNullSafe(F.col(f"p.{c}"))
    return out
