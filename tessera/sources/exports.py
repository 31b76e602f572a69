"""Results for other programs: appended tables, task submissions, pictures of graphs, packed models."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files with titles; what is there is not read again."""
    df.write.mode("append").option("header", "true").csv(path)


def pair_lines(entities: DataFrame, interactions: DataFrame, key: str = "sent_id") -> DataFrame:
    """(value): ``sentence|e1|e2|1|type`` or ``…|0|null`` for every pair of a sentence's entities, whichever way they are linked.

    ``entities`` has (key, ent_id, place); interactions of type neg don't count.
    """
    a, b = (entities.select(key, F.col("ent_id").alias(f"e{k}"), F.col("place").alias(f"p{k}")) for k in (1, 2))
    pairs = a.join(b, key).where("p1 < p2")
    real = interactions.where("type <> 'neg'")
    both = real.select(key, "e1", "e2", "type").unionByName(real.select(key, F.col("e2").alias("e1"), F.col("e1").alias("e2"), "type"))
    found = both.groupBy(key, "e1", "e2").agg(F.min("type").alias("type"))
    rows = pairs.join(found, [key, "e1", "e2"], "left")
    return rows.select(F.concat_ws("|", key, "e1", "e2", F.when(F.col("type").isNull(), "0").otherwise("1"), F.coalesce("type", F.lit("null"))).alias("value"))


def pair_lines_in_row(sents: DataFrame, key: Column, names: str, linked: Callable[[Column, Column], Column]) -> DataFrame:
    """``pair_lines`` of sentences with their names (first, last) in order as an array: no join, and no sentence's pairs are held.

    ``linked`` gives the type that links two names, or null.
    """
    rows = sents.select(key.alias("k"), names, F.posexplode(names).alias("i", "a"))
    rest = F.slice(names, F.col("i") + 2, F.size(names))
    rows = rows.select("k", "a", F.explode(rest).alias("b")).withColumn("type", linked(F.col("a"), F.col("b")))
    flag = F.when(F.col("type").isNull(), "0").otherwise("1")
    return rows.select(F.concat_ws("|", "k", "a.first", "b.first", flag, F.coalesce("type", F.lit("null"))).alias("value"))


def entity_lines(entities: DataFrame, key: str = "sent_id") -> DataFrame:
    """(value): ``sentence|b-e;b-e|text|type`` with inclusive ends."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["b"].cast("string"), F.lit("-"), (s["e"] - 1).cast("string"))), ";")
    return entities.where("type <> 'neg'").select(F.concat_ws("|", F.col(key).cast("string"), spans, "text", "type").alias("value"))


def argument_lines(interactions: DataFrame, entities: DataFrame, documents: Column | str = "doc_id") -> DataFrame:
    """(value): tab-separated ``document, type, Arg1:id, Arg2:id`` with the entities' original ids."""
    ids = lambda k: entities.select(F.col("ent_id").alias(f"e{k}"), F.concat(F.lit(f"Arg{k}:"), "orig_id").alias(f"a{k}"))
    rows = interactions.join(ids(1), "e1").join(ids(2), "e2")
    return rows.select(F.concat_ws("\t", F.col(documents) if isinstance(documents, str) else documents, "type", "a1", "a2").alias("value"))


def numbered_lines(interactions: DataFrame, number: str = "number") -> DataFrame:
    """(value): tab-separated ``number, type(e1,e2)``, the type alone for one without direction."""
    way = F.when(F.col("directed"), F.concat("type", F.lit("("), "e1", F.lit(","), "e2", F.lit(")"))).otherwise(F.col("type"))
    return interactions.select(F.concat_ws("\t", F.col(number).cast("string"), way).alias("value"))


def _dot_label(c: Column) -> Column:
    return F.concat(F.lit(' [label="'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"];'))


def _dot_node(idx: Column, token: Column) -> Column:
    return F.concat(F.lit("  n"), idx.cast("string"), _dot_label(token))


def _dot_edge(gov: Column, dep: Column, kind: Column) -> Column:
    return F.concat(F.lit("  n"), gov.cast("string"), F.lit(" -> n"), dep.cast("string"), _dot_label(kind))


def graph_in_row(tokens: str, deps: Column) -> Column:
    """``graph_text`` of a sentence with its tokens and its dependencies (gov, dep, type), by dependent and governor, as arrays."""
    nodes = F.transform(tokens, lambda w, i: _dot_node(i, w))
    edges = F.transform(deps, lambda d: _dot_edge(d["gov"], d["dep"], d["type"]))
    return F.array_join(F.concat(F.array(F.lit("digraph {")), nodes, edges, F.array(F.lit("}"))), "\n")


def graph_text(tokens: DataFrame, deps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): a directed graph of each sentence in the DOT language."""
    node = _dot_node(F.col("idx"), F.col("token"))
    edge = _dot_edge(F.col("gov"), F.col("dep"), F.col("type"))
    nodes = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", node.alias("l")))).alias("n"))
    edges = deps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dep", "gov", edge.alias("l")))).alias("e"))
    lines = lambda c: F.coalesce(F.transform(c, lambda x: x["l"]), F.array().cast("array<string>"))
    every = F.concat(F.array(F.lit("digraph {")), lines("n"), lines("e"), F.array(F.lit("}")))
    return nodes.join(edges, keys, "left").select(*keys, F.array_join(every, "\n").alias("value"))


def arc_picture(words: Column, edges: Column, step: int = 60, rise: int = 18) -> Column:
    """An SVG text of a sentence: words in a row and an arc for each (gov, dep, type), as high as it is wide."""
    width = F.size(words) * step
    at = lambda i: (i * step + step // 2).cast("string")
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = F.transform(words, lambda w, i: F.concat(F.lit('<text x="'), at(i), F.lit('" y="0" text-anchor="middle">'), safe(w), F.lit("</text>")))
    arc = F.transform(
        edges,
        lambda e: F.concat(
            F.lit('<path fill="none" stroke="black" d="M '), at(e["gov"]), F.lit(" -15 Q "), ((e["gov"] + e["dep"]) * step / 2 + step // 2).cast("int").cast("string"), F.lit(" -"),
            (F.abs(e["gov"] - e["dep"]) * rise * 2 + 15).cast("string"), F.lit(" "), at(e["dep"]), F.lit(' -15"><title>'), safe(e["type"]), F.lit("</title></path>"),
        ),
    )
    box = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -'), (F.size(words) * rise).cast("string"), F.lit(" "), width.cast("string"), F.lit(" "), (F.size(words) * rise + 20).cast("string"), F.lit('">'))
    return F.concat(box, F.array_join(F.concat(text, arc), ""), F.lit("</svg>"))


def save_model(model: PipelineModel, path: str, strings: Mapping[str, str] | None = None, tables: Mapping[str, DataFrame] | None = None) -> None:
    """A model folder: the fitted pipeline, named strings and named tables (label lists, schemas) beside it."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/pipeline")
    members = sorted(tables or {})
    text = json.dumps({"strings": dict(strings or {}), "tables": members}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    for name in members:
        tables[name].write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_model(path: str) -> tuple[PipelineModel, dict[str, str], dict[str, DataFrame]]:
    """The inverse of ``save_model``."""
    spark = SparkSession.getActiveSession()
    about = json.loads("".join(r.value for r in spark.read.text(f"{path}/about").collect()))
    return PipelineModel.load(f"{path}/pipeline"), about["strings"], {n: spark.read.parquet(f"{path}/tables/{n}") for n in about["tables"]}
