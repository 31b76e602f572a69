"""Named processing steps, run as one chain of table transformations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import alignment
from tessera.operators import corpora, dictionary, features, graphs, sets, structure, tables, text
from tessera.sources import corpus, formats, parses

Step = Callable[..., DataFrame]

STEPS: dict[str, Step] = {
    "SPLIT_SENTENCES": text.sentences,
    "SPLIT_BY_RULE": text.split_sentences,
    "TOKENIZE": text.tokens,
    "FIND_NAMES": text.capitalised,
    "MAKE_PAIRS": text.pairs,
    "TOKEN_FEATURES": features.token_features,
    "MERGE_SENTENCES": text.merged,
    "MAP_ATTRIBUTES": tables.map_prefix,
    "DELETE_ELEMENTS": tables.delete,
    "REMOVE_TEXTS": lambda df, column="text": df.withColumn(column, F.lit(None).cast("string")),
    "SPLIT_MERGED": tables.split_merged,
    "MAKE_SETS": sets.split,
    "STRATIFY": sets.stratified,
    "SELECT_PARSE": corpus.select_parse,
    "REMOVE_ANALYSES": lambda df: df.withColumn("sentence", F.transform("sentence", lambda s: s.dropFields("analyses"))),
    "REMOVE_HEADS": lambda df, column="head": corpora.without_attributes(df, column),
    "REMOVE_DOCUMENT_TEXTS": lambda df: corpora.without_attributes(df, "text"),
    "MERGE_SETS": lambda df, others, name, allow_none=False: corpora.merged_sets({name: df, **others}, allow_none),
    "CATENATE": lambda df, others: corpora.catenated([df, *others]),
    "IMPORT_PARSE": parses.imported,
    "FIND_HEADS": alignment.heads,
    "ANALYZE_STRUCTURE": sets.schema_ranges,
    "VALIDATE": lambda df, **rules: structure.validate(df, **rules)[0],
    "REMOVE_UNCONNECTED": corpora.unconnected_removed,
    "MERGE_ENTITIES": lambda df, relations: structure.deduplicated(df, relations)[0],
    "MERGE_EVENTS": lambda df, group: df.join(graphs.unique_events(df, group).where("event = keeper").select(group, "event"), [group, "event"], "left_semi"),
    "MERGE_DEPENDENCIES": corpora.unique_dependencies,
    "EXTEND_TRIGGERS": corpora.extended,
    "GROW_EVENTS": structure.grown_events,
    "FIND_TERMS": dictionary.matches,
    "EXPORT": parses.conll_lines,
    "EXPORT_STFORMAT": formats.standoff_lines,
    "EXPORT_JSON": formats.json_lines,
    "DIVIDE_SETS": lambda df, path, **merged: (sets.divide(df, path, merged or None), df)[1],
    "SAVE": lambda df, path, kind="parquet": (df.write.format(kind).mode("overwrite").save(path), df)[1],
}

#: Names that stand for several steps.
ALIASES: dict[str, list[str]] = {"CLEAR_PARSE": ["REMOVE_ANALYSES", "REMOVE_HEADS"], "PREPROCESS": ["SPLIT_SENTENCES", "TOKENIZE"], "ENTITY_PAIRS": ["PREPROCESS", "FIND_NAMES", "MAKE_PAIRS"]}


def expanded(names: Sequence[str], start: str | None = None, stop: str | None = None, omit: Sequence[str] = ()) -> list[str]:
    """The steps of a chain, aliases written out, from ``start`` to ``stop``, both included, without ``omit``."""
    out: list[str] = []
    for name in names:
        out += expanded(ALIASES[name]) if name in ALIASES else [name]
    unknown = [n for n in [*out, *(x for x in (start, stop) if x)] if n not in STEPS]
    if unknown:
        raise KeyError(f"no step {unknown[0]}")
    first = out.index(start) if start else 0
    last = out.index(stop) if stop else len(out) - 1
    gone = set(expanded(omit)) if omit else set()
    return [n for n in out[first : last + 1] if n not in gone]


def run(df: DataFrame, names: Sequence[str], settings: Mapping[str, Mapping] | None = None, **limits) -> DataFrame:
    """A table through a chain; ``settings`` has the arguments of a step by its name. One plan, nothing written between."""
    for name in expanded(names, **limits):
        df = STEPS[name](df, **(settings or {}).get(name, {}))
    return df
