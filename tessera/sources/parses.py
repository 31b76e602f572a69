"""Parse files: column formats, JSON graphs, token and tag lines; readers and the lines of their writers.

A sentence is a block between blank lines, so a file of a column format is read
whole; JSON graphs and token lines have a sentence a line and are split anywhere.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.strings import export_text, unescaped

# The columns of the dialects.
DIALECTS = {
    "conllx": ["ID", "FORM", "LEMMA", "CPOSTAG", "POSTAG", "FEATS", "HEAD", "DEPREL", "PHEAD", "PDEPREL"],
    "conllu": ["ID", "FORM", "LEMMA", "UPOSTAG", "XPOSTAG", "FEATS", "HEAD", "DEPREL", "DEPS", "MISC"],
    "corenlp": ["ID", "FORM", "LEMMA", "POS", "NER", "HEAD", "DEPREL"],
    "tt": ["BEGIN", "END", "FORM", "LEMMA", "POS"],
}
TAGS = ["CPOSTAG", "POSTAG", "UPOSTAG", "XPOSTAG", "POS"]


def dialect_of(path: str) -> str:
    """The dialect that a file's extension stands for."""
    end = path.rsplit(".", 1)[-1]
    end = "conllx" if end == "conll" else end
    if end not in DIALECTS:
        raise ValueError(f"no column format for .{end}")
    return end


def _split_lines(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, Column]:
    """(file, sent, idx, p): a row a word with its columns as an array, and these with a check of their number; comment lines are left out."""
    text = F.regexp_replace("value", r"\s+$", "")
    blocks = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("sent", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    rows = blocks.select("file", "sent", F.posexplode(F.transform(lines, lambda x: F.split(x, "\t"))).alias("idx", "p"))
    return rows, F.when(F.size("p") == len(names), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), F.array_join("p", "\t"))))


def _columns(names: list[str], parts: Column) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), parts), lambda _, v: v != "_").alias("columns")


def read_columns(spark: SparkSession, path: str, dialect: str | None = None) -> DataFrame:
    """(file, sent, idx, columns): a row a word, its columns as a map without ``_``; comment lines are left out."""
    names = DIALECTS[dialect or dialect_of(path)]
    rows, parts = _split_lines(spark, path, names)
    return rows.select("file", "sent", "idx", _columns(names, parts))


def read_conll(spark: SparkSession, path: str, dialect: str | None = None, unescape: bool = False) -> DataFrame:
    """(file, sent, idx, id, token, pos, head, relation, deps, columns): the tag is the first that a word has.

    Cells are taken by their place; the map is made only where it is asked for.
    """
    names = DIALECTS[dialect or dialect_of(path)]
    rows, parts = _split_lines(spark, path, names)
    c = {n: F.nullif(F.get(parts, F.lit(i)), F.lit("_")) for i, n in enumerate(names)}
    none = F.lit(None).cast("string")
    form, tags = c["FORM"], [c[t] for t in TAGS if t in c]
    return rows.select(
        "file", "sent", "idx", c.get("ID", none).alias("id"), (unescaped(form) if unescape else form).alias("token"), F.coalesce(*tags).alias("pos"),
        c.get("HEAD", none).alias("head"), c.get("DEPREL", none).alias("relation"), c.get("DEPS", none).alias("deps"), _columns(names, parts),
    )


def conll_dependencies(words: DataFrame) -> DataFrame:
    """(file, sent, type, gov, dep, secondary) by word ids: the heads, and the further ones of ``deps``; a root is no dependency."""
    first = words.where("head is not null and head <> '0'").select("file", "sent", F.col("relation").alias("type"), F.col("head").alias("gov"), F.col("id").alias("dep"), F.lit(False).alias("secondary"))
    more = words.where("deps is not null").select("file", "sent", F.col("id").alias("dep"), F.explode(F.split("deps", r"\|")).alias("d"))
    p = F.split("d", ":", 2)
    return first.unionByName(more.select("file", "sent", F.get(p, F.lit(1)).alias("type"), F.get(p, F.lit(0)).alias("gov"), "dep", F.lit(True).alias("secondary")))


# The members of a node.
EPE = {"id": "int", "form": "string", "start": "int", "end": "int", "properties": "map<string,string>", "edges": "array<struct<label:string,target:int>>"}


def read_epe(spark: SparkSession, path: str, tags: tuple[str, ...] = ("pos", "xpos", "upos")) -> tuple[DataFrame, DataFrame]:
    """Tokens (file, line, id, idx, token, pos, begin, end) and dependencies (file, line, type, gov, dep) of a JSON graph a line.

    Nodes without a span of the text are left out, as are edges to a node that isn't there.
    The tag is the first of ``tags`` that a node has; without any, no properties are read.
    """
    lines = spark.read.text(path)

    def nodes(*members: str) -> DataFrame:
        schema = f"nodes array<struct<{','.join(f'{m}:{EPE[m]}' for m in ('id', 'start', 'end', *members))}>>"
        rows = lines.select(F.col("_metadata.file_path").alias("file"), F.md5("value").alias("line"), F.from_json("value", schema).alias("g"))
        bound = F.filter("g.nodes", lambda n: F.coalesce((n["start"] >= 0) & (n["end"] > n["start"]), F.lit(False)))
        return rows.select("file", "line", bound.alias("nodes"))

    toks = nodes("form", *(("properties",) if tags else ())).select("file", "line", F.posexplode("nodes").alias("idx", "n"))
    pos = F.coalesce(*[F.col("n.properties")[t] for t in tags]) if tags else F.lit(None).cast("string")
    tokens = toks.select("file", "line", F.col("n.id").alias("id"), "idx", F.col("n.form").alias("token"), pos.alias("pos"), F.col("n.start").alias("begin"), F.col("n.end").alias("end"))
    known = F.transform("nodes", lambda n: n["id"])
    edges = nodes("edges").select("file", "line", known.alias("known"), F.explode("nodes").alias("n")).select("file", "line", "known", F.col("n.id").alias("gov"), F.explode("n.edges").alias("e"))
    edges = edges.where(F.array_contains("known", F.col("e.target")) & (F.col("e.label") != "edge_list_sum"))
    return tokens, edges.select("file", "line", F.col("e.label").alias("type"), "gov", F.col("e.target").alias("dep"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, idx, token) of white-space separated tokens, a sentence a line."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.md5("value").alias("line"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("idx", "token"))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, idx, token, pos, begin, end) of lines ``begin end form lemma tag``."""
    c = F.col("columns")
    return read_columns(spark, path, "tt").select("file", "sent", "idx", c["FORM"].alias("token"), c["POS"].alias("pos"), c["BEGIN"].cast("int").alias("begin"), c["END"].cast("int").alias("end"))


def document_key(file: Column) -> Column:
    """A file's name without folder and extension: the document it belongs to."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[A-Za-z0-9]+)+$", 1)


def imported(parsed: DataFrame, documents: DataFrame, key: str = "orig_id") -> DataFrame:
    """Rows of any reader with the ``doc_id`` of the document that their file is named after; rows of other files are left out."""
    return parsed.withColumn("_key", document_key(F.col("file"))).join(documents.select(F.col(key).alias("_key"), "doc_id"), "_key").drop("_key")


def _sentence_lines(rows: DataFrame, keys: list[str], order: str, line: Column, end: str) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("r"))
    return grouped.select(*keys, F.concat(F.array_join(F.transform("r", lambda x: x["line"]), end), F.lit("\n" if end == "\n" else "")).alias("value"))


def token_lines(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the tokens of a sentence, separated by spaces."""
    return _sentence_lines(tokens, keys, "idx", F.col("token"), " ")


def dependency_lines(tokens: DataFrame, deps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): lines ``type(word-i, word-j)`` with places from 1, as ``read_dependencies`` takes them."""
    word = lambda k: tokens.select(*keys, F.col("idx").alias(k), F.concat(export_text(F.col("token")), F.lit("-"), (F.col("idx") + 1).cast("string")).alias(f"_{k}"))
    rows = deps.join(word("gov"), [*keys, "gov"]).join(word("dep"), [*keys, "dep"])
    return _sentence_lines(rows.withColumn("place", F.struct("dep", "gov", "type")), keys, "place", F.concat("type", F.lit("("), "_gov", F.lit(", "), "_dep", F.lit(")")), "\n")


def dependencies_in_row(tokens: str, deps: Column) -> Column:
    """``dependency_lines`` of a sentence with its tokens and its dependencies (gov, dep, type), in order, as arrays."""
    word = lambda i: F.concat(export_text(F.get(tokens, i)), F.lit("-"), (i + 1).cast("string"))
    lines = F.transform(deps, lambda d: F.concat(d["type"], F.lit("("), word(d["gov"]), F.lit(", "), word(d["dep"]), F.lit(")")))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def conll_lines(tokens: DataFrame, deps: DataFrame, keys: list[str], dialect: str = "conllu") -> DataFrame:
    """(keys, value): a sentence's block in a dialect; the least governor is the head, others go to DEPS where the dialect has it."""
    heads = deps.groupBy(*keys, F.col("dep").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("gov", "type"))).alias("h"))
    rows = tokens.join(heads, [*keys, "idx"], "left")
    line = _conll_line(F.col("idx"), F.col("token"), F.col("h"), F.col("pos") if "pos" in tokens.columns else None, dialect)
    return _sentence_lines(rows, keys, "idx", line, "\n")


def _conll_line(idx: Column, token: Column, heads: Column, pos: Column | None, dialect: str) -> Column:
    more = F.array_join(F.transform(F.filter(heads, lambda _, i: i > 0), lambda x: F.concat((x["gov"] + 1).cast("string"), F.lit(":"), x["type"])), "|")
    first = F.get(heads, F.lit(0))
    have = {"ID": (idx + 1).cast("string"), "FORM": token, "HEAD": (first["gov"] + 1).cast("string"), "DEPREL": first["type"], "DEPS": F.nullif(more, F.lit(""))}
    if pos is not None:
        have[next(c for c in DIALECTS[dialect] if c in TAGS)] = pos
    filled = [(bool(some), list(names)) for some, names in groupby(DIALECTS[dialect], have.__contains__)]
    cells = [[F.coalesce(have[n].cast("string"), F.lit("_")) for n in names] if some else [F.lit("\t".join("_" * len(names)))] for some, names in filled]
    return F.concat_ws("\t", *[x for some in cells for x in some])


def conll_in_row(words: Column, dialect: str = "conllu") -> Column:
    """``conll_lines`` of a sentence whose ``words`` are an array of (idx, token, pos, heads), heads an array of (gov, type), the least first."""
    lines = F.transform(words, lambda w: _conll_line(w["idx"], w["token"], w["heads"], w["pos"], dialect))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def epe_lines(tokens: DataFrame, deps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): a JSON graph a sentence; ``tokens`` has token, pos, begin and end."""
    edges = deps.groupBy(*keys, F.col("gov").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("type").alias("label"), F.col("dep").alias("target")))).alias("edges"))
    node = _epe_node(*map(F.col, ("idx", "token", "begin", "end", "pos", "edges")))
    rows = tokens.join(edges, [*keys, "idx"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", node.alias("n"))), lambda a, b: a["idx"] - b["idx"]).alias("r"))
    return rows.select(*keys, F.to_json(F.struct(F.transform("r", lambda x: x["n"]).alias("nodes"))).alias("value"))


def _epe_node(idx: Column, token: Column, begin: Column, end: Column, pos: Column, edges: Column) -> Column:
    return F.struct(idx.alias("id"), token.alias("form"), begin.alias("start"), end.alias("end"), F.create_map(F.lit("pos"), pos).alias("properties"), edges.alias("edges"))


def epe_in_row(words: Column) -> Column:
    """``epe_lines`` of a sentence whose ``words`` are an array of (idx, token, begin, end, pos, edges), edges an array of (label, target)."""
    nodes = F.transform(words, lambda w: _epe_node(*[w[c] for c in ("idx", "token", "begin", "end", "pos", "edges")]))
    return F.to_json(F.struct(nodes.alias("nodes")))
