"""Readers and writers of annotation formats, as text transformations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_standoff(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, kind, type, spans, text, trigger, arguments) of standoff annotation lines, see ``parse_standoff``."""
    return parse_standoff(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), ["file"])


def parse_standoff(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, kind, type, spans, text, trigger, arguments) of lines in ``value``.

    ``kind`` is the id's letter: T and W text-bound, E event, R relation, M
    modifier, N normalisation, * equivalence, X extra; ``arguments`` is an array
    of (role, target), for * with the members as targets. Comments are left out.
    """
    lines = rows.select(*keys, F.split("value", "\t").alias("p"))
    rest = F.get("p", F.lit(1))
    body = F.split(rest, " ", 2)
    kind = F.substring(F.get("p", F.lit(0)), 1, 1)
    bound, head = kind.isin("T", "W"), F.get(body, F.lit(0))
    spans = F.transform(F.split(F.get(body, F.lit(1)), ";"), lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).cast("int").alias("b"), F.split_part(x, F.lit(" "), F.lit(2)).cast("int").alias("e")))
    words = F.filter(F.split(F.get(body, F.lit(1)), " "), lambda x: x != "")
    part = lambda x, i: F.coalesce(F.get(F.split(x, ":", 2), F.lit(i)), F.lit(""))
    pairs = F.filter(F.transform(words, lambda x: F.struct(part(x, 0).alias("role"), part(x, 1).alias("target"))), lambda x: x["target"] != "")
    plain = F.transform(words, lambda x: F.struct(F.lit("").alias("role"), x.alias("target")))
    return lines.where(~kind.isin("#", "")).select(
        *keys,
        F.get("p", F.lit(0)).alias("id"),
        kind.alias("kind"),
        F.split_part(head, F.lit(":"), F.lit(1)).alias("type"),
        F.when(bound, spans).alias("spans"),
        F.when(bound, F.get("p", F.lit(2))).alias("text"),
        F.when(kind == "E", F.split_part(head, F.lit(":"), F.lit(2))).alias("trigger"),
        F.when(kind.isin("E", "R", "N", "X"), pairs).when(kind.isin("*", "M"), plain).alias("arguments"),
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(class, features map, extra map) of lines ``class f:v ... # k:v ...``."""
    lines = spark.read.text(path).where("value not like '#%' and value <> ''")
    pairs = lambda s: F.map_from_entries(F.transform(F.filter(F.split(s, " "), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)), F.split_part(x, F.lit(":"), F.lit(2)))))
    front, back = F.split_part("value", F.lit(" # "), F.lit(1)), F.split_part("value", F.lit(" # "), F.lit(2))
    return lines.select(F.split_part(front, F.lit(" "), F.lit(1)).cast("int").alias("class"), pairs(front).cast("map<int,double>").alias("features"), pairs(back).alias("extra"))


def example_lines(df: DataFrame) -> DataFrame:
    """The inverse of ``read_examples``: one text column, features in ascending order."""
    feats = F.array_join(F.transform(F.array_sort(F.map_entries("features")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), " ")
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), " ")
    return df.select(F.concat_ws(" ", F.col("class").cast("string"), feats, F.lit("#"), extra).alias("value"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, idx, token, lemma, pos, head, relation); sentences are split at blank lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\n\s*\n")).alias("sent", "block"))
    rows = whole.select("file", "sent", F.explode(F.split("block", "\n")).alias("line")).where(F.col("line").rlike(r"^[0-9]+\t"))
    p = F.split("line", "\t")
    names = {1: "token", 2: "lemma", 3: "pos", 6: "head", 7: "relation"}
    cols = [F.get(p, F.lit(i)).cast("int" if n == "head" else "string").alias(n) for i, n in names.items()]
    return rows.select("file", "sent", F.get(p, F.lit(0)).cast("int").alias("idx"), *cols)


def read_corpus_xml(spark: SparkSession, path: str, element: str = "document") -> DataFrame:
    """Elements of a hierarchical corpus file as nested rows, by the built-in XML reader."""
    return spark.read.format("xml").option("rowTag", element).option("attributePrefix", "").load(path)


def read_predictions(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(file, predicted, scores map) of lines ``class score score ...``, one score a class in order."""
    p = F.split("value", r"\s+")
    scores = F.map_from_arrays(F.array(*map(F.lit, classes)), F.slice(p, 2, len(classes)).cast("array<double>"))
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.get(F.array(*map(F.lit, classes)), p[0].cast("int") - 1).alias("predicted"), scores.alias("scores"))


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, type, gov, dep) of lines ``type(word-i, word-j)``, places from 0; blank lines end a sentence."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\n\s*\n")).alias("sent", "block"))
    rows = whole.select("file", "sent", F.explode(F.split("block", "\n")).alias("line"))
    pattern = r"^([^(]+)\(.+-(\d+)'*, .+-(\d+)'*\)\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return rows.where(F.col("line").rlike(pattern)).select("file", "sent", part(1).alias("type"), (part(2).cast("int") - 1).alias("gov"), (part(3).cast("int") - 1).alias("dep"))


def phrases_of(tree: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Tokens of a bracketed tree, and its phrases (type, first token, last token), inner before outer."""
    import re

    words, found, open_ = [], [], []
    for part in re.findall(r"\(\s*[^\s()]*|\)|[^\s()]+", tree):
        if part[0] == "(" and len(part) > 1:
            open_.append((part[1:].strip(), len(words), False))
        elif part == "(":
            open_.append(("", len(words), False))
        elif part == ")":
            if not open_:
                continue
            kind, first, leaf = open_.pop()
            if not leaf and kind and len(words) > first:
                found.append((kind, first, len(words) - 1))
        else:
            words.append(part)
            if open_:
                kind, first, _ = open_.pop()
                open_.append((kind, first, True))
    return words, found


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, tokens, phrases) of files with one bracketed tree a line."""
    def run(lines: pd.Series) -> pd.DataFrame:
        rows = [phrases_of(x) for x in lines]
        return pd.DataFrame({"tokens": [r[0] for r in rows], "phrases": [[{"type": k, "first": a, "last": b} for k, a, b in r[1]] for r in rows]})

    parse = F.pandas_udf(run, "tokens array<string>, phrases array<struct<type:string,first:int,last:int>>")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("sent", "line"))
    return whole.where(F.trim("line") != "").withColumn("_p", parse("line")).select("file", "sent", "_p.tokens", "_p.phrases")


def read_vectors(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(rank, word, vector) of a binary word-vector file: a header ``count size``, then word, space, float32s.

    A file is one row of the binary source, so it must be smaller than 2 GB;
    larger ones are split first. ``most`` keeps the first words.
    """
    def run(batches):
        import numpy as np

        for frame in batches:
            for blob in frame["content"]:
                head, at = blob.split(b"\n", 1)[0], blob.index(b"\n") + 1
                n, size = map(int, head.split())
                rows = []
                for rank in range(n if most is None else min(n, most)):
                    stop = blob.index(b" ", at)
                    word = blob[at:stop].strip().decode("utf-8", "replace")
                    at = stop + 1 + 4 * size
                    rows.append((rank, word, np.frombuffer(blob, "<f4", size, stop + 1).tolist()))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["rank", "word", "vector"])
                        rows = []
                yield pd.DataFrame(rows, columns=["rank", "word", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "rank long, word string, vector array<float>")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, synonyms, parents) of the term stanzas of an ontology text file."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("b")).where(F.col("b").rlike(r"^\s*\[Term\]"))
    every = lambda pattern: F.regexp_extract_all("b", F.lit(pattern))
    return whole.select(
        F.regexp_extract("b", r"(?m)^id: (\S+)", 1).alias("id"),
        F.regexp_extract("b", r"(?m)^name: (.+)$", 1).alias("name"),
        every(r'(?m)^synonym: "([^"]*)"').alias("synonyms"),
        every(r"(?m)^is_a: (\S+)").alias("parents"),
    )


def standoff_lines(df: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, value): the inverse of ``parse_standoff``."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["b"].cast("string"), F.lit(" "), s["e"].cast("string"))), ";")
    pairs = F.array_join(F.transform("arguments", lambda a: F.when(a["role"] == "", a["target"]).otherwise(F.concat(a["role"], F.lit(":"), a["target"]))), " ")
    head = F.when(F.col("kind") == "E", F.concat_ws(":", "type", F.nullif("trigger", F.lit("")))).otherwise(F.col("type"))
    bound = F.concat_ws("\t", "id", F.concat_ws(" ", "type", spans), "text")
    value = F.when(F.col("kind").isin("T", "W"), bound).otherwise(F.concat_ws("\t", "id", F.concat_ws(" ", head, F.nullif(pairs, F.lit("")))))
    return df.select(*keys, value.alias("value"))


def conllu_lines(df: DataFrame) -> DataFrame:
    """(file, sent, value): the inverse of ``read_conllu``, a block a sentence."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    line = F.concat_ws("\t", F.col("idx").cast("string"), dash("token"), dash("lemma"), dash("pos"), F.lit("_"), F.lit("_"), dash("head"), dash("relation"), F.lit("_"), F.lit("_"))
    rows = df.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("r"))
    return rows.select("file", "sent", F.concat(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def latex_table(df: DataFrame, caption: str = "") -> str:
    """A small result as a LaTeX table; rows come to the driver, as only a table for print should."""
    clean = lambda v: "" if v is None else "".join(f"\\{c}" if c in "&%$#_{}" else c for c in str(v))
    rows = [" & ".join(map(clean, r)) + r" \\" for r in df.collect()]
    head = " & ".join(map(clean, df.columns)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", head, r"\hline", *rows, r"\end{tabular}", *([rf"\caption{{{clean(caption)}}}"] if caption else []), r"\end{table}"])


def submission_lines(relations: DataFrame, columns: list[str]) -> DataFrame:
    """(value): tab-separated lines of the predicted relations, neg left out."""
    return relations.where("type <> 'neg'").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def adjusted_predictions(spark: SparkSession, path: str, classes: list[str], boost: float = 1.0, threshold: float | None = None) -> DataFrame:
    """``read_predictions`` with the class chosen anew from the scores as they are read: the first class boosted, or cut at a threshold."""
    from tessera.operators.evaluation import best_class

    rows = read_predictions(spark, path, classes)
    return rows.withColumn("predicted", best_class("scores", classes[0], boost, threshold))


# The columns of a result line.
RESULT = r"^\s*([A-Za-z0-9_()=\[\]-]+)\s+(\d+)\s*\(\s*(\d+)\)\s+(\d+)\s*\(\s*(\d+)\)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s*$"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(submission, set, category, gold, matched, answer, recall, precision, fscore) of the result tables in experiment logs.

    A log is named ``log.txt`` and lies in its submission's folder; lines after one
    that names a set belong to that set, until the next. Logs are read whole.
    """
    logs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "log.txt").text(path, wholetext=True)
    logs = logs.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/log\.txt$", 1).alias("submission"), F.explode(F.split("value", r"(?=(?:devel|test) set)")).alias("part"))
    logs = logs.select("submission", F.regexp_extract("part", r"^(devel|test) set", 1).alias("set"), F.explode(F.split("part", "\n")).alias("line"))
    p = lambda i, kind: F.regexp_extract("line", RESULT, i).cast(kind)
    names = [("gold", 2, "int"), ("matched", 3, "int"), ("answer", 4, "int"), ("recall", 6, "double"), ("precision", 7, "double"), ("fscore", 8, "double")]
    return logs.where((F.col("set") != "") & F.col("line").rlike(RESULT)).select("submission", "set", p(1, "string").alias("category"), *[p(i, k).alias(n) for n, i, k in names])


def combined_results(results: DataFrame, category: str = "ALL-TOTAL") -> DataFrame:
    """(submission, precision:devel, ...): one row a submission with the figures of a category in each set."""
    rows = results.where(F.col("category") == category).groupBy("submission").pivot("set", ["devel", "test"])
    out = rows.agg(*[F.first(c).alias(c) for c in ("precision", "recall", "fscore")])
    return out.select("submission", *[F.col(f"{s}_{c}").alias(f"{c}:{s}") for s in ("devel", "test") for c in ("precision", "recall", "fscore")])


def load(spark: SparkSession, path: str, kind: str | None = None, **options):
    """One entry for all readers, by the name of the format, or by the path's ending where none is given."""
    from tessera.sources import archives, corpus, parses

    kind = kind or archives.kind_of(path)
    readers = {
        "standoff": read_standoff, "examples": read_examples, "conllu": read_conllu, "elements": read_corpus_xml, "xml": corpus.load, "predictions": read_predictions, "dependencies": read_dependencies,
        "trees": read_trees, "vectors": read_vectors, "ontology": read_ontology, "annotated": archives.read_annotated, "articles": archives.read_articles, "conll": parses.read_conll, "epe": parses.read_epe,
        "tokens": parses.read_token_lines, "drugs": archives.read_drugs, "names": archives.read_names,
    }
    if kind in readers:
        return readers[kind](spark, path, **options)
    return spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options).load(path)
