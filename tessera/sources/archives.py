"""Sets of files in folders and archives: texts with their annotation, articles, drug lists; what kind a path is."""

from __future__ import annotations

import io
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import formats
from tessera.sources.parses import DIALECTS

# Endings of archives, and of the files of an annotated text.
ARCHIVES = (".tar.gz", ".tgz", ".zip")
TEXT, GIVEN, TARGETS = "txt", "a1", ("a2", "rel")


def members(name: str, content: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of the files in an archive, or of the one file that it is."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((n, z.read(n).decode("utf-8")) for n in z.namelist() if not n.endswith("/"))
    elif name.endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            yield from ((m.name, t.extractfile(m).read().decode("utf-8")) for m in t if m.isfile())
    else:
        yield name.rsplit("/", 1)[-1], content.decode("utf-8")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(source, name, text) of all files below a path, archives unpacked where they are read; ``pattern`` is a regex of names.

    An archive is one row of the binary source, below 2 GB; many archives are many tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(source, n, t) for n, t in members(source, content)]
                yield pd.DataFrame(rows, columns=["source", "name", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInPandas(run, "source string, name string, text string")
    return rows.where(F.col("name").rlike(pattern)) if pattern else rows


def read_annotated(spark: SparkSession, path: str, targets: tuple[str, ...] = TARGETS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, text) and annotation (doc, part, and the columns of ``parse_standoff``) of a folder or archive.

    Files belong to the text of the same name; annotation without a text is left out.
    """
    files = read_files(spark, path, rf"\.({'|'.join((TEXT, GIVEN, *targets))})$")
    files = files.select(F.regexp_extract("name", r"([^/]+)\.[^./]+$", 1).alias("doc"), F.regexp_extract("name", r"\.([^./]+)$", 1).alias("part"), "text")
    docs = files.where(F.col("part") == TEXT).select("doc", "text")
    lines = files.where(F.col("part") != TEXT).join(docs.select("doc"), "doc", "left_semi").select("doc", "part", F.explode(F.split("text", "\n")).alias("value"))
    return docs, formats.parse_standoff(lines.where("value <> ''"), ["doc", "part"])


def packed(lines: DataFrame, group: str, name: str, text: str) -> DataFrame:
    """(group, content): a zip archive for each group of (name, text) files, which must fit in one row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, t in sorted(zip(frame[name], frame[text], strict=True)):
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), t)
        return pd.DataFrame({group: [frame[group].iloc[0]], "content": [out.getvalue()]})

    kind = dict(lines.dtypes)[group]
    return lines.groupBy(group).applyInPandas(run, f"`{group}` {kind}, content binary")


# Elements of an article that become sections, and those that do only with a text of their own.
SECTIONS = {"front", "article-meta", "title-group", "article-title", "abstract", "body", "sec", "p", "title"}
COLLAPSED = {"front", "article-meta", "title-group", "p"}


def article_sections(text: str) -> list[tuple[str, int, str, str, str | None]]:
    """(document, number, type, path, text) of the sections of an article file, outer before inner."""
    out: list[tuple[str, int, str, str, str | None]] = []

    def walk(element: ET.Element, path: str, doc: str) -> None:
        if element.tag != "article":
            if element.tag not in SECTIONS:
                return
            # an element that doesn't begin with text has none of its own; inline elements count with what follows them
            inline = [(c.text or "") + (c.tail or "") for c in element if c.tag not in SECTIONS]
            own = "".join([element.text, *inline]).rstrip("\n") if element.text else ""
            if own.strip() or element.tag not in COLLAPSED:
                out.append((doc, len(out), element.tag, path, own or None))
        seen: dict[str, int] = {}
        for child in element:
            seen[child.tag] = seen.get(child.tag, -1) + 1
            walk(child, f"{path}/{child.tag}-{seen[child.tag]}", doc)

    root = ET.fromstring(text)
    number = next((x.text for x in root.iter("article-id") if x.get("pub-id-type") == "pmid"), None)
    walk(root, "", f"PMC.d{number}")
    return out


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, section, type, path, text) of article files, a file a document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for t in frame["text"] for r in article_sections(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "type", "path", "text"])

    return read_files(spark, path, r"\.n?xml$").select("text").mapInPandas(run, "doc_id string, section int, type string, path string, text string")


def read_drugs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Names (name, id) and links (a, b) of a drug list: main names, synonyms and brands, and interactions by id."""
    kind = "`drugbank-id` string, name string, synonyms struct<synonym:array<string>>, brands struct<brand:array<string>>, `drug-interactions` struct<`drug-interaction`:array<struct<drug:string>>>"
    rows = spark.read.format("xml").option("rowTag", "drug").schema(kind).load(path).select(F.col("drugbank-id").alias("id"), "name", "synonyms", "brands", F.col("drug-interactions.drug-interaction").alias("links"))
    none = F.array().cast("array<string>")
    every = F.concat(F.array("name"), F.coalesce("synonyms.synonym", none), F.coalesce("brands.brand", none))
    names = rows.select(F.explode(every).alias("name"), "id").where("name is not null").distinct()
    links = rows.select(F.col("id").alias("a"), F.explode("links").alias("l")).select("a", F.col("l.drug").alias("b"))
    return names, links


def read_names(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(id, name) of a synonym list: the first column of a line, and every further one as a name; the first names itself."""
    p = F.split("value", sep)
    rows = spark.read.text(path).where("value not like '#%' and value <> ''")
    return rows.select(F.get(p, F.lit(0)).alias("id"), F.explode(p).alias("name")).where(F.trim("name") != "").distinct()


def kind_of(path: str) -> str:
    """What a path holds, by its ending: an archive, a corpus file, annotation, a parse, or a folder."""
    low = path.lower().rstrip("/")
    endings = {**dict.fromkeys(ARCHIVES, "annotated"), ".nxml": "articles", ".xml.gz": "xml", ".xml": "xml", ".csv": "csv", ".obo": "ontology", ".bin": "vectors", ".a1": "standoff", ".a2": "standoff", ".sd": "dependencies", ".ptb": "trees", ".tok": "tokens", ".epe": "epe", ".conll": "conll", **{f".{d}": "conll" for d in DIALECTS}}
    return next((kind for end, kind in endings.items() if low.endswith(end)), "annotated")
