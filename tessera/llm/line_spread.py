"""Line dedup by distinct-site spread.

A line that many sites have is boilerplate. Each line hash gets a HyperLogLog
sketch of the sites it stands on; sketches merge by aggregation, so a line of
all documents is combined before the shuffle. Lines whose estimate is surely
above the threshold are boilerplate, surely below are kept, and for those near
it (within ``SIGMAS`` standard errors) the distinct sites are counted exactly.
Boilerplate lines are then removed from every document.

What is cut from a text depends on the text alone, not on its site or doc_id, so
cuts are found and joined back by the text's hash (64 and 32 bits). Lines are
hashed in one pass over the texts and written; texts are read once more to cut.

Defined results: a null text stays null and has no lines, an empty one has one;
a very long text is cut whole; a null site is a site of its own; lines shorter
than ``min_chars`` after trimming are never removed; repeated rows, rows without
doc_id and different texts under one doc_id each lose their own lines; an empty
table gives an empty result; extra columns are kept, whatever their names, but
for n_lines and n_removed, which the operator's replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable

LG_K = 8
SIGMAS = 5
#: Bytes of boilerplate lines, and of texts' cuts, up to which they are broadcast.
BROADCAST_BYTES = 8 << 20
TEXT = ["text_a", "text_b"]


def _text_hashes(text: str) -> list:
    return [F.xxhash64(text).alias("text_a"), F.hash(text).alias("text_b")]


def site_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(text_a, text_b, site, pos, line): line is a hash of the trimmed line in lower case."""
    rows = docs.where("text is not null").select(
        *_text_hashes("text"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("site"), F.split("text", "\n").alias("parts")
    )
    rows = rows.select(*TEXT, "site", F.posexplode("parts").alias("pos", "raw"))
    trimmed = F.btrim("raw", F.lit(" \t\r\u000b\f"))
    return rows.where(F.length(trimmed) >= min_chars).select(*TEXT, "site", "pos", F.xxhash64(F.lower(trimmed)).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line) of the lines on ``min_sites`` distinct sites or more."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2) * min_sites + 1
    spread = durable(
        sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - error), "spread"
    )
    near = spread.where(F.col("sites") <= min_sites + error).select("line")
    exact = (
        lines.join(near, "line", "left_semi")
        .select("line", "site")
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    return durable(spread.where(F.col("sites") > min_sites + error).select("line").union(exact.select("line")), "boilerplate")


def _bounded(df: DataFrame, size) -> DataFrame:
    """``df``, broadcast if its bytes, counted by ``size`` a row, are few."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, min_chars: int = 20) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of ``text``, and n_lines and n_removed.

    Where few texts have such lines their cuts are broadcast and no text moves;
    beyond that, texts are joined by hash.
    """
    lines = durable(site_lines(docs, min_chars), "site-lines")
    bad = boilerplate(lines, min_sites)
    hits = lines.join(_bounded(bad, F.lit(8)), "line").groupBy(*TEXT).agg(F.collect_set("pos").alias("cut"))
    hits = durable(hits, "line-cuts")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *_text_hashes("text"))
    rows = rows.join(_bounded(hits, F.size("cut") * 4 + 40), TEXT, "left")
    whole = F.col("doc")["text"]
    parts = F.split(whole, "\n")
    left = F.filter(parts, lambda _, i: ~F.array_contains("cut", i))
    cut = F.col("cut").isNotNull() & whole.isNotNull()
    text = F.when(cut, F.array_join(left, "\n")).otherwise(whole)
    own = [(text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return rows.select(*own, n_lines.alias("n_lines"), F.when(cut, F.size("cut")).otherwise(F.lit(0)).cast("long").alias("n_removed"))
