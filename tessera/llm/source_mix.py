"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is dealt in blocks of ``block`` words. A house of
``round(sum of targets / block)`` seats is apportioned to the sources: seats go
one by one to the highest quotient ``target / (2 * seats held + 1)``, ties by
source. The method never takes a seat back when the house grows, so the quotas
of output shard h are the differences between the apportionments of two house
sizes: integer quotas for each shard.

Inside a source documents stand in a seeded order on a line of words, which is
cut into blocks. The source's seats are filled from a seeded starting block on,
round the line, so that every block is taken once before any is taken twice.
The seats of a shard's quota are consecutive, so a shard takes one run of the
line, or two round its end, in each epoch; a document gives a piece to each
run that it lies in.

Scale: sources may be as many as hosts. They are ranked by ``ranked``, in ranges,
and no window holds them all; a document's place on its source's line comes from
a window over one slice of the source plus the slice's start, with as many
slices as keep one below ``SLICE_ROWS`` rows. Only identifiers and sizes are
shuffled. What is held per source (one row each) is joined to the slice table
first and reaches the rows by (source, slice). The seats are not dealt in a
loop: a divisor that is surely too large gives a lower bound for each source,
one that is surely too small an upper bound, and only the few seats between are
ranked by quotient.

Defined results: a null text or source counts as no words, and as the last
source; a very long text may be taken in part; sources without words get target
0; empty tables give empty results; rows with the same doc_id, or without one,
are separate documents of the line, in the order of size and of a hash of the
text; extra columns are ignored by ``mix`` and kept by ``mixed_documents``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, durable, keyed, ranked, word_count

#: Rows of a slice of a source, at most about, and the least number of hexadecimal digits of the order key that make a slice.
SLICE_ROWS, DIGITS = 1 << 19, 2
WEIGHTS = (5, 2, 1)


def _source_key(col: Column) -> Column:
    """Never null, and sorts like the source with null last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col))


def targets(sizes: DataFrame, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(src, source_size, weight, target) from (src, source_size).

    The sources share ``share[0] / share[1]`` of all words by weight; no target
    exceeds ``cap`` times its source and the excess goes to the others. The
    final level is found directly: with sources in order of size / weight, the
    capped ones are a prefix, and the level is what is left over the weight left.
    """
    rows = ranked(sizes.select("src", "source_size"), [F.col("src")], "_rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("long")).drop("_rank")
    rows = ranked(rows, [F.col("source_size") / F.col("weight"), F.col("src")], "_rank", {"before_size": "source_size", "before_weight": "weight"})
    rows = durable(rows, "sources")
    all_size, all_weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    # words left, times share[1], if exactly the sources before this one are capped
    left = F.lit((all_size or 0) * share[0]) - F.col("before_size") * (cap * share[1])
    room = F.lit(all_weight or 0) - F.col("before_weight")
    # this source is not capped at that level: level * weight <= cap * size
    fits = left * F.col("weight") <= F.col("source_size") * room * (cap * share[1])
    first = rows.where(fits).agg(F.min_by(left / (room * share[1]), "_rank").alias("level")).first()
    capped = (F.col("source_size") * cap).cast("double")
    level = F.lit(first.level).cast("double") * F.col("weight")
    return rows.select("src", "source_size", "weight", F.least(capped, F.coalesce(level, capped)).alias("target"))


def apportion(goals: DataFrame, block: int, shards: int) -> DataFrame:
    """(src, quotas array) from (src, target): seats after each of ``shards`` + 1 house sizes.

    House h has ``round(total * h / shards / block)`` seats; ``quotas[h + 1] -
    quotas[h]`` is the source's quota in shard h.
    """
    total, n = goals.agg(F.sum(F.col("target").cast("decimal(38,9)")).cast("double"), F.count("*")).first()
    rows = goals.select("src", "target", F.explode(F.sequence(F.lit(0), F.lit(shards))).alias("house"))
    rows = rows.withColumn("seats", F.floor(F.lit(total or 0.0) * F.col("house") / shards / block + 0.5))
    exact = F.col("target") / total if total else F.lit(0.0)
    # with (seats - n/2) / total for a divisor, rounding up everywhere still stays within the house
    less = F.col("seats") - n / 2 - 1
    low = F.when(less <= 0, F.lit(0)).otherwise(F.floor(exact * less + 0.5)).cast("long")
    high = F.floor(exact * (F.col("seats") + n / 2 + 1) + 0.5).cast("long")
    rows = durable(rows.withColumn("low", low).withColumn("high", F.greatest(high, "low")), "houses")
    open_seats = rows.where("high > low").withColumn("j", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
    open_seats = open_seats.select("src", "house", (F.col("target") / (F.col("j") * 2 + 1)).alias("quotient"))
    # a row for each house: seats open, and those given already
    houses = {r.house: r for r in rows.groupBy("house").agg(F.max("seats").alias("seats"), F.sum("low").alias("low"), F.sum(F.col("high") - F.col("low")).alias("open")).collect()}
    begin, last = 0, F.lit(-1).cast("long")
    for house, r in sorted(houses.items()):
        last = F.when(F.col("house") == house, F.lit(begin + r.seats - r.low).cast("long")).otherwise(last)
        begin += r.open
    places = ranked(open_seats, [F.col("house"), F.desc("quotient"), F.col("src")], "r")
    won = places.where(F.col("r") < last).groupBy("src", "house").agg(F.count("*").alias("won"))
    seats = F.struct("house", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))
    out = rows.join(won, ["src", "house"], "left").groupBy("src").agg(F.array_sort(F.collect_list(seats)).alias("q"))
    return out.select("src", F.col("q.seats").alias("quotas"))


def _runs(block: int, shards: int) -> Column:
    """What each shard takes of a source's line: an array of (lo, hi, epoch, shard) in words, from quotas, blocks and start.

    Seat r of an epoch is block (start + r) modulo the number of blocks.
    """
    found = []
    for shard in range(shards):
        for epoch in (0, 1):
            first = F.greatest(F.get("quotas", F.lit(shard)), F.col("blocks") * epoch) - F.col("blocks") * epoch + F.col("start")
            stop = F.least(F.get("quotas", F.lit(shard + 1)), F.col("blocks") * (epoch + 1)) - F.col("blocks") * epoch + F.col("start")
            ahead = (first, F.least(stop, F.col("blocks")))
            round_ = (F.greatest(first, F.col("blocks")) - F.col("blocks"), stop - F.col("blocks"))
            for lo, hi in (ahead, round_):
                found.append(F.struct((lo * block).alias("lo"), (hi * block).alias("hi"), F.lit(epoch).alias("epoch"), F.lit(shard).alias("shard")))
    return F.filter(F.array(*found), lambda r: r["hi"] > r["lo"])


def mix(docs: DataFrame, block: int = 32, shards: int = 8, seed: str = "mix", also: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, quotas, taken, pieces, and the columns ``also``.

    ``pieces`` lists what the mix takes of the document as (first_word, words,
    epoch, shard), one for each run of a shard's seats that it lies in.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.xxhash64("text").cast("string")))
    rows = docs.select(
        "doc_id",
        "source",
        _source_key(F.col("source")).alias("src"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("key"),
        F.xxhash64("text").alias("text_hash"),
        *also,
    )
    # word counts are needed for the statistics and for the rows: counted once, kept without the text
    rows = durable(rows, "mix-sizes")
    digits = DIGITS
    while rows.count() > SLICE_ROWS * 16**digits and digits < 7:
        digits += 1
    rows = rows.withColumn("sub", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    slices = rows.groupBy("src", "sub").agg(F.sum("size").alias("in_sub"))
    goals = targets(slices.groupBy("src").agg(F.sum("in_sub").alias("source_size")))
    plan = goals.join(apportion(goals, block, shards), "src")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/start:"), "src")), 1, 8), 16, 10).cast("long")
    plan = (
        plan.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("start", F.when(F.col("blocks") > 0, start % F.col("blocks")).otherwise(F.lit(0)))
        .withColumn("runs", _runs(block, shards))
    )
    line = Window.partitionBy("src").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("sub_start", F.coalesce(F.sum("in_sub").over(line), F.lit(0))).drop("in_sub").join(plan, "src")
    inside = Window.partitionBy("src", "sub").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(slices, ["src", "sub"])
        .withColumn("at", F.col("sub_start") + F.col("before"))
        .withColumn("end", F.col("at") + F.col("size"))
    )
    piece = lambda r: F.struct(
        (F.greatest(r["lo"], F.col("at")) - F.col("at")).alias("first_word"),
        (F.least(r["hi"], F.col("end")) - F.greatest(r["lo"], F.col("at"))).alias("words"),
        r["epoch"].alias("epoch"),
        r["shard"].alias("shard"),
    )
    placed = placed.withColumn("pieces", F.transform(F.filter("runs", lambda r: (r["lo"] < F.col("end")) & (r["hi"] > F.col("at"))), piece))
    placed = placed.withColumn("pieces", F.filter("pieces", lambda p: p["words"] > 0))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    return placed.select("doc_id", "source", "size", "source_size", "target", "quotas", taken.alias("taken"), "pieces", *also)


def mixed_documents(docs: DataFrame, shard: str | None = None, **options) -> DataFrame:
    """The mix itself: rows with the columns of ``docs``, one for each piece, and the piece's output shard as column ``shard`` if named.

    A piece that is its whole document keeps the text as it stands; a cut piece
    has its words joined by single spaces. Pieces belong to rows, so rows without
    doc_id and repeated ones have just their own.
    """
    rows = keyed(docs)
    wanted = rows.select("_row", *[F.col("doc")[c].alias(c) for c in ("doc_id", "source", "text")])
    pieces = mix(wanted, also=("_row",), **options).select("_row", "size", F.explode("pieces").alias("p"))
    both = rows.join(pieces, "_row")
    whole = F.col("doc")["text"]
    words = F.regexp_extract_all(whole, F.lit(f"({WORD})"))
    part = F.array_join(F.slice(words, (F.col("p.first_word") + 1).cast("int"), F.col("p.words").cast("int")), " ")
    both = both.withColumn("piece", F.when(F.col("p.words") == F.col("size"), whole).otherwise(part))
    new = {"text": F.col("piece"), "n_chars": F.length("piece")}
    kinds = dict(docs.dtypes)
    out = [(new[c].cast(kinds[c]) if c in new else F.col("doc")[c]).alias(c) for c in docs.columns]
    return both.select(*out, *([F.col("p.shard").alias(shard)] if shard else []))
