"""Evaluation of predicted against true classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tables


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F-score, 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("fscore")]


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, fscore) from a confusion matrix."""
    right = F.col("truth") == F.col("predicted")
    rows = matrix.select(
        F.explode(
            F.when(right, F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))))
            .otherwise(
                F.array(
                    F.struct(F.col("predicted").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")),
                    F.struct(F.col("truth").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.col("n").alias("fn")),
                )
            )
        ).alias("x")
    ).select("x.*")
    rows = rows.groupBy("class").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return rows.select("class", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def micro(matrix: DataFrame, negative: object) -> DataFrame:
    """Counts over all classes but the negative one.

    A wrong positive prediction counts as false positive, and as false negative
    too if the truth is another positive class.
    """
    n, t, p = F.col("n"), F.col("truth"), F.col("predicted")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    s = matrix.agg(
        total((t == p) & (t != negative)).alias("tp"),
        total((t != p) & (p != negative)).alias("fp"),
        total((t != p) & (t != negative)).alias("fn"),
        total((t == p) & (t == negative)).alias("tn"),
    )
    return s.select("tp", "fp", "fn", "tn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(threshold, tp, fp, fn, fscore) of the cut with the best F-score, the highest cut on ties.

    Running counts are over the distinct scores, aggregated first.
    """
    s = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    total = s.agg(F.sum("p")).first()[0] or 0
    # sums over the higher scores, by ranges of the scores: no task holds them all
    s = tables.running(s.withColumn("_by", -F.col("threshold")), "_by", "p", "_p")
    s = tables.running(s, "_by", "n", "_n")
    s = s.withColumn("tp", F.col("_p") + F.col("p")).withColumn("fp", F.col("_n") + F.col("n") - F.col("tp"))
    s = s.withColumn("fn", F.lit(total) - F.col("tp"))
    s = s.select("threshold", "tp", "fp", "fn", scores(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    return s.orderBy(F.desc("fscore"), F.desc("threshold")).limit(1)


def unmatched(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome): tp, fp or fn of distinct predicted and gold keys, by one full outer join."""
    a, b = (df.select(*keys).distinct().withColumn(c, F.lit(True)) for df, c in ((predicted, "_p"), (gold, "_g")))
    outcome = F.when(F.col("_p") & F.col("_g"), "tp").when(F.col("_p"), "fp").otherwise("fn")
    return a.join(b, keys, "full_outer").select(*keys, outcome.alias("outcome"))


def ensemble(a: DataFrame, b: DataFrame, keys: list[str], score: str, mode: str = "or") -> DataFrame:
    """Keys of either (``or``) or both (``and``) sets, with the higher of the scores scaled to 0..1 in each set."""
    def scaled(df: DataFrame, name: str) -> DataFrame:
        s = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
        return df.crossJoin(F.broadcast(s)).select(*keys, ratio(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo")).alias(name))

    both = scaled(a, "_a").join(scaled(b, "_b"), keys, "full_outer" if mode == "or" else "inner")
    winner = F.when(F.coalesce("_a", F.lit(-1.0)) >= F.coalesce("_b", F.lit(-1.0)), "a").otherwise("b")
    return both.select(*keys, winner.alias("winner"), F.greatest("_a", "_b").alias("score"))


def macro(matrix: DataFrame, negative: object) -> DataFrame:
    """(precision, recall, fscore): unweighted means over the classes but the negative one."""
    s = per_class(matrix).where(F.col("class") != F.lit(negative))
    return s.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "fscore")])


def untyped(matrix: DataFrame, negative: object) -> DataFrame:
    """Counts of positive against negative: a wrong positive class for a positive row is true."""
    n, t, p = F.col("n"), F.col("truth") != F.lit(negative), F.col("predicted") != F.lit(negative)
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    s = matrix.agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"), total(~t & ~p).alias("tn"))
    return s.select("tp", "fp", "fn", "tn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def binary(matrix: DataFrame, negative: object) -> DataFrame:
    """``untyped`` with ``auc`` of the hard labels, the mean of both classes' recalls; 0 where a class is absent."""
    s = untyped(matrix, negative)
    some = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return s.withColumn("auc", F.when(some, (F.col("recall") + ratio(F.col("tn"), F.col("tn") + F.col("fp"))) / 2).otherwise(0.0))


def boosted(score: Column, boost: Column | float) -> Column:
    """A score scaled by a boost; a negative one moves by as much as its absolute value would."""
    return F.when(score >= 0, score * boost).otherwise(score * (2 - F.lit(boost)))


def best_class(scores_: str, negative: object, boost: float = 1.0, threshold: float | None = None) -> Column:
    """The key of a score map with the highest score, the least key on ties.

    ``boost`` scales the negative class first. With a threshold the class is
    negative above it, and the best of the others elsewhere.
    """
    m, neg = F.col(scores_), F.lit(negative)
    moved = F.transform_values(m, lambda k, v: F.when(k == neg, boosted(v, boost)).otherwise(v))
    entries = F.map_entries(moved)
    if threshold is not None:
        entries = F.filter(entries, lambda e: e["key"] != neg)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    best = F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top), lambda e: e["key"]))
    return best if threshold is None else F.when(F.element_at(moved, neg) > threshold, neg).otherwise(best)


def score_ranges(df: DataFrame, scores_: str) -> DataFrame:
    """(class, least, most) of the scores of each class."""
    rows = df.select(F.explode(scores_).alias("class", "score"))
    return rows.groupBy("class").agg(F.min("score").alias("least"), F.max("score").alias("most"))


def boost_search(df: DataFrame, scores_: str, truth: str, negative: object, boosts: list[float]) -> DataFrame:
    """(boost, fscore) of the boost with the best micro F-score, the first of equals; one pass for all boosts."""
    settings = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(b).alias("boost")) for i, b in enumerate(boosts)]))
    rows = df.select(F.col(truth).alias("truth"), F.col(scores_).alias("m"), settings.alias("x")).select("truth", "m", "x.*")
    neg = F.lit(negative)
    moved = F.transform_values("m", lambda k, v: F.when(k == neg, F.when(v >= 0, v * F.col("boost")).otherwise(v * (2 - F.col("boost")))).otherwise(v))
    entries = F.map_entries(moved)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    p = F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top), lambda e: e["key"]))
    rows = rows.select("place", "boost", "truth", p.alias("p"))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    t, q = F.col("truth"), F.col("p")
    s = rows.groupBy("place", "boost").agg(n((t == q) & (t != neg)).alias("tp"), n((t != q) & (q != neg)).alias("fp"), n((t != q) & (t != neg)).alias("fn"))
    s = s.withColumn("fscore", scores(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    return s.orderBy(F.desc("fscore"), "place").limit(1).select("boost", "fscore")


def correct_events(arguments: DataFrame, event: list[str], right: str) -> DataFrame:
    """(event, correct): whether all arguments of an event are right."""
    return arguments.groupBy(*event).agg(F.bool_and(right).alias("correct"))


def compared(a: DataFrame, b: DataFrame, category: str) -> DataFrame:
    """(category, n_a, n_b, ratio): counts in two sets, 0 where missing; the ratio is null where n_b is 0."""
    x, y = (df.groupBy(category).agg(F.count("*").alias(n)) for df, n in ((a, "n_a"), (b, "n_b")))
    both = x.join(y, category, "full_outer").fillna(0, ["n_a", "n_b"])
    return both.withColumn("ratio", F.col("n_a") / F.nullif("n_b", F.lit(0)))


def all_correct(df: DataFrame, truth: str, out: str = "predicted") -> DataFrame:
    """The baseline that returns the truth."""
    return df.withColumn(out, F.col(truth))


def all_true(df: DataFrame, positive: object = "True", out: str = "predicted") -> DataFrame:
    """The baseline that calls every row positive."""
    return df.withColumn(out, F.lit(positive))


def mapped_entities(predicted: DataFrame, gold: DataFrame, keys: list[str], how: str = "head", tokens: DataFrame | None = None) -> DataFrame:
    """(keys, p, g): predicted and gold entities that match, many to many; a row with a null side for each that matches none.

    Both have (keys, id, type, begin, end, head_begin, head_end, given). ``head``: equal type and
    head; ``strict``: equal type and span; ``relaxed``: the predicted span lies within the gold one
    widened by a token on both sides, for which ``tokens`` has (keys, idx, begin, end).
    """
    names = ["id", "type", "begin", "end", "head_begin", "head_end"]
    side = lambda df, x: df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in names])
    p, g = side(predicted, "p"), side(gold, "g")
    if how == "relaxed":
        near = Window.partitionBy(*keys).orderBy("idx")
        t = tokens.select(*keys, "begin", "end", F.coalesce(F.lag("begin").over(near), "begin").alias("lo"), F.coalesce(F.lead("end").over(near), "end").alias("hi"))
        wide = g.join(t, keys).where("begin < end_g and begin_g < end").groupBy(*keys, "id_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        g = g.join(wide, [*keys, "id_g"], "left")
    test = {
        "head": "type_p = type_g and head_begin_p = head_begin_g and head_end_p = head_end_g",
        "strict": "type_p = type_g and begin_p = begin_g and end_p = end_g",
        "relaxed": "type_p = type_g and begin_p >= lo and end_p <= hi",
    }[how]
    on = reduce(Column.__and__, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]) & F.expr(test)
    both = p.alias("x").join(g.alias("y"), on, "full_outer")
    return both.select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], F.col("id_p").alias("p"), F.col("id_g").alias("g"), F.col("type_p"), F.col("type_g"))


def interaction_outcomes(predicted: DataFrame, gold: DataFrame, mapping: DataFrame, keys: list[str], negative: str = "neg") -> DataFrame:
    """(keys, truth, predicted) of predicted and gold interactions over mapped entities.

    A predicted interaction gives a row for each gold one between entities that its ends map to, or one
    against ``negative``; a gold one that none maps to is predicted ``negative``.
    """
    pairs = mapping.where("p is not null and g is not null").select(*keys, "p", "g")
    end = lambda e, c: pairs.select(*keys, F.col("p").alias(e), F.col("g").alias(c))
    mapped = predicted.select(*keys, "id", "e1", "e2", "type").join(end("e1", "g1"), [*keys, "e1"], "left").join(end("e2", "g2"), [*keys, "e2"], "left")
    g = gold.select(*keys, F.col("id").alias("gold"), F.col("e1").alias("g1"), F.col("e2").alias("g2"), F.col("type").alias("truth"))
    hits = mapped.join(g, [*keys, "g1", "g2"]).select(*keys, "id", "gold", "type", "truth").distinct()
    right = hits.select(*keys, "truth", F.col("type").alias("predicted"))
    wrong = predicted.join(hits.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").select(*keys, F.lit(negative).alias("truth"), F.col("type").alias("predicted"))
    missed = g.join(hits.select(*keys, "gold").distinct(), [*keys, "gold"], "left_anti").select(*keys, "truth", F.lit(negative).alias("predicted"))
    return right.unionByName(wrong).unionByName(missed)


def over_folds(matrices: DataFrame, fold: str, negative: object) -> DataFrame:
    """(how, precision, recall, fscore): ``average`` over folds, weighed by their rows, and ``pool`` of all folds' counts.

    ``matrices`` is a confusion matrix with a column for the fold.
    """
    n, t, p = F.col("n"), F.col("truth"), F.col("predicted")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    counts = [total((t == p) & (t != negative)).alias("tp"), total((t != p) & (p != negative)).alias("fp"), total((t != p) & (t != negative)).alias("fn"), F.sum("n").alias("rows")]
    names = ["precision", "recall", "fscore"]
    each = matrices.groupBy(fold).agg(*counts).select("rows", *scores(F.col("tp"), F.col("fp"), F.col("fn")))
    average = each.agg(*[(F.sum(F.col(c) * F.col("rows")) / F.sum("rows")).alias(c) for c in names]).select(F.lit("average").alias("how"), *names)
    pool = matrices.agg(*counts).select(F.lit("pool").alias("how"), *scores(F.col("tp"), F.col("fp"), F.col("fn")))
    return average.unionByName(pool)


def filter_counts(examples: DataFrame, kind: str, filters: dict[str, str]) -> DataFrame:
    """(class, filter, n): examples of a class by the first named filter (an SQL test) that drops them, ``kept`` where none does."""
    first = F.coalesce(*[F.when(F.expr(test), F.lit(name)) for name, test in filters.items()], F.lit("kept"))
    return examples.groupBy(F.col(kind).alias("class"), first.alias("filter")).agg(F.count("*").alias("n"))


def paired_directions(rows: DataFrame, keys: list[str], number: str, truth: str, predicted: str, negative: object = "neg") -> DataFrame:
    """(keys, pair, truth, predicted): examples 2k and 2k + 1 as one without direction, positive if either is."""
    pair = F.floor(F.col(number) / 2).alias("pair")
    some = lambda c: F.bool_or(F.col(c) != F.lit(negative)).alias(c)
    return rows.groupBy(*keys, pair).agg(some(truth), some(predicted))
