"""Splits, folds and set operations on corpora, by arithmetic hash so that they repeat everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range that is sorted in one task.
RANGE_ROWS = 1_000_000


def fraction(key: str, seed: int = 0) -> Column:
    """A number in [0, 1) from an integer key and a seed."""
    return F.pmod(F.pmod(F.col(key), F.lit(1_000_003)) * 2654435761 + seed * 97, F.lit(1000)) / 1000.0


def split(df: DataFrame, key: str, cutoffs: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Column ``set``: the first named cutoff that the key's fraction is below; null above all."""
    value, out = fraction(key, seed), None
    for name, cut in cutoffs:
        out = (F if out is None else out).when(value < cut, name)
    return df.withColumn("set", out)


def resplit(df: DataFrame, key: str, cutoffs: list[tuple[str, float]], source: str | None = None, seed: int = 0) -> DataFrame:
    """``split`` of the rows of one set (or all), which remembers ``orig_set`` and ``set_value``; a value above all cutoffs keeps its set."""
    rows = split(df.withColumn("orig_set", F.col("set")), key, cutoffs, seed).withColumn("set_value", fraction(key, seed))
    mine = F.lit(True) if source is None else F.coalesce(F.col("orig_set") == source, F.lit(False))
    return rows.withColumn("set", F.when(mine, F.coalesce("set", "orig_set")).otherwise(F.col("orig_set")))


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Column ``fold``: folds of equal size, at most one row apart, in the order of a hash of the key."""
    from tessera.operators.tables import running

    hashed = F.pmod(F.col(key) * 7919, F.lit(1_000_003)) * 1_000_000_007 + F.col(key)
    rows = running(df.withColumn("_h", hashed).withColumn("_one", F.lit(1).cast("long")), "_h", "_one", "_k")
    return rows.withColumn("fold", F.pmod("_k", F.lit(k)).cast("int")).drop("_h", "_one", "_k")


def feature_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, side): values of one side only, or of both."""
    x, y = (df.select(F.col(column).alias("value")).distinct().withColumn(n, F.lit(1)) for df, n in ((a, "_a"), (b, "_b")))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return x.join(y, "value", "full_outer").select("value", side.alias("side"))


def number_within(df: DataFrame, parent: str, order: str, out: str) -> DataFrame:
    """Hierarchical ids: rows numbered from 0 inside their parent."""
    from tessera.operators.tables import ranked

    rows = ranked(df, [parent, order], "_rank")
    first = rows.groupBy(parent).agg(F.min("_rank").alias("_first")).withColumnRenamed(parent, "_parent")
    rows = rows.join(first, F.col(parent).eqNullSafe(F.col("_parent")))
    return rows.withColumn(out, F.concat(F.col(parent).cast("string"), F.lit(".s"), (F.col("_rank") - F.col("_first")).cast("string"))).drop("_rank", "_first", "_parent")


def schema_ranges(instances: DataFrame, owner: str, kind: str, argument: str) -> DataFrame:
    """(kind, argument, least, most): arguments of each type that an instance of a kind has, 0 where it has none."""
    kinds = instances.groupBy(kind).agg(F.countDistinct(owner).alias("owners"))
    n = instances.where(F.col(argument).isNotNull()).groupBy(owner, kind, argument).agg(F.count("*").alias("n"))
    s = n.groupBy(kind, argument).agg(F.min("n").alias("lo"), F.max("n").alias("most"), F.count("*").alias("have"))
    least = F.when(F.col("have") < F.col("owners"), 0).otherwise(F.col("lo"))
    return s.join(kinds, kind).select(kind, argument, least.cast("long").alias("least"), "most")


def sample_exact(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """int(share * n) rows, the first in the order of a hash of the unique integer key."""
    from tessera.operators.tables import running

    hashed = F.pmod((F.col(key) + seed * 104_729) * 7919, F.lit(1_000_003)) * 1_000_000_007 + F.col(key)
    rows = running(df.withColumn("_h", hashed).withColumn("_one", F.lit(1).cast("long")), "_h", "_one", "_k")
    return rows.where(F.col("_k") < int(share * df.count())).drop("_h", "_one", "_k")


def moved(df: DataFrame, keys: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Column ``set``: listed rows of one set in another one."""
    rows = df.join(keys.select(key).distinct().withColumn("_m", F.lit(True)), key, "left")
    return rows.withColumn("set", F.when(F.col("_m") & (F.col("set") == source), target).otherwise(F.col("set"))).drop("_m")


def divide(df: DataFrame, path: str, merged: dict[str, list[str]] | None = None) -> int:
    """One folder a set, and one for each merged set such as train-and-devel; returns the rows without a set."""
    rows = df.where(F.col("set").isNotNull())
    for name, parts in (merged or {}).items():
        rows = rows.unionByName(df.where(F.col("set").isin(parts)).withColumn("set", F.lit(name)))
    rows.write.mode("overwrite").partitionBy("set").parquet(path)
    return df.where(F.col("set").isNull()).count()


def stratified(df: DataFrame, key: str, stratum: str, cutoffs: list[tuple[str, float]]) -> DataFrame:
    """Column ``set``: the shares of every stratum's rows as near the cutoffs' as whole rows allow.

    Rows are placed inside their stratum by a hash of the key; the place of a
    row among its stratum's, centred, falls below a cutoff. A stratum is cut into
    hash ranges of at most some ``RANGE_ROWS`` rows, so that no task sorts all of it.
    """
    hashed = F.pmod(F.col(key) * 7919, F.lit(1_000_003)) * 1_000_000_007 + F.col(key)
    ranges = max(64, df.count() // RANGE_ROWS)
    rows = df.withColumn("_h", hashed).withColumn("_b", F.floor(F.pmod(F.col(key) * 7919, F.lit(1_000_003)) / 1_000_003 * ranges))
    sizes = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_m"))
    by = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_m").over(by), F.lit(0))).withColumn("_n", F.sum("_m").over(Window.partitionBy(stratum))).drop("_m")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h")))
    rows = rows.alias("r").join(sizes.alias("s"), F.col(f"r.{stratum}").eqNullSafe(F.col(f"s.{stratum}")) & (F.col("r._b") == F.col("s._b")))
    at, out = (F.col("s._start") + F.col("r._k") - 0.5) / F.col("s._n"), None
    for name, cut in cutoffs:
        out = (F if out is None else out).when(at < cut, name)
    return rows.select(*[F.col(f"r.{c}") for c in df.columns], out.alias("set"))


def unseen(df: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of these columns that the other table hasn't."""
    return df.select(*columns).exceptAll(others.select(*columns)).distinct()


def grid(**values: list) -> list[dict]:
    """Every setting of named parameters, the last name fastest."""
    from itertools import product

    return [dict(zip(values, v, strict=True)) for v in product(*values.values())]


def divided_examples(examples: DataFrame, folds_: DataFrame, example_id: str = "example_id", doc: str = "doc_id") -> DataFrame:
    """Examples with the ``fold`` of their document, which is the id without its last two parts."""
    own = F.regexp_replace(example_id, r"\.[^.]*\.[^.]*$", "")
    return examples.withColumn(doc, own).join(folds_.select(doc, "fold"), doc)


def compared_examples(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, outcome): examples of two sets by id: ``same``, ``class``, ``features``, ``both`` that differ, or ``left``, ``right`` alone.

    Both have key, class and features, a map; entries are compared without order.
    """
    flat = lambda df, x: df.select(key, F.col("class").alias(f"c{x}"), F.array_sort(F.map_entries("features")).alias(f"f{x}"), F.lit(True).alias(f"h{x}"))
    both = flat(a, 1).join(flat(b, 2), key, "full_outer")
    kind, feats = F.col("c1").eqNullSafe(F.col("c2")), F.col("f1").eqNullSafe(F.col("f2"))
    outcome = F.when(F.col("h2").isNull(), "left").when(F.col("h1").isNull(), "right").when(kind & feats, "same").when(feats, "class").when(kind, "features").otherwise("both")
    return both.select(key, outcome.alias("outcome"))


def unique_examples(examples: DataFrame, key: str) -> DataFrame:
    """The first example of each class and feature vector; maps are compared by their sorted entries."""
    vector = F.array_sort(F.map_entries("features"))
    first = examples.groupBy("class", vector.alias("_v")).agg(F.min(key).alias(key))
    return examples.join(first.select(key), key, "left_semi")


def chosen(df: DataFrame, ids: DataFrame | None = None, key: str = "doc_id", attributes: dict[str, list] | None = None, invert: bool = False) -> DataFrame:
    """Rows with a listed key and, in every named column, one of its values; the others with ``invert``."""
    rows = df.withColumn("_hit", F.lit(True))
    for c, values in (attributes or {}).items():
        rows = rows.withColumn("_hit", F.col("_hit") & F.coalesce(F.col(c).isin(values), F.lit(False)))
    if ids is not None:
        rows = rows.join(ids.select(key).distinct().withColumn("_listed", F.lit(True)), key, "left")
        rows = rows.withColumn("_hit", F.col("_hit") & F.coalesce("_listed", F.lit(False))).drop("_listed")
    return rows.where(~F.col("_hit") if invert else F.col("_hit")).select(*df.columns)


def lowest_cut(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The rows without the lowest ``share`` of them by score, then key (numeric and unique)."""
    from tessera.operators.tables import ranked

    rows = ranked(df, [score, key], "_rank")
    return rows.where(F.col("_rank") >= F.lit(share) * df.count()).drop("_rank")


def best_models(results: DataFrame, score: str, key: str, keep: int) -> DataFrame:
    """The ``keep`` models with the highest score, the least key of equals."""
    return results.orderBy(F.desc(score), key).limit(keep)


def capped(df: DataFrame, keys: list[str], order: str, most: int = 100) -> DataFrame:
    """The first ``most`` + 1 rows of each group: generation stops after the row that exceeds the limit."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most + 1).drop("_r")


def by_number(df: DataFrame, column: str, *before: str) -> DataFrame:
    """Rows in the order of the number that an id ends with."""
    return df.orderBy(*before, F.regexp_extract(column, r"(\d+)$", 1).cast("long"), column)
