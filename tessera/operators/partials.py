"""Aggregates in parts: sketch states that later jobs merge, and exact quantiles of groups of any size.

A state is a row of a table: it is made once for a slice (a day, a file, a
partition), stored, and merged with others as often as wanted. Exact quantiles
are selected by histograms that narrow to the rank, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled, unsettled

#: Log of the registers of a distinct sketch: a standard error of 0.8 %.
LG_DISTINCT = 14
#: Size of a quantile sketch: a rank is off by 0.6 % at most, at 99 % confidence.
K_QUANTILE = 400
#: Bins of a histogram, and the most ranges that are broadcast.
BINS, RANGES = 1024, 100_000


def states(df: DataFrame, keys: Sequence[str], value: str, item: str) -> DataFrame:
    """(keys, n, distinct, quantiles): a mergeable state of each group, the slice among its keys."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(item, LG_DISTINCT).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), K_QUANTILE).alias("quantiles")
    )


def merged(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser groups from those of finer ones; the rows that they were made of aren't needed."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles", K_QUANTILE).alias("quantiles"))


def estimates(stored: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The states with their number of distinct items and the value at each named share of the rows."""
    at = {name: F.kll_sketch_get_quantile_double("quantiles", F.lit(p)) for name, p in probabilities.items()}
    return stored.withColumns({"n_distinct": F.hll_sketch_estimate("distinct"), **at}).drop("distinct", "quantiles")


def quantiles(df: DataFrame, group: Sequence[str], column: str, probabilities: dict[str, float], rounds: int = 400) -> DataFrame:
    """(group, one column a probability): exact quantiles with linear interpolation; groups without a value are left out.

    Each wanted rank is a range of values, the group's whole one at first. A round
    counts the values of every open range in ``BINS`` bins of equal width, adds up
    the bins, and narrows the range to the values of the bin that holds the rank.
    Counts combine before they shuffle: a task gets a bin's row of each partition,
    whatever the size of the group. A range of one value is found; few rounds do,
    as the width falls a thousandfold in each.
    """
    group = list(group)
    rows = df.select(*group, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for name, p in probabilities.items()])
    wanted = settled(sizes.select(*group, "lo", "hi", F.explode(asked).alias("a")).select(*group, "lo", "hi", "a.*"))
    ranks = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    open_ = settled(wanted.select(*group, "lo", "hi", F.explode(ranks).alias("rank")).distinct().withColumn("k", F.col("rank")))
    found = None
    for _ in range(rounds):
        ready = open_.where("lo = hi").select(*group, "rank", F.col("lo").alias("value"))
        found = ready if found is None else settled(found.unionByName(ready))
        open_ = open_.where("lo < hi")
        n = open_.count()
        if not n:
            break
        named = open_.select(*[F.col(c).alias(f"_{c}") for c in group], "lo", "hi", "rank", "k")
        inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
        for c in group:
            inside = inside & F.col(c).eqNullSafe(F.col(f"_{c}"))
        # halves keep a width beyond the largest double finite
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = rows.join(F.broadcast(named) if n <= RANGES else named, inside).groupBy(*group, "rank", "k", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        bins = bins.agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("m").over(Window.partitionBy(*group, "rank").orderBy("bin")) - F.col("m")
        bins = bins.withColumn("before", before).where("before <= k and k < before + m")
        open_ = settled(bins.select(*group, "lo", "hi", "rank", (F.col("k") - F.col("before")).alias("k")))
    else:
        raise unsettled("selection of a rank", rounds)
    below, above = (wanted.withColumn("rank", f("at")).alias("w").join(found.alias("f"), _same([*group, "rank"])).select(*[F.col(f"w.{c}") for c in [*group, "name", "at"]], F.col("value").alias(v)) for f, v in ((F.floor, "x"), (F.ceil, "y")))
    both = below.alias("w").join(above.alias("f"), _same([*group, "name"])).select(*[F.col(f"w.{c}") for c in [*group, "name", "at"]], "x", "y")
    value = F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at"))
    return both.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in probabilities])


def _same(columns: Sequence[str]):
    """Rows of the tables w and f with equal values, null among them."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}"))
    return out
