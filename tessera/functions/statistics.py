"""Descriptive statistics and tests as aggregates; every function reads its table once or by small group tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import running


def geometric_mean(x: str) -> Column:
    return F.exp(F.avg(F.log(x)))


def harmonic_mean(x: str) -> Column:
    return F.count(x) / F.sum(1 / F.col(x))


def variation(x: str) -> Column:
    """Population standard deviation as a percentage of the mean."""
    return 100 * F.stddev_pop(x) / F.avg(x)


def describe(x: str) -> list[Column]:
    """n, min, max, mean, sd (n - 1), skew (m3 / m2^1.5) and kurtosis (m4 / m2^2, not excess)."""
    return [
        F.count(x).alias("n"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.skewness(x).alias("skew"),
        (F.kurtosis(x) + 3).alias("kurtosis"),
    ]


def frequencies(df: DataFrame, x: str) -> DataFrame:
    """(value, n) of each value."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count("*").alias("n"))


def modes(df: DataFrame, x: str) -> DataFrame:
    """(value, n) of all modal values."""
    n = frequencies(df, x)
    return n.join(n.agg(F.max("n").alias("n")), "n").select("value", "n")


def histogram(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """(bin, n, cumulative, relative) for bins of equal width between the least and greatest value, empty ones with 0."""
    s = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    spark = df.sparkSession
    if not s.n:
        return spark.createDataFrame([], "bin int, n long, cumulative long, relative double")
    width = (s.hi - s.lo) / bins or 1.0
    place = F.least(F.floor((F.col(x) - s.lo) / width), F.lit(bins - 1)).cast("int")
    counts = {r.bin: r.n for r in df.where(F.col(x).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).collect()}
    rows, total = [], 0
    for b in range(bins):
        total += counts.get(b, 0)
        rows.append((b, counts.get(b, 0), total, counts.get(b, 0) / s.n))
    return spark.createDataFrame(rows, "bin int, n long, cumulative long, relative double")


def ranked(df: DataFrame, x: str, out: str = "rank") -> DataFrame:
    """Average rank of each row's value, from 1; ties share the mean of their places.

    Ranks are those of the distinct values, whose counts are summed up in
    buckets; the rows get them by a join and are never sorted as a whole.
    """
    values = running(df.groupBy(x).agg(F.count("*").alias("_n")), x, "_n", "_before")
    return df.join(values.select(x, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out)), x)


def zscores(df: DataFrame, x: str, out: str = "z") -> DataFrame:
    """(x - mean) / population standard deviation."""
    s = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("sd")).first()
    return df.withColumn(out, (F.col(x) - F.lit(s.m)) / F.lit(s.sd))


def regression(x: str, y: str) -> list[Column]:
    """Slope, intercept, r and the standard error of the estimate, sqrt(1 - r^2) * sd_pop(y)."""
    r = F.corr(x, y)
    return [
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        r.alias("r"),
        (F.sqrt(1 - r * r) * F.stddev_pop(y)).alias("sterrest"),
    ]


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """1 - 6 sum(d^2) / (n (n^2 - 1)) of average ranks, without a correction for ties."""
    both = ranked(ranked(df.select(x, y), x, "_rx"), y, "_ry")
    n, d = F.count("*"), F.sum(F.pow(F.col("_rx") - F.col("_ry"), 2))
    size = n.cast("double")  # the cube of two million rows is no long
    return both.agg((1 - 6 * d / (size * (size * size - 1))).alias("rho"), n.alias("n"))


def _two(df: DataFrame, group: str, x: str, a: object, b: object) -> DataFrame:
    return df.where(F.col(group).isin([a, b])).select(F.when(F.col(group) == a, 0).otherwise(1).alias("_g"), F.col(x).alias("_x"))


def ttest_independent(df: DataFrame, group: str, x: str, a: object, b: object) -> DataFrame:
    """t with the pooled variance, and its degrees of freedom."""
    s = _two(df, group, x, a, b).groupBy("_g").agg(F.count("_x").alias("n"), F.avg("_x").alias("m"), F.var_samp("_x").alias("v"))
    of = lambda c, g: F.max(F.when(F.col("_g") == g, F.col(c)))
    n0, n1 = of("n", 0), of("n", 1)
    pooled = ((n0 - 1) * of("v", 0) + (n1 - 1) * of("v", 1)) / (n0 + n1 - 2)
    return s.agg(((of("m", 0) - of("m", 1)) / F.sqrt(pooled * (1 / n0 + 1 / n1))).alias("t"), (n0 + n1 - 2).alias("df"))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """One-way F and its degrees of freedom between and within groups."""
    s = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    return s.agg(((between / (k - 1)) / (within / (n - k))).alias("f"), (k - 1).alias("df_between"), (n - k).alias("df_within"))


def chisquare(df: DataFrame, group: str) -> DataFrame:
    """Sum of (observed - expected)^2 / expected of group sizes against equal ones."""
    s = df.groupBy(group).agg(F.count("*").alias("o"))
    e = F.sum("o") / F.count("*")
    return s.agg((F.sum(F.col("o") * F.col("o")) / e - F.sum("o")).alias("chisq"), (F.count("*") - 1).alias("df"))


def mann_whitney(df: DataFrame, group: str, x: str, a: object, b: object) -> DataFrame:
    """The smaller U of two groups."""
    r = ranked(_two(df, group, x, a, b), "_x", "_r").groupBy("_g").agg(F.count("*").alias("n"), F.sum("_r").alias("r"))
    of = lambda c, g: F.max(F.when(F.col("_g") == g, F.col(c)))
    n0, n1 = of("n", 0), of("n", 1)
    u = n0 * n1 + n0 * (n0 + 1) / 2 - of("r", 0)
    return r.agg(F.least(u, n0 * n1 - u).alias("u"), n0.alias("n0"), n1.alias("n1"))


def kruskal(df: DataFrame, group: str, x: str) -> DataFrame:
    """H of any number of groups, divided by the tie correction."""
    rows = ranked(df.where(F.col(x).isNotNull()).select(group, x), x, "_r")
    s = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("r"))
    ties = frequencies(df, x).agg(F.sum(F.pow("n", 3) - F.col("n")).alias("t"))
    n = F.sum("n")
    h = s.agg((12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)).alias("h"), n.alias("n"))
    return h.join(ties).select((F.col("h") / (1 - F.col("t") / (F.pow("n", 3) - F.col("n")))).alias("h"), "n")
