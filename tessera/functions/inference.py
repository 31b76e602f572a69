"""Further statistics and tests: reads of whole tables as aggregates, ranks over distinct values only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.statistics import ranked
from tessera.operators.lineage import settled
from tessera.operators.tables import running


def moment(x: str, mean: Column, k: int) -> Column:
    """k-th central moment of the population; ``mean`` is a column of the same row."""
    return F.avg(F.pow(F.col(x) - mean, F.lit(k)))


def spread(x: str) -> list[Column]:
    """Variance and deviation of population and sample, and the standard error."""
    return [
        F.var_pop(x).alias("var_pop"),
        F.stddev_pop(x).alias("sd_pop"),
        F.var_samp(x).alias("var"),
        F.stddev_samp(x).alias("sd"),
        (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sterr"),
    ]


def sums(x: str, y: str) -> list[Column]:
    """Sum, sum of squares, sum of products, sum of squared differences, squared sum."""
    a, b = F.col(x), F.col(y)
    return [
        F.sum(a).alias("total"),
        F.sum(a * a).alias("ss"),
        F.sum(a * b).alias("summult"),
        F.sum((a - b) * (a - b)).alias("sumdiffsquared"),
        (F.sum(a) * F.sum(a)).alias("square_of_sums"),
    ]


def percentile_of(x: str, score: float) -> Column:
    """Percentage of values at or below a score."""
    return 100 * F.avg(F.when(F.col(x) <= score, 1.0).when(F.col(x).isNotNull(), 0.0))


def obrien(df: DataFrame, group: str, x: str, out: str = "r") -> DataFrame:
    """O'Brien's transform: its group means are the groups' variances; null in groups of fewer than three."""
    s = df.groupBy(group).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.var_samp(x).alias("_v"))
    n, v, d = F.col("_n"), F.col("_v"), F.col(x) - F.col("_m")
    r = ((n - 1.5) * n * d * d - 0.5 * v * (n - 1)) / F.nullif((n - 1) * (n - 2), F.lit(0))
    return df.join(s, group).withColumn(out, r).drop("_n", "_m", "_v")


def trim(df: DataFrame, x: str, key: str, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """Rows without the lowest int(low * n) and highest int(high * n) by (x, key).

    Places are sums of the counts of distinct values; only the ties at a cut are ordered by key.
    """
    rows = df.where(F.col(x).isNotNull())
    n = rows.count()
    first, last = int(low * n), n - int(high * n)
    values = running(rows.groupBy(x).agg(F.count("*").alias("_n")), x, "_n", "_before")
    placed = rows.join(values, x)
    whole = (F.col("_before") >= first) & (F.col("_before") + F.col("_n") <= last)
    touched = ~whole & (F.col("_before") < last) & (F.col("_before") + F.col("_n") > first)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(x).orderBy(key)) - 1
    cut = placed.where(touched).withColumn("_k", place).where((F.col("_k") >= first) & (F.col("_k") < last)).drop("_k")
    return placed.where(whole).unionByName(cut).select(*df.columns)


def point_biserial(df: DataFrame, group: str, x: str, a: object, b: object) -> DataFrame:
    """(mean of b - mean of a) / population deviation * sqrt(share of a * share of b)."""
    rows = df.where(F.col(group).isin([a, b]) & F.col(x).isNotNull())
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(x)))
    p = F.avg(F.when(F.col(group) == a, 1.0).otherwise(0.0))
    return rows.agg(((mean(b) - mean(a)) / F.stddev_pop(x) * F.sqrt(p * (1 - p))).alias("r"), F.count("*").alias("n"))


def concordance(y: np.ndarray, n: np.ndarray) -> float:
    """Sum of n_i n_j sign(y_j - y_i) over i < j, by merging sorted halves."""
    total, size = 0.0, 1
    y, n = y.copy(), n.astype(float)
    while size < len(y):
        for lo in range(0, len(y) - size, 2 * size):
            mid, hi = lo + size, min(lo + 2 * size, len(y))
            sums = np.concatenate(([0.0], np.cumsum(n[lo:mid])))
            below = sums[np.searchsorted(y[lo:mid], y[mid:hi], "left")]
            above = sums[-1] - sums[np.searchsorted(y[lo:mid], y[mid:hi], "right")]
            total += float((n[mid:hi] * (below - above)).sum())
            order = np.argsort(y[lo:hi], kind="stable")
            y[lo:hi], n[lo:hi] = y[lo:hi][order], n[lo:hi][order]
        size *= 2
    return total


def _within(frame: pd.DataFrame, block: str | None) -> float:
    """Concordant less discordant pairs of a block's cells; pairs of one ``block`` of the other column are left out."""
    frame = frame.sort_values(["x", "y"])

    def excess(f: pd.DataFrame) -> float:
        # cells of one x are in the order of y, so that all their pairs with different y were counted as concordant
        equal = f.groupby("x")["n"].agg(["sum", lambda v: (v**2).sum()]).to_numpy()
        return concordance(f["y"].to_numpy(), f["n"].to_numpy()) - float((equal[:, 0] ** 2 - equal[:, 1]).sum()) / 2

    return excess(frame) - (sum(excess(part) for _, part in frame.groupby(block)) if block else 0.0)


def kendall(df: DataFrame, x: str, y: str, blocks: int | None = None) -> DataFrame:
    """(tau, n): tau-b, from the table of counts of the two columns' values.

    Both columns are cut into blocks at quantiles. Pairs in different blocks of
    both are counted from the small table of block sizes, pairs in one block of x
    inside that block, and the rest inside the blocks of y; each by merging, so
    no pairs of rows or values are made. There are 64 blocks, and 1024 at most,
    so many that one has some 100,000 cells of the table.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = settled(cells.agg(F.count("*").cast("double").alias("n")))
    blocks = blocks or min(1024, max(64, cells.count() // 100_000))
    for c in ("x", "y"):
        edges = sorted(set(cells.approxQuantile(c, [i / blocks for i in range(1, blocks)], 0.2 / blocks)))
        value = F.col(c)
        cells = cells.withColumn(f"b{c}", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0))  # noqa: B023
    cells = settled(cells)
    sizes = np.zeros((blocks, blocks))
    for r in cells.groupBy("bx", "by").agg(F.sum("n").alias("n")).collect():  # blocks x blocks rows at most
        sizes[r.bx, r.by] = r.n
    before = np.zeros((blocks + 1, blocks + 1))
    before[1:, 1:] = sizes.cumsum(0).cumsum(1)
    left = before[:-1]  # sums over lower blocks of x
    apart = float((sizes * (left[:, :-1] - (left[:, -1:] - left[:, 1:]))).sum())

    def inside(other: str | None):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"e": [_within(frame, other)]})

        return run

    parts = [cells.groupBy("bx").applyInPandas(inside(None), "e double"), cells.groupBy("by").applyInPandas(inside("bx"), "e double")]
    excess = apart + sum(p.agg(F.sum("e")).first()[0] or 0.0 for p in parts)
    tied = lambda c: cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0] or 0.0
    n = int(sizes.sum())
    pairs = n * (n - 1) / 2
    width = ((pairs - tied("x")) * (pairs - tied("y"))) ** 0.5
    return df.sparkSession.createDataFrame([(excess / width if width else None, n)], "tau double, n long")



def ttest_single(x: str, mean: float) -> list[Column]:
    """t of a sample against a given mean, and its degrees of freedom."""
    return [((F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).alias("t"), (F.count(x) - 1).alias("df")]


def ttest_paired(x: str, y: str) -> list[Column]:
    """t of paired differences, and its degrees of freedom."""
    d = F.col(x) - F.col(y)
    return [(F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"), (F.count(d) - 1).alias("df")]


def kolmogorov(df: DataFrame, group: str, x: str, a: object, b: object) -> DataFrame:
    """(d, n0, n1): greatest distance of two samples' cumulative distributions, ties taken together."""
    one = lambda g: F.sum(F.when(F.col(group) == g, 1).otherwise(0))
    v = df.where(F.col(group).isin([a, b]) & F.col(x).isNotNull()).groupBy(x).agg(one(a).alias("_ca"), one(b).alias("_cb"))
    v = running(running(v, x, "_ca", "_fa"), x, "_cb", "_fb")
    v = v.select(x, (F.col("_fa") + F.col("_ca")).alias("fa"), (F.col("_fb") + F.col("_cb")).alias("fb"))
    n = v.agg(F.max("fa").alias("n0"), F.max("fb").alias("n1"))
    return v.join(F.broadcast(n)).groupBy("n0", "n1").agg(F.max(F.abs(F.col("fa") / F.col("n0") - F.col("fb") / F.col("n1"))).alias("d")).select("d", "n0", "n1")


def tie_correction(df: DataFrame, x: str) -> DataFrame:
    """1 - sum(t^3 - t) / (n^3 - n) over the counts of equal values."""
    t = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").cast("double").alias("t"))
    n = F.sum("t")
    return t.agg((1 - F.sum(F.pow("t", 3) - F.col("t")) / (n * n * n - n)).alias("correction"))


def rank_sums(df: DataFrame, group: str, x: str, a: object, b: object) -> DataFrame:
    """z of the rank sum of ``a`` in both groups together, without a correction for ties."""
    r = ranked(df.where(F.col(group).isin([a, b]) & F.col(x).isNotNull()).select(group, x), x, "_r")
    first = F.col(group) == a
    s = r.agg(F.sum(F.when(first, F.col("_r"))).alias("s"), F.sum(first.cast("double")).alias("n"), F.sum((~first).cast("double")).alias("m"))
    n, m = F.col("n"), F.col("m")
    return s.select(((F.col("s") - n * (n + m + 1) / 2) / F.sqrt(n * m * (n + m + 1) / 12)).alias("z"))


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """(t, n): the smaller sum of signed ranks of the differences that aren't 0."""
    d = df.select((F.col(x) - F.col(y)).alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = ranked(d, "_a", "_r")
    side = lambda test: F.coalesce(F.sum(F.when(test, F.col("_r"))), F.lit(0.0))
    return r.agg(F.least(side(F.col("_d") > 0), side(F.col("_d") < 0)).alias("t"), F.count("*").alias("n"))


def friedman(df: DataFrame, measures: Sequence[Column]) -> DataFrame:
    """(chisq, n): ranks of each row's measures, average ranks for ties, summed by measure."""
    k = len(measures)
    names = [f"m{i}" for i in range(k)]
    rows = df.select(*[c.alias(n) for c, n in zip(measures, names, strict=True)]).dropna()
    below = lambda c: sum((F.col(o) < F.col(c)).cast("double") for o in names)
    equal = lambda c: sum((F.col(o) == F.col(c)).cast("double") for o in names)
    ranks = rows.select(*[(below(c) + (equal(c) + 1) / 2).alias(c) for c in names])
    n = F.count("*")
    squares = sum(F.sum(c) * F.sum(c) for c in names)
    return ranks.agg((12 / (n * k * (k + 1)) * squares - 3 * n * (k + 1)).alias("chisq"), n.alias("n"))


def within_limits(x: str, low: float | None = None, high: float | None = None, inclusive: tuple[bool, bool] = (True, True)) -> Column:
    """x where it is inside the limits, else null; aggregates of it are trimmed ones."""
    c, keep = F.col(x), F.lit(True)
    if low is not None:
        keep = keep & (c >= low if inclusive[0] else c > low)
    if high is not None:
        keep = keep & (c <= high if inclusive[1] else c < high)
    return F.when(keep, c)


def trimmed(x: str, low: float | None = None, high: float | None = None, inclusive: tuple[bool, bool] = (True, True)) -> list[Column]:
    """Mean, variance, least, greatest, deviation and standard error of the values inside limits."""
    c = within_limits(x, low, high, inclusive)
    return [
        F.avg(c).alias("tmean"),
        F.var_samp(c).alias("tvar"),
        F.min(c).alias("tmin"),
        F.max(c).alias("tmax"),
        F.stddev_samp(c).alias("tstdev"),
        (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("tsem"),
    ]


def skew_z(n: Column, skew: Column) -> Column:
    """z of a skewness under normality (D'Agostino 1970)."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    return F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)


def kurtosis_z(n: Column, kurtosis: Column) -> Column:
    """z of a kurtosis (3 for a normal sample) under normality (Anscombe and Glynn 1983)."""
    spread_ = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis - 3 * (n - 1) / (n + 1)) / F.sqrt(spread_)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    return (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))


def normality(df: DataFrame, x: str) -> DataFrame:
    """(skew_z, kurtosis_z, k2, p): the omnibus test; p is exact, as chi-square of two degrees is exp(-k2 / 2)."""
    s = df.agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("s"), (F.kurtosis(x) + 3).alias("k"))
    s = s.select(skew_z(F.col("n"), F.col("s")).alias("skew_z"), kurtosis_z(F.col("n"), F.col("k")).alias("kurtosis_z"))
    k2 = F.col("skew_z") * F.col("skew_z") + F.col("kurtosis_z") * F.col("kurtosis_z")
    return s.select("skew_z", "kurtosis_z", k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def signal_to_noise(x: str) -> Column:
    """Mean / deviation (n - 1), 0 where the deviation is 0."""
    sd = F.stddev_samp(x)
    return F.when(sd == 0, 0.0).otherwise(F.avg(x) / sd)


def threshold(x: str, low: float | None = None, high: float | None = None, new: float = 0.0) -> Column:
    """x, or ``new`` outside the limits."""
    return F.when(F.col(x).isNull(), None).otherwise(F.coalesce(within_limits(x, low, high), F.lit(new)))


def z_against(df: DataFrame, x: str, other: DataFrame, y: str, out: str = "z") -> DataFrame:
    """(x - mean) / population deviation of another sample."""
    s = other.agg(F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s"))
    return df.join(F.broadcast(s)).withColumn(out, (F.col(x) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def covariances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, covariance, correlation) of every pair of columns, population, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def f_nested(error_reduced: Column, error_full: Column, df_reduced: Column, df_full: Column) -> Column:
    """F of a reduced against a full model, from their error sums and degrees of freedom."""
    return ((error_reduced - error_full) / (df_reduced - df_full)) / (error_full / df_full)


def within_subject(df: DataFrame, subject: str, factors: Sequence[str]) -> DataFrame:
    """(factor, within): whether any subject has more than one level of a factor."""
    s = df.groupBy(subject).agg(*[F.countDistinct(f).alias(f) for f in factors])
    one = s.agg(*[F.max(F.col(f) > 1).alias(f) for f in factors])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("within")) for f in factors])))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def sorted_places(df: DataFrame, x: str, key: str) -> DataFrame:
    """(place, value, key): the values in order with the key of the row each comes from; a distributed sort, no task sorts all."""
    from tessera.operators.tables import ranked as placed

    return placed(df.select(F.col(x).alias("value"), key), ["value", key], "place")


def paired(df: DataFrame, x: str, y: str) -> DataFrame:
    """What a paired comparison rests on, in one row: n, both means and spreads, the variance ratio, t of the differences, and r.

    Which of the tests applies is the caller's choice; nothing is asked for.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = F.col(x) - F.col(y)
    vx, vy = F.var_samp(x), F.var_samp(y)
    return both.agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.stddev_samp(x).alias("sd_x"),
        F.stddev_samp(y).alias("sd_y"),
        (F.greatest(vx, vy) / F.least(vx, vy)).alias("variance_ratio"),
        (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"),
        F.corr(x, y).alias("r"),
    )


def linear_model(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[np.ndarray, float, int, int]:
    """Coefficients (constant first), F and its degrees of freedom of a least-squares model; one pass adds up the products of columns."""
    names = ["_one", *xs, y]
    rows = df.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = v or 0.0
    k, n = len(xs), int(gram[0, 0])
    beta = np.linalg.solve(gram[:-1, :-1], gram[:-1, -1])
    full = gram[-1, -1] - beta @ gram[:-1, -1]
    null = gram[-1, -1] - gram[0, -1] ** 2 / n
    return beta, float((null - full) / k / (full / (n - k - 1))), k, n - k - 1


def f_multivariate(restricted: np.ndarray, full: np.ndarray, df_num: float, df_den: float) -> float:
    """F of two error matrices by their determinants; numbers count as 1 x 1 matrices."""
    er, ef = (float(np.linalg.det(np.atleast_2d(m))) for m in (restricted, full))
    return (er - ef) / df_num / (ef / df_den)
