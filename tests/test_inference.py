"""Tail probabilities against printed table values, and tests on rows worked by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import inference
from tessera.functions import probability as p
from tessera.operators import tables


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (p.chisq_p(3.841458820694124, 1), 0.05),
        (p.chisq_p(18.307038053275146, 10), 0.05),
        (p.chisq_p(200.0, 3), 4.2e-43),
        (p.t_p(2.2281388519649385, 10), 0.05),
        (p.t_p(12.706204736432095, 1), 0.05),
        (p.f_p(4.964602743730711, 1, 10), 0.05),
        (p.f_p(2.978237016203265, 10, 10), 0.05),
        (p.z_p(1.959963984540054), 0.05),
        (p.normal_cdf(0.0), 0.5),
        (p.ks_p(1.3580986393225505), 0.05),
        (p.r_p(0.0, 12), 1.0),
    ],
)
def test_tails(got, want):
    assert got == pytest.approx(want, rel=2e-2 if want < 1e-9 else 1e-6)


def test_probability_column(spark):
    df = spark.createDataFrame([(2.2281388519649385, 10), (None, 3)], "t double, df int")
    got = [r.p for r in df.select(p.probability("t_p", F.col("t"), F.col("df")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05)
    assert got[1] is None


def test_kendall_by_pairs(spark):
    rows = [(1, 2), (2, 1), (3, 4), (4, 3), (5, 5), (5, 1)]
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    x, y = (sum(a[i] != b[i] for a, b in pairs) for i in (0, 1))
    got = inference.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    assert got.n == 6
    assert got.tau == pytest.approx(s / (x * y) ** 0.5)


def test_trim_cuts_ties_by_key(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0, 3.0, None])], "k int, v double")
    assert sorted(r.k for r in inference.trim(df, "v", "k", 0.34, 0.2).collect()) == [2, 3, 4]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, k int, v double, w double")
    assert inference.trim(df, "v", "k", 0.1, 0.1).count() == 0
    assert inference.wilcoxon(df, "v", "w").first().n == 0
    assert inference.obrien(df, "g", "v").count() == 0


def test_nest_inverts_flat(spark):
    df = spark.createDataFrame([(1, [3, 1, 2]), (2, [5])], "k int, v array<int>")
    back = tables.nest(tables.flat(df, "v", "x"), ["k"], "place", "x", "v")
    assert sorted(map(tuple, back.collect())) == [(1, [3, 1, 2]), (2, [5])]


def test_aligned_lines(spark):
    df = spark.createDataFrame([("a", 10), ("bcd", None)], "x string, y int")
    assert sorted(r.line for r in tables.aligned_lines(df).collect()) == ["a    10", "bcd"]
