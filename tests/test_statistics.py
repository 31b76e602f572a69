"""Statistics of tables larger than the test tables."""

from pyspark.sql import functions as F

from tessera.functions import statistics


def test_spearman_of_millions_of_rows(spark):
    rows = spark.range(2_200_000).select((F.col("id") % 4).alias("x"), (3 - F.col("id") % 4).alias("y"))
    found = statistics.spearman(rows, "x", "y").first()
    # four ranks a quarter of the rows apart: the sum of squares is n (9 + 1 + 1 + 9) / 4 (n / 4)^2
    n = 2_200_000
    assert found.n == n
    assert abs(found.rho - (1 - 6 * n * 5 * (n / 4) ** 2 / (n * (n * n - 1)))) < 1e-9
