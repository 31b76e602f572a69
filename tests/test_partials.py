"""Exact quantiles of groups and mergeable states against plain figures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import partials


@pytest.mark.parametrize("ranges", [0, partials.RANGES])
def test_quantiles_of_groups(spark, monkeypatch, ranges):
    monkeypatch.setattr(partials, "RANGES", ranges)
    monkeypatch.setattr(partials, "BINS", 7)
    rng = random.Random(4)
    groups = {"ties": [rng.choice([1.0, 2.0, 5.0]) for _ in range(50)], "one": [3.5], "same": [2.0] * 9, None: [rng.gauss(0, 1) for _ in range(101)]}
    groups["far"] = [1.7e308, -1.7e308, 0.0, 1e-3, 2e-3, 5.0]
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("ties", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"least": 0.0, "q1": 0.25, "mid": 0.5, "p93": 0.93, "most": 1.0}
    found = {r.g: r for r in partials.quantiles(df, ["g"], "v", wanted).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        if g != "far":
            assert np.allclose([found[g][name] for name in wanted], np.quantile(values, list(wanted.values())), rtol=1e-12)
    assert (found["far"].least, found["far"].most) == (-1.7e308, 1.7e308) and abs(found["far"].mid - 1.5e-3) < 1e-15
    assert partials.quantiles(df.where("false"), ["g"], "v", wanted).count() == 0


def test_states_of_slices_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") * 37 % 20_000).cast("double").alias("v"), (F.col("id") % 5000).alias("user"))
    stored = partials.states(df, ["g", "day"], "v", "user")
    for r in partials.estimates(partials.merged(stored, ["g"]), {"q1": 0.25, "mid": 0.5}).collect():
        assert abs(r.n - 6667) <= 1 and abs(r.n_distinct - 5000) <= 200
        assert abs(r.mid - 10_000) <= 400 and abs(r.q1 - 5000) <= 400
    # merging in two steps is merging
    twice = partials.merged(partials.merged(stored, ["g"]).withColumn("all", F.lit(1)), ["all"])
    assert twice.select("n").first().n == 20_000
