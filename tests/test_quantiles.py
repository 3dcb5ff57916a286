"""Percentiles by refinement against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import quantiles as Q


@pytest.mark.parametrize("few", [4096, 1])
def test_percentiles_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", 8)
    rng = np.random.default_rng(1)
    groups = {"even": rng.random(300), "far": np.concatenate([[-1e300, 1e300], 2.0 ** rng.integers(-300, 300, 60)]), "ties": np.repeat([3.0, 3.0, 7.0], 40),
              "one": np.array([5.0]), "negative": -np.exp(rng.normal(size=90) * 9), "same": np.full(50, -2.5)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("even", None), ("even", float("nan"))]
    table = spark.createDataFrame(rows, "g string, value double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in Q.quantiles(table, ["g"], probs).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs)
        assert np.allclose(got[g]["q"], np.quantile(xs, probs), rtol=1e-12, atol=0), g


def test_ten_million_different_values_in_one_group(spark):
    n = 10_000_000
    table = spark.range(n).select(((F.col("id") * 7919 % n) / 8).alias("value"))
    q = Q.quantiles(table, [], [0.0, 0.3, 0.5, 0.998, 1.0]).first()
    assert q["n"] == n and np.allclose(q["q"], [p * (n - 1) / 8 for p in (0.0, 0.3, 0.5, 0.998, 1.0)], rtol=1e-12)


def test_no_values(spark):
    assert Q.quantiles(spark.createDataFrame([], "value double"), [], [0.5]).collect() == []
