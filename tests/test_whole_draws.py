"""Bootstraps take three hundred draws; weights are an exact multinomial that any task finds alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import resampling
from lithoscope.plans import modelling, reports


@pytest.mark.parametrize("query", [modelling.cluster_bootstrap, reports.predictor_baselines])
def test_draws(spark, query, monkeypatch):
    asked, draws = [], resampling.bootstrap_sums
    monkeypatch.setattr(resampling, "bootstrap_sums", lambda r, b, c, g, n, *a, **k: asked.append(n) or draws(r, b, c, g, n, *a, **k))
    assert query(spark, "/root/testdata/sf0.001").count() > 0 and asked == [300]


def test_weights_are_a_multinomial():
    whole = resampling.cluster_weights(np.arange(101), 101, 4000, 3)
    assert (whole.sum(0) == 101).all() and abs(whole.mean() - 1) < 1e-12
    assert np.abs(whole.mean(1) - 1).max() < 0.08 and np.abs(whole.var(1) - 100 / 101).max() < 0.15
    correlation = np.corrcoef(whole)
    assert abs(correlation[~np.eye(101, dtype=bool)].mean() + 1 / 100) < 0.002  # as draws of a fixed number are
    some = np.array([77, 3, 100, 0])
    assert (resampling.cluster_weights(some, 101, 4000, 3) == whole[some]).all()
    assert resampling.cluster_weights(np.array([0]), 1, 5).tolist() == [[1] * 5] and resampling.cluster_weights(np.array([], int), 4, 5).shape == (0, 5)


def test_sums_do_not_depend_on_tasks(spark):
    rows = spark.range(200).select((F.col("id") % 40).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("model"), F.col("id").cast("double").alias("n"), F.when(F.col("id") % 5 > 0, 1.0).alias("sy"))
    one, many = ({(r["b"], r["model"]): (r["n"], r["sy"]) for r in resampling.bootstrap_sums(rows.repartition(p), ["model"], ["n", "sy"], 40, 7).collect()} for p in (1, 6))
    assert one == many and len(one) == 21
    weights = resampling.cluster_weights(np.arange(40), 40, 7)
    assert one[2, None] == (sum(weights[i % 40, 2] * i for i in range(0, 200, 3)), sum(weights[i % 40, 2] for i in range(0, 200, 3) if i % 5))
