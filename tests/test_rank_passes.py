import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import stats


def plain(frame, a, b, covariates=()):
    """(rho, n) from ranks of the complete rows, the covariates taken out by least squares on their ranks."""
    ranks = frame[[a, b, *covariates]].dropna().rank()
    x = np.column_stack([np.ones(len(ranks)), *(ranks[c] for c in covariates)])
    left = [ranks[c] - x @ np.linalg.lstsq(x, ranks[c], rcond=None)[0] for c in (a, b)]
    return np.corrcoef(*left)[0, 1], len(ranks)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    out = pd.DataFrame({"x": rng.integers(0, 9, 500).astype(float), "y": rng.normal(size=500), "z": rng.normal(size=500).round(1), "w": rng.normal(size=500)})
    out["y"] += out["x"] / 3
    out.loc[::7, "x"] = np.nan
    out.loc[::11, "z"] = np.nan
    return out


@pytest.mark.parametrize("shared", [0, 1_000_000])
@pytest.mark.parametrize("covariates", [(), ("w",), ("w", "z")])
def test_subsets(spark, frame, covariates, shared):
    df = spark.createDataFrame(frame)
    limits = {"all": F.lit(True), "low": F.col("y") < 1, "none": F.col("y") > 1e9}
    got = {(r.subset, r.feature): (r.rho, r.n) for r in stats.rank_correlations(df, ["x"] if covariates else ["x", "z"], ["y"], covariates, subsets=limits, shared=shared).collect()}
    assert len(got) == (2 if covariates else 4)  # a subset without rows has no pairs
    for (subset, feature), (rho, n) in got.items():
        want, m = plain(frame if subset == "all" else frame[frame["y"] < 1], feature, "y", covariates)
        assert n == m and math.isclose(rho, want, abs_tol=1e-9)


def test_rows_are_read_twice(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = spark.createDataFrame(frame).mapInPandas(count, "x double, y double, z double, w double")
    limits = {f"y>={v}": F.col("y") >= v for v in (-1, 0, 1)}
    assert stats.rank_correlations(df, ["x", "z"], ["y", "w"], subsets=limits).count() == 12
    assert seen.value == 2 * len(frame)
