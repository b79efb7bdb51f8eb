import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor

from lithoscope.operators import models


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    out = pd.DataFrame({"id": range(600), "a": rng.normal(size=600), "b": rng.normal(size=600), "c": rng.normal(size=600)})
    out["y"] = np.sign(out["a"]) * 2 + out["b"] + rng.normal(size=600) / 10
    out.loc[::9, "c"] = np.nan
    out["fold"] = out["id"] % 3
    return out


def table(spark, frame):
    """The frame with nulls for NaN."""
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, a double, b double, c double, y double, fold long")


def skill(df):
    got = df.toPandas()
    assert len(got) == 600 and got["pred"].notna().all() and sorted(got["id"]) == list(range(600))
    return 1 - ((got["y"] - got["pred"]) ** 2).sum() / ((got["y"] - got["y"].mean()) ** 2).sum()


def test_small_forests_grow_in_tasks(spark, frame, monkeypatch):
    df = table(spark, frame)
    passed = skill(models.forest_out_of_fold(df, "y", ["a", "b", "c"], trees=10, depth=8, max_rows=0))
    monkeypatch.setattr(RandomForestRegressor, "fit", None)  # a job a level
    own = models.forest_out_of_fold(df, "y", ["a", "b", "c"], trees=10, depth=8, key="id")
    assert skill(own) > 0.9 and skill(own) > passed - 0.03
    again = models.forest_out_of_fold(df.repartition(7), "y", ["a", "b", "c"], trees=10, depth=8, key="id")
    assert np.isclose(skill(again), skill(own), rtol=1e-12)  # draws follow from the key


def test_filled_as_prepared(spark, frame):
    columns, train = ["a", "b", "c"], (frame["fold"] != 0).to_numpy()
    own = models.filled(frame[columns].to_numpy(), train)
    df = table(spark, frame)
    fitted = models.fit_preparation(df.filter("fold <> 0"), columns)
    want = models.prepare(df, fitted).orderBy("id").select(*columns, *(f"NA_{c}" for c in fitted["flags"])).toPandas()
    assert own.shape == want.shape and np.allclose(own, want.to_numpy())


def by_hand(x, y, drawn, held, depth, leaf):
    """The tree of all columns, a node at a time, on rows that are repeated."""
    own, best = y[drawn], (0.0,)
    if depth and len(drawn) >= 2 * leaf and own.min() < own.max():
        for j in range(x.shape[0]):
            order = np.argsort(x[j, drawn], kind="stable")
            v, left = x[j, drawn][order], np.cumsum((own - own.mean())[order])
            for i in range(leaf - 1, len(drawn) - leaf):
                gain = left[i] ** 2 * (1 / (i + 1) + 1 / (len(drawn) - i - 1))
                if v[i] < v[i + 1] and gain > best[0] + 1e-9:
                    best = (gain, j, (v[i] + v[i + 1]) / 2)
    if not best[0]:
        return dict.fromkeys(held.tolist(), own.mean())
    _, j, middle = best
    parts = [by_hand(x, y, drawn[side(x[j, drawn], middle)], held[side(x[j, held], middle)], depth - 1, leaf) for side in (np.less_equal, np.greater)]
    return parts[0] | parts[1]


@pytest.mark.parametrize("depth, leaf", [(0, 3), (3, 3), (30, 15)])  # columns tie in small nodes
def test_levels_of_all_nodes_equal_a_node_at_a_time(depth, leaf):
    rng = np.random.default_rng(depth)
    x = np.stack([rng.normal(size=400), rng.integers(0, 5, 400), rng.normal(size=400).round(1)])
    y = x[0] + (x[1] > 2) + rng.normal(size=400)
    held, fit = np.arange(0, 400, 5), np.flatnonzero(np.arange(400) % 5)
    weight = np.zeros(400)
    weight[fit] = rng.poisson(1.0, len(fit))
    orders = [fit[np.argsort(v[fit], kind="stable")] for v in x]
    got = models.grown_predictions(x, y, weight, orders, held, rng, depth, leaf, 1.0)
    want = by_hand(x, y, np.repeat(np.arange(400), weight.astype(int)), held, depth, leaf)
    assert np.allclose(got, [want[i] for i in held.tolist()])


def test_forests_of_more_rows_grow_in_tasks_too(spark, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "fit", None)  # did not end in time on 102,564 rows
    df = spark.range(100_001).selectExpr("id", "id % 3 AS fold", "CAST(hash(id) AS double) AS a", "CAST(hash(id) > 0 AS double) AS y")
    got = models.forest_out_of_fold(df, "y", ["a"], trees=2, depth=2, key="id").selectExpr("count(pred) AS n", "avg(abs(pred - y)) AS wrong").first()
    assert got["n"] == 100_001 and got["wrong"] < 0.01
