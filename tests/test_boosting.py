"""Boosted trees: splits, missing values, and the grid against the same fits made one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import boosting as B
from lithoscope.operators.resampling import group_folds


def best_by_hand(x, y, leaf, l2):
    """The best first split by trying every value and both sides for missing ones."""
    score, best = lambda v: v.sum() ** 2 / (len(v) + l2), (0.0, None)
    for j in range(x.shape[1]):
        for cut in [*np.unique(x[~np.isnan(x[:, j]), j]), np.inf]:
            for missing_left in (False, True):
                left = np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= cut)
                if min(left.sum(), (~left).sum()) >= leaf:
                    best = max(best, (score(y[left]) + score(y[~left]) - score(y), tuple(left)), key=lambda b: b[0])
    return best


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_first_split_is_the_best_one(gaps):
    random = np.random.default_rng(3)
    for _ in range(20):
        x = random.integers(0, 9, (60, 3)).astype(float)
        x[random.random(x.shape) < gaps] = np.nan
        y = random.normal(size=60) + np.where(np.isnan(x[:, 0]), 1.0, x[:, 1] > 4)
        model = B.fit_trees(x, y, trees=1, rate=1.0, depth=1, leaf=5)
        gain, left = best_by_hand(x, y - y.mean(), 5, 1.0)
        got = model.predict(x)
        side = got == got[np.flatnonzero(left)[0]]
        r = y - y.mean()
        made = sum(r[s].sum() ** 2 / (s.sum() + 1.0) for s in (side, ~side)) - r.sum() ** 2 / 61
        assert made == pytest.approx(gain)


def test_degenerate_inputs():
    flat = B.fit_trees(np.full((40, 2), np.nan), np.arange(40.0), trees=3)
    assert np.allclose(flat.predict(np.zeros((2, 2))), 19.5) and len(flat.predict(np.zeros((0, 2)))) == 0
    one = B.fit_trees(np.zeros((1, 1)), np.array([2.0]), trees=2)
    assert np.allclose(one.predict(np.array([[5.0], [np.nan]])), 2.0)
    x = np.linspace(0, 1, 400)[:, None]
    # the first 15 rows share a leaf, over which the sine rises by 6 * 14 / 399: half of that is the least error
    assert np.abs(B.fit_trees(x, np.sin(6 * x[:, 0])).predict(x) - np.sin(6 * x[:, 0])).max() < 0.12


def test_grid_equals_separate_fits(spark):
    random = np.random.default_rng(5)
    rows = [(i, None if i % 37 == 0 else f"g{i % 11}", *(None if random.random() < 0.2 else float(v) for v in random.normal(size=3)), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, y double, grp double")
    sums = B.tree_grid(df, ["y"], {"both": ["a", "b"], "one": ["b"]}, "g", "id", folds=3, repeats=2, trees=4)
    got = {(r["grp"], r["set"], r["repeat"]): (r["n"], r["see"]) for r in sums.collect()}
    want = {}
    for repeat in range(2):
        p = group_folds(df, "g", 3, repeat).withColumn("k", F.xxhash64("id", F.lit(0))).orderBy("k").toPandas()
        p = p[p["y"].notna()]
        for name, columns in {"both": ["a", "b"], "one": ["b"]}.items():
            for f in range(3):
                train, held = p[p["fold"] != f], p[p["fold"] == f]
                model = B.fit_trees(train[columns].to_numpy(float), train["y"].to_numpy(), 4)
                error = (held["y"] - model.predict(held[columns].to_numpy(float))) ** 2
                for g, e in error.groupby(held["g"].where(held["g"].notna(), None), dropna=False):
                    want[g if isinstance(g, str) else None, name, repeat] = (len(e), e.sum())
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and got[k][1] == pytest.approx(e) for k, (n, e) in want.items())
    scores = B.grid_scores(sums, B.grid_draws(sums, 20)).collect()
    assert len(scores) == 2 and all(s["ci_lo"] <= s["ci_hi"] for s in scores)
    assert B.tree_grid(df.limit(0), ["y"], {"one": ["b"]}, "g", "id", trees=2).count() == 0


def test_targets_that_differ_by_fold(spark):
    """The model of a fold learns and is judged by that fold's own target, on given folds."""
    random = np.random.default_rng(8)
    rows = [(i, i % 2, *map(float, random.normal(size=2)), float(random.normal()), float(random.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, part int, a double, b double, t0 double, t1 double")
    got = {(r["grp"], r["target"]): (r["n"], r["see"]) for r in B.tree_grid(df, ["t0", "t1"], {"all": ["a", "b"]}, "part", "id", folds=2, trees=3, target_of_fold=["t0", "t1"], fold_column="part").collect()}
    p = df.withColumn("k", F.xxhash64("id", F.lit(0))).orderBy("k").toPandas()
    want = {}
    for f in range(2):
        train, held = p[p["part"] != f], p[p["part"] == f]
        model = B.fit_trees(train[["a", "b"]].to_numpy(), train[f"t{f}"].to_numpy(), 3)
        want[f, f"t{f}"] = (60, pytest.approx(((held[f"t{f}"] - model.predict(held[["a", "b"]].to_numpy())) ** 2).sum()))
    assert got == want
    grown = B.tree_grid(df, ["t0", "t1"], {"all": ["a", "b"]}, "part", "id", folds=2, trees=2, max_rows=10, target_of_fold=["t0", "t1"], fold_column="part")
    assert sorted((r["grp"], r["target"], r["n"]) for r in grown.collect()) == [(0, "t0", 60), (1, "t1", 60)]
