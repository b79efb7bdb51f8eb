"""Trees from summed histograms: equal to fits of whole tables, vector leaves, the first split by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import boosting as B
from lithoscope.operators import level_trees as L
from lithoscope.operators.resampling import group_folds, pooled_r2


def table(spark, n=300, gaps=0.2):
    random = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x = [None if random.random() < gaps else float(v) for v in random.normal(size=3)]
        y = sum((k + 1) * (v or 0.5) for k, v in enumerate(x)) + 0.1 * random.normal()
        rows.append((i, None if i % 37 == 0 else f"g{i % 11}", *x, None if i % 41 == 0 else y, y * y + (x[0] or 0), "pred", 1))
    return spark.createDataFrame(rows, "id long, g string, a double, b double, c double, y double, z double, pred string, codes int")


def test_boosting_equals_fits_of_whole_tables(spark):
    df = table(spark)
    sets = {"all": ["a", "b", "c"], "one": ["b"]}
    sums = L.boosted_sums(df.repartition(5), ["y", "z"], sets, "g", "id", folds=2, repeats=2, trees=3, most_jobs=9, every=2)
    got = {(r["grp"], r["target"], r["set"], r["repeat"]): (r["n"], r["sy"], r["see"]) for r in sums.collect()}
    cuts = dict(zip("abc", L.quantile_cuts(df, ["a", "b", "c"]), strict=True))
    want = {}
    for repeat in range(2):
        p = group_folds(df, "g", 2, repeat).toPandas()
        for target in "yz":
            q = p[p[target].notna()]
            for name, columns in sets.items():
                for f in range(2):
                    train, held = q[q["fold"] != f], q[q["fold"] == f]
                    model = B.fit_trees(train[columns].to_numpy(float), train[target].to_numpy(), 3, cuts=[cuts[c] for c in columns])
                    error = (held[target] - model.predict(held[columns].to_numpy(float))) ** 2
                    for g, rows in held.groupby(held["g"].where(held["g"].notna(), None), dropna=False):
                        want[g if isinstance(g, str) else None, target, name, repeat] = (len(rows), rows[target].sum(), error[rows.index].sum())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert L.boosted_sums(df.limit(0), ["y"], {"one": ["b"]}, "g", "id", trees=2).count() == 0


@pytest.mark.parametrize("targets, gaps", [(1, 0.0), (2, 0.0), (3, 0.3)])
def test_first_split_of_vectors_is_the_best_one(targets, gaps):
    """Every column, cut and side tried by hand: the score is summed over the targets."""
    random = np.random.default_rng(7)
    for _ in range(15):
        codes = random.integers(0, 6, (50, 3))
        codes[random.random(codes.shape) < gaps] = L.MISSING
        g, w = random.normal(size=(50, targets)), random.integers(1, 3, 50).astype(float)
        count, total = np.zeros((3, 256)), np.zeros((3, 256, targets))
        for j in range(3):
            np.add.at(count[j], codes[:, j], w)
            np.add.at(total[j], codes[:, j], g * w[:, None])
        score = lambda on: ((g[on] * w[on, None]).sum(0) ** 2).sum() / (w[on].sum() + 1.0)  # noqa: B023, E731
        best = 0.0
        for j, code, side in ((j, c, s) for j in (0, 2) for c in range(255) for s in (False, True)):
            left = np.where(codes[:, j] == L.MISSING, side, codes[:, j] <= code)
            if w[left].sum() >= 4 and w[~left].sum() >= 4:
                best = max(best, score(left) + score(~left) - score(np.ones(50, bool)))
        column, code, side, (one, two) = L.best_split(count, total, 4, 1.0, np.array([True, False, True]))
        left = np.where(codes[:, column] == L.MISSING, side, codes[:, column] <= code)
        assert score(left) + score(~left) - score(np.ones(50, bool)) == pytest.approx(best)
        assert one[0] == w[left].sum() and np.allclose(two[1], (g * w[:, None])[~left].sum(0))


def test_one_target_makes_both_forests_equal_and_tasks_do_not_matter(spark):
    df = table(spark, 200)
    one = L.forest_sums(df.repartition(1), ["z"], ["a", "b", "c"], "g", "id", folds=2, trees=4, depth=5)
    rows = {(r["grp"], r["model"]): (r["n"], r["see"]) for r in one.collect()}
    assert {g for g, _ in rows} == {None, *(f"g{i}" for i in range(11))}
    many = {(r["grp"], r["model"]): (r["n"], r["see"]) for r in L.forest_sums(df.repartition(7), ["z"], ["a", "b", "c"], "g", "id", folds=2, trees=4, depth=5).collect()}
    assert rows.keys() == many.keys() and all(rows[k] == pytest.approx(many[k]) for k in rows)


def test_forests_learn(spark):
    df = table(spark, 600, gaps=0.0)
    sums = L.forest_sums(df, ["y", "z"], ["a", "b", "c"], "id", "id", folds=3, trees=12, most_jobs=50)
    r2 = {(r["model"], r["target"]): r["r2"] for r in pooled_r2(sums, ["model", "target"]).collect()}
    assert len(r2) == 4 and r2["joint", "y"] > 0.75 and r2["separate", "y"] > 0.75 and min(r2.values()) > 0.3
    assert sums.agg(F.max("n")).first()[0] == 1 and L.forest_sums(df.limit(0), ["y"], ["a"], "id", "id", trees=2).count() == 0


def test_weights_are_poisson():
    w = L.poisson(np.arange(-50_000, 50_000), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w, L.poisson(np.arange(-50_000, 50_000), 4))[0, 1]) < 0.01
