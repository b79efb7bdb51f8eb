"""Group effects by within sums: equal to a column for each group, coefficient by coefficient and error by error."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithoscope.functions.tails import t_tail
from lithoscope.operators import panel


def by_hand(p, job, cluster):
    """Least squares with a dummy for each group, and both kinds of errors, on whole matrices."""
    q = p[p["keep"]] if job.where is not None else p
    q = q[[job.response, *job.predictors, "g", "c"]].dropna(subset=[job.response, *job.predictors])
    x = [c for c in job.predictors if q[c].std(ddof=0) > 1e-12]
    z = lambda v: (v - v.mean()) / v.std(ddof=0)
    columns = [np.ones(len(q)), *(z(q[c]) for c in x)]
    if job.absorb:
        g = q["g"].where(q["g"].notna(), "none")
        g = g.where(g.map(g.value_counts()) >= 15, "few")
        columns += [(g == level).astype(float) for level in sorted(set(g))[1:]]
    m, y = np.column_stack(columns).astype(float), z(q[job.response]).to_numpy()
    (n, k), inverse = m.shape, np.linalg.pinv(m.T @ m)
    beta = inverse @ m.T @ y
    e = y - m @ beta
    clusters = q["c"].where(q["c"].notna(), -1).nunique()
    if cluster and clusters >= 20:
        s = pd.DataFrame(m * e[:, None]).groupby(q["c"].where(q["c"].notna(), -1).to_numpy()).sum().to_numpy()
        cov, free = inverse @ s.T @ s @ inverse * clusters / (clusters - 1) * (n - 1) / (n - k), clusters - 1
    else:
        u = e / (1 - np.einsum("ij,jk,ik->i", m, inverse, m))
        cov, free = inverse @ (m.T * u**2) @ m @ inverse, n - k
    se = np.sqrt(np.diag(cov))
    return {c: (beta[i], se[i], t_tail(beta[i] / se[i], float(free)).item(), n, 1 - (e**2).sum() / (y**2).sum()) for i, c in enumerate(x, 1)}


@pytest.mark.parametrize("clusters", [40, 5, None])
def test_equal_to_a_column_for_each_group(spark, clusters):
    random = np.random.default_rng(2)
    n = 900
    g = random.choice(["a", "b", "c", None, *(f"s{i}" for i in range(30))], n, p=[0.4, 0.2, 0.2, 0.05, *[0.005] * 30])
    p = pd.DataFrame({"x1": random.normal(size=n) * 1e4, "x2": random.normal(size=n), "flat": 3.0, "g": g, "c": random.integers(0, clusters or 9, n).astype(float), "keep": random.random(n) < 0.5})
    p.loc[::97, "c"] = np.nan
    p["y1"] = p["x1"] / 1e4 + np.where(p["g"] == "a", 2.0, 0.0) + random.normal(size=n)
    p["y2"] = p["x2"] * 0.3 + p["g"].isna() * 3 + random.normal(size=n) * (1 + p["x2"] ** 2)
    p.loc[::13, "x2"] = np.nan
    p.loc[::17, "y2"] = np.nan
    jobs = [panel.Job(y, tier, x, absorb, where) for y in ("y1", "y2") for tier, x, absorb, where in (
        ("one", ("x1",), False, None), ("two", ("x1", "x2", "flat"), False, None), ("effects", ("x1", "x2"), True, None), ("some", ("x2",), True, F.col("keep")))]
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "x1 double, x2 double, flat double, g string, c double, keep boolean, y1 double, y2 double").withColumns({"job": F.lit(1), "level": F.lit("x"), "n": F.lit(2)})
    got = {}
    for r in panel.tiered_regressions(df, jobs, "g", "c" if clusters else None).collect():
        got.setdefault((r["response"], r["tier"]), {})[r["term"]] = (r["beta"], r["se"], r["p"], r["n"], r["r2"])
        assert r["ci_lo"] < r["beta"] < r["ci_hi"] and r["se_kind"] == ("cluster" if clusters == 40 else "HC3")
    for job in jobs:
        want = by_hand(p, job, clusters)
        assert got[job.response, job.tier].keys() == want.keys()
        for term, values in want.items():
            assert got[job.response, job.tier][term] == pytest.approx(values, rel=1e-6, abs=1e-9)


def test_small_and_constant_jobs_give_no_row(spark):
    df = spark.createDataFrame([(float(i), 1.0, "a") for i in range(21)], "x double, y double, g string")
    jobs = [panel.Job("y", "constant", ("x",)), panel.Job("x", "constant predictor", ("y",)), panel.Job("x", "few", ("x", "y"))]
    assert panel.tiered_regressions(df, jobs, "g").count() == 0 and panel.tiered_regressions(df.limit(0), jobs, "g").count() == 0
    assert panel.t_quantiles([10.0, 1.0]) == pytest.approx({10.0: 2.2281388, 1.0: 12.7062047}, abs=1e-6)


def test_every_row_passes_once_for_all_jobs(spark):
    """Work and shuffle don't grow with the number of jobs: a row is not copied for each; slopes alone read the rows once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = [(float(i), float(i * i % 97), float(i % 13), "abc"[i % 3], i % 30) for i in range(600)]
    df = spark.createDataFrame(rows, "x1 double, y double, x2 double, g string, c int").withColumn("x1", counted.asNondeterministic()("x1"))
    jobs = [panel.Job("y", f"t{k}", ("x1", "x2"), k % 2 == 0) for k in range(40)]
    bare = panel.tiered_regressions(df, jobs, "g", "c", errors=False).collect()
    assert seen.value == 600 and len(bare) == 80 and all(r["se"] is None and r["p"] is None for r in bare)
    full = panel.tiered_regressions(df, jobs, "g", "c").collect()
    assert seen.value == 1800 and [r["beta"] for r in full] == pytest.approx([r["beta"] for r in bare])
    many = panel.tiered_regressions(df, jobs, "g", "c", broadcast_levels=1).collect()  # means joined, not broadcast
    assert [r["se"] for r in many] == pytest.approx([r["se"] for r in full])


def test_sums_of_a_cluster_leave_few_tasks(spark, monkeypatch):
    """Clusters that are spread over all tasks: their sums are wide, so rows are dealt by cluster before they become sums."""
    tasks, own = [], panel.error_parts

    def seen(rows, *others):
        tasks.extend(rows.select("cluster", F.spark_partition_id().alias("p")).groupBy("cluster").agg(F.count_distinct("p").alias("t"), F.count("*").alias("n")).collect())
        return own(rows, *others)

    monkeypatch.setattr(panel, "error_parts", seen)
    df = spark.range(0, 20_000, 1, 16).selectExpr("CAST(id % 101 AS double) AS x", "CAST(id % 89 AS double) AS y", "id % 2500 AS c", "'a' AS g")
    jobs = [panel.Job("z", "one", ("x",)), panel.Job("y", "other", ("x",), True)]
    out = panel.tiered_regressions(df, jobs, "g", "c", values={"z": F.col("y") + F.col("x") / 7}).collect()
    assert len(out) == 2 and all(r["n"] == 20_000 and r["n_clusters"] == 2500 for r in out)
    assert len(tasks) == 2500 and max(r["t"] for r in tasks) <= 4 and sum(r["n"] for r in tasks) == 20_000  # were up to 8
