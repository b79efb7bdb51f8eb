"""Operators against hand-worked values and plain recomputation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.functions import scalars as X
from lithoscope.functions.tails import chi2_tail, t_tail
from lithoscope.operators import cohort, models, ranking, resampling, spectra, stats, structure


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tails():
    assert abs(t_tail(2, 10) - 0.073388) < 1e-6 and t_tail(0, 5) == 1 and np.isnan(t_tail(np.nan, 5))
    assert abs(chi2_tail(7.81, 3) - 0.050106) < 1e-6 and chi2_tail(0, 2) == 1
    assert abs(t_tail(1.959964, 1e7) - 0.05) < 1e-5


def test_scalars(spark):
    floats = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.x for r in floats.select(X.clean_float(F.col("x")).alias("x")).collect()] == [1.0, None, None, None]
    assert one(spark, X.median_of(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(10.0)))) == 2.5
    assert one(spark, X.median_of(F.array().cast("array<double>"))) is None
    assert abs(one(spark, X.entropy_of(F.array(*[F.lit(1.0)] * 4))) - math.log(4)) < 1e-12
    assert one(spark, X.entropy_of(F.array().cast("array<double>"))) == 0
    assert [one(spark, X.parse_bool(F.lit(v))) for v in ("TRUE", "0", " 1.0 ", "maybe", None)] == [True, False, True, True, True]
    assert [one(spark, X.failure_category(F.lit(v))) for v in ("x symmetry_failed", "", "boom")] == ["symmetry_failed", "no_atoms", "other"]
    assert one(spark, X.transform(F.lit(-1.0), "log")) is None and one(spark, X.transform(F.lit(-1.0), "log1")) == 0


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = {"hot": rng.integers(0, 50, 4000).astype(float), "one": np.array([7.0]), "real": rng.normal(size=700)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {(r.k, r.v): r.rank for r in ranking.average_ranks(df, ["k"], "v", blocks=8).collect()}
    for k, vs in values.items():
        for v in set(vs):
            assert got[k, v] == (vs < v).sum() + ((vs == v).sum() + 1) / 2
    assert got[None, 1.0] == 1
    q = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}, blocks=8).collect()}
    for k, vs in values.items():
        assert np.allclose([q[k].a, q[k].m, q[k].z], np.quantile(vs, [0.1, 0.5, 1.0])) and q[k].n == len(vs)
    assert ranking.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def points(x, y):
    return F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(x, y)))


def test_spectrum_statistics(spark):
    assert one(spark, spectra.rolling_min(F.array(*map(F.lit, (3.0, 1.0, 2.0, 5.0, 4.0))), F.lit(1))) == [1, 1, 1, 2, 4]
    near = lambda a, b: abs(a - b) < 1e-9
    assert near(one(spark, spectra.wasserstein(points([200], [3]), points([350], [1]))), 150)
    u = points([1, 2, 4], [1, 0, 2])
    assert near(one(spark, spectra.wasserstein(u, u)), 0) and near(one(spark, spectra.wasserstein(u, points([3, 4, 6], [2, 0, 4]))), 2)
    assert one(spark, spectra.wasserstein(u, points([1], [0]))) is None
    assert one(spark, spectra.spacing_median(points([1, 1, 2, 5], [0] * 4))) == 2 and one(spark, spectra.spacing_median(points([1], [0]))) is None
    assert [p.x for p in one(spark, spectra.local_maxima(points([1, 2, 3, 4, 5], [0, 2, 1, 1, 5])))] == [2]
    assert one(spark, spectra.local_maxima(points([1, 2], [0, 2]))) == []
    flat = spark.range(1).select(points([1, 2], [0, 0]).alias("corrected"))
    r = spectra.moments(flat).first()
    assert (r.total, r.centroid, r.skewness) == (0, None, None)
    assert spectra.moments(spark.range(1).select(points([5], [2]).alias("corrected"))).first().centroid == 5


def test_peaks_of_known_spectra(spark):
    x = np.arange(100, 1301, 1.0)
    gauss = lambda c, w, h: h * np.exp(-4 * math.log(2) * ((x - c) / w) ** 2)
    shapes = {"one": gauss(500, 20, 100), "two": gauss(400, 10, 100) + gauss(700, 20, 50) + gauss(1200, 30, 80), "flat": np.full(len(x), 3.0)}
    rows = [(k, [float(v) for v in x], [float(v) for v in y]) for k, y in shapes.items()] + [("short", [1.0] * 19, [1.0] * 19), ("outside", [float(i) for i in range(50)], [1.0] * 50)]
    df = spark.createDataFrame(rows, "name string, x array<double>, y array<double>").select("name", spectra.sorted_points(F.col("x"), F.col("y")).alias("points"))
    got = {r.name: r for r in spectra.peak_features(df).collect()}
    assert (got["one"].n_peak, got["one"].s_peak, got["one"].error) == (1, 0, "") and abs(got["one"].gamma - 20) < 1.5
    assert got["one"].peak_positions_cm1 == "500.00" and got["one"].domega_median is None
    assert (got["two"].n_peak, got["two"].n_low, got["two"].n_mid, got["two"].n_high) == (3, 0, 1, 2) and got["two"].domega_median == 400
    assert got["two"].r_overlap == got["two"].gamma / 400 and got["one"].n_low == 0 and got["one"].s_low == 0
    assert {k: got[k].error for k in ("flat", "short", "outside")} == {"flat": "flat_spectrum", "short": "too_few_points", "outside": "window_too_short"}
    assert got["flat"].n_peak is None and not got["flat"].raman_ok
    y = np.array([0, 1, 1, 1, 0, 2, 0, 3, 3, 0.0])
    assert spectra.plateau_maxima(y).tolist() == [2, 5, 7] and spectra.prominence(y, 5)[0] == 2 and spectra.prominence(y, 2)[0] == 1
    cubic = np.arange(30.0) ** 3
    assert np.allclose(spectra.smooth(cubic, 7), cubic)
    grid = spark.range(1).select(F.explode(F.array(F.lit(2))).alias("k"))
    assert spectra.peak_features(df.crossJoin(grid), settings=spectra.SETTINGS).count() == 4 * len(rows)


def test_funnel_and_levels(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (4, "x")], "a int, g string")
    steps = [("a >= 2", F.col("a") >= 2), ("g = x", F.col("g") == "x")]
    assert [(r.step, r.n) for r in cohort.funnel(df, steps).orderBy("step_no").collect()] == [("All samples", 4), ("a >= 2", 2), ("g = x", 1)]
    assert cohort.passing(df, steps).count() == 1 and [r.n for r in cohort.funnel(df.limit(0), steps).collect()] == [0, 0, 0]
    assert sorted((r.g or "", r.pooled) for r in cohort.pool_rare(df, "g", 2, "few", "pooled").collect()) == [("", "few"), ("x", "x"), ("x", "x"), ("y", "few")]
    bins = cohort.quantile_bins(spark.createDataFrame([(v,) for v in [1.0] * 8 + [2.0, 3.0, None]], "x double"), "x", 4)
    assert {(r.x, r.bin) for r in bins.collect()} == {(1.0, 0), (2.0, 0), (3.0, 0), (None, None)}  # the lower edges are equal
    even = cohort.quantile_bins(spark.createDataFrame([(float(v),) for v in range(9)], "x double"), "x", 4)
    assert [r.bin for r in even.orderBy("x").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 200
    x, z = rng.normal(size=n), rng.integers(0, 6, n).astype(float)
    y = x + z + rng.normal(size=n)
    rows = [(float(a), None if i % 17 == 0 else float(b), float(c), 1.0) for i, (a, b, c) in enumerate(zip(x, y, z))]
    df = spark.createDataFrame(rows, "x double, y double, z double, c double")
    ok = np.array([i % 17 != 0 for i in range(n)])
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    rx, ry, rz = (ranks(v[ok]) for v in (x, y, z))
    got = stats.rank_correlations(df, ["x", "c"], ["y"]).collect()
    plain = {r.feature: r for r in got}
    assert abs(plain["x"].rho - np.corrcoef(rx, ry)[0, 1]) < 1e-9 and plain["x"].n == ok.sum() and plain["c"].rho is None
    design = np.column_stack([np.ones(ok.sum()), rz])
    rest = lambda r: r - design @ np.linalg.lstsq(design, r, rcond=None)[0]
    partial = stats.rank_correlations(df, ["x"], ["y"], ("z",)).first()
    assert abs(partial.rho - np.corrcoef(rest(rx), rest(ry))[0, 1]) < 1e-9
    assert stats.rank_correlations(df.limit(8), ["x"], ["y"]).first().rho is None


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, x = 120, rng.normal(size=(120, 2))
    y, g = 1 + x @ [2.0, -1.0] + rng.normal(size=n), rng.integers(0, 25, n)
    df = spark.createDataFrame([(*map(float, r), float(v), int(c)) for r, v, c in zip(x, y, g)], "a double, b double, y double, g int")
    d = np.column_stack([np.ones(n), x])
    inverse = np.linalg.inv(d.T @ d)
    beta = inverse @ d.T @ y
    e = y - d @ beta
    scores = np.array([d[g == c].T @ e[g == c] for c in np.unique(g)])
    m = len(scores)
    cluster = np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse) * m / (m - 1) * (n - 1) / (n - 3))
    u = e / (1 - np.einsum("ij,jk,ik->i", d, inverse, d))
    hc3 = np.sqrt(np.diag(inverse @ (d.T * u**2) @ d @ inverse))
    rows = stats.ols(df, "y", ["a", "b"], "g")
    assert np.allclose([r["beta"] for r in rows], beta) and np.allclose([r["se"] for r in rows], cluster) and rows[0]["se_kind"] == "cluster"
    assert np.allclose([r["se"] for r in stats.ols(df, "y", ["a", "b"])], hc3)
    assert abs(rows[0]["r2"] - (1 - e @ e / ((y - y.mean()) @ (y - y.mean())))) < 1e-9
    r = np.corrcoef(x.T)[0, 1]
    assert np.allclose(list(stats.variance_inflation(df, ["a", "b"]).values()), 1 / (1 - r * r))


def test_folds_and_bootstrap(spark):
    df = spark.createDataFrame([(i, min(i // 3, 40), float(i % 7), float(i % 5)) for i in range(300)], "id int, g int, y double, p double")
    folded = resampling.group_folds(df, "g", 4)
    per = folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0]
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert per == 1 and sum(sizes) == 300 and len(sizes) == 4
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, resampling.group_folds(df.repartition(9), "g", 4).collect()))
    sums = resampling.group_sums(df, "g", {"m": "p"}, "y")
    groups = resampling.numbered(sums.select("g").withColumnRenamed("g", "name"), "name")
    assert sorted(r.g for r in groups.collect()) == list(range(41))
    draws = resampling.cluster_weights(np.arange(41), 41, 30)
    assert (draws.sum(0) == 41).all()
    unit = sums.select("g").distinct().select(F.lit(0).alias("b"), "g", F.lit(1).alias("w"))
    pooled = resampling.pooled_r2(sums, ["model"]).first().r2
    assert abs(resampling.bootstrap_r2(sums, unit).first().r2 - pooled) < 1e-12
    moved = resampling.permute(df, ["p", "y"], ["id"], block=50).collect()
    assert sorted((r.p, r.y) for r in moved) == sorted((r.permuted_p, r.permuted_y) for r in moved) and any(r.p != r.permuted_p for r in moved)


def test_linear_models(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(i % 4, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "fold int, a double, b double, c double, y double")
    matrices = models.fold_matrices(df, ["a", "b", "c", "y"])
    train = sum(m for f, m in matrices.items() if f)
    keep = np.arange(200) % 4 != 0
    d = np.column_stack([np.ones(keep.sum()), x[keep]])
    beta = models.ols_coefficients(train, 3)
    assert np.allclose(beta, np.linalg.lstsq(d, y[keep], rcond=None)[0])
    held = np.column_stack([np.ones((~keep).sum()), x[~keep]])
    assert abs(models.error_sum(matrices[0], beta, 4) - ((y[~keep] - held @ beta) ** 2).sum()) < 1e-6
    total = sum(matrices.values())
    mean, sd, c, xy = models.standardised(total, 3)
    b = models.lasso_path(c, xy[:, 0], np.array([0.3]))[0]
    gradient = xy[:, 0] - c @ b
    assert all(abs(g - 0.3 * np.sign(w)) < 1e-6 if w else abs(g) <= 0.3 + 1e-6 for g, w in zip(gradient, b)) and b[2] == 0
    full = models.pls_coefficients(c, xy, 3)[-1][:, 0]
    assert np.allclose(models.raw_coefficients(full, mean, sd, mean[4]), models.ols_coefficients(total, 3))
    assert models.pls_q2(matrices, 3, 1, 3)[-1] > 0.95
    predicted = models.out_of_fold(df, ["a", "b", "c"], {f: beta for f in matrices}).filter("fold = 0").select("pred").collect()
    assert np.allclose(sorted(r.pred for r in predicted), sorted(held @ beta))


def test_preparation_and_neighbours(spark):
    df = spark.createDataFrame([(1.0, None, None), (3.0, 5.0, 1.0), (None, None, None), (2.0, 7.0, 2.0)], "a double, b double, c double")
    fitted = models.fit_preparation(df, ["a", "b", "c"])
    assert fitted == {"medians": {"a": 2.0, "b": 6.0, "c": 1.5}, "flags": ["a", "b"]}
    assert sorted(map(tuple, models.prepare(df, fitted).collect()))[0] == (1.0, 6.0, 1.5, 0.0, 1.0)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 4))
    rows = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = models.nearest(rows.filter("id < 10"), rows, 3, block=16).collect()
    for q in range(10):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        assert sorted(r.neighbour for r in got if r.query == q) == sorted(np.argsort(d)[:3])


def test_structures(spark):
    site = lambda *o: F.create_map(*(x for k, v in o for x in (F.lit(k), F.lit(v))))
    r = one(spark, structure.disorder(F.array(site(("Fe", 1.0)), site(("Fe", 0.5), ("Mg", 0.5)), site(("O", 0.8)))))
    expected = (math.log(2) - 0.8 * math.log(0.8) - 0.2 * math.log(0.2)) / 3
    assert (r.is_ordered, r.n_disordered_sites) == (False, 2) and abs(r.mixing_entropy - expected) < 1e-12
    assert one(spark, structure.majority_species(site(("Mg", 0.5), ("Fe", 0.5)))) == "Fe"
    assert one(spark, structure.formula_units(site(("Si", 4), ("O", 8), ("Mg", 12)))) == 4
    assert one(spark, structure.formula_units(F.create_map().cast("map<string,int>"))) is None
    same = structure.environments([[[1.0, 0.0]] * 3], [["A"] * 3])
    assert same.n_env[0] == 1 and same.dispersion[0] == 0 and same.separations[0] == []
    unit = np.eye(3, dtype=np.int64)
    assert structure.vibration_counts(np.array([unit]), np.array([4]))[:4] == (9, 9, 9, 9)
    assert structure.vibration_counts(np.array([unit, -unit]), np.array([2, 2]))[2:5] == (0, 3, 0)
    three = np.array([[[0, 0, 1], [1, 0, 0], [0, 1, 0]]])
    cyclic = np.array([unit, three[0], three[0] @ three[0]])
    total, distinct, raman, *_ = structure.vibration_counts(cyclic, np.array([2, 2, 2]))
    assert (total, distinct, raman) == (3, 2, 2)  # one mode along the axis, a conjugate pair across it
    with pytest.raises(ValueError):
        structure.vibration_counts(np.array([unit, three[0]]), np.array([2, 2]))
    cell = F.array(*(F.array(*(F.lit(4.0 if i == j else 0.0) for j in range(3))) for i in range(3)))
    ops = F.array(F.struct(F.array(*(F.array(*(F.lit(-1 if i == j else 0) for j in range(3))) for i in range(3))).alias("r"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("t")))
    atoms = F.array(F.array(*map(F.lit, (0.0, 0.0, 0.0))), F.array(*map(F.lit, (0.5, 0.5, 0.52))), F.array(*map(F.lit, (0.5, 0.5, 0.53))), F.array(*map(F.lit, (0.1, 0.0, 0.0))))
    assert one(spark, structure.fixed_atoms(ops, atoms, cell)) == [2]
    sites = spark.createDataFrame([("s", [(0, [0.0, 0.0, 0.0])])], "k string, sites array<struct<i int, xyz array<double>>>")
    assert structure.neighbours(sites, "k", 4.5, cell).count() == 6 and structure.neighbours(sites, "k", 4.5).count() == 0
    edges = spark.createDataFrame([("s", 0, j, 1.6) for j in (1, 2, 3, 4)] + [("s", 0, 5, 2.4)], "k string, i int, j int, d double")
    tetra = spark.createDataFrame([("s", 0, "Si", 1.9, 28.0, 1.11), *(("s", j, "O", 3.44, 16.0, 0.66) for j in range(1, 6))], "k string, i int, symbol string, chi double, mass double, radius double")
    r = structure.bond_statistics(edges, tetra, "k").first()
    assert (r.n_bonds, r.mean_cn, r.n_anion_group_types, r.anion_group_o_fraction, r.polymerization_index, r.cv_bond) == (4, 4, 1, 0.8, 0, 0)


def test_formulas():
    from lithoscope.functions.chemistry import formula_amounts as amounts

    assert amounts("CaSO_4_·2H_2_O") == {"Ca": 1, "S": 1, "O": 6, "H": 4} and amounts("Fe^2+^S; pyrrhotite") == {"Fe": 1, "S": 1}
    assert amounts("2(Mg0.5Fe1.5)2[SiO4] Â· 0.5 H2O") == {"Mg": 2, "Fe": 6, "Si": 2, "O": 8.5, "H": 1}
    assert amounts("Ca1_0Si") == {"Ca": 10, "Si": 1} and amounts("·NaCl·") == {"Na": 1, "Cl": 1} and amounts("Si0.5 O") == {"Si": 0.5, "O": 1}
    assert all(amounts(x) is None for x in (None, "", ";x", "Si(O2", "SiO2)", "(2H2O)", "Xx", "Si 2 3", "2", "Na+", "2·H2O", "()2", "[Na)x"))


def test_formula_units_and_images(spark):
    from lithoscope.operators import structure

    rows = [({"Ca": 6, "O": 9},), ({"H": 2**40, "O": 3 * 2**30},), ({"Si": 7},), ({},), ({"A": 0, "B": 4},)]
    df = spark.createDataFrame(rows, "c map<string,long>")
    assert [r[0] for r in df.select(structure.formula_units(F.col("c"))).collect()] == [3, 2**30, 7, None, 4]
    cell = [[2.0, 0.0, 0.0], [0.5, 3.0, 0.0], [0.0, 0.3, 9.0]]
    sites = [(0, [0.1, 0.1, 0.1]), (1, [2.2, 2.8, 8.5])]
    df = spark.createDataFrame([("a", sites, cell)], "k string, sites array<struct<i int, xyz array<double>>>, cell array<array<double>>")
    got = sorted((r.i, r.j, round(r.d, 6)) for r in structure.neighbours(df, "k", 6.0, F.array(*(F.array(*(F.lit(x) for x in v)) for v in cell))).collect())
    want, vectors = [], np.array(cell)
    for i, a in sites:
        for j, b in sites:
            for s in np.ndindex(15, 15, 15):
                d = float(np.linalg.norm(np.array(b) + (np.array(s) - 7) @ vectors - np.array(a)))
                want += [(i, j, round(d, 6))] if 1e-8 < d <= 6.0 else []
    assert got == sorted(want)
    with pytest.raises(ValueError):
        structure.with_element_data(spark.range(1).selectExpr("'A' AS symbol"), spark.range(201).selectExpr("concat('E', id) AS symbol", "1.0 AS chi", "1.0 AS mass", "1.0 AS radius"))


def test_kruskal_reads_the_rows_once(spark):
    """The rows are counted once by (pair, level, value); what follows reads the counts."""
    from lithoscope.operators import stats

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.range(300).select((F.col("id") % 3).alias("f"), counted.asNondeterministic()((F.col("id") % 7).cast("double")).alias("t"))
    got = stats.kruskal(df, ["f"], ["t"]).collect()
    assert seen.value == 300 and got[0]["n"] == 300 and got[0]["k_levels"] == 3
