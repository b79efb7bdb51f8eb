"""Validation and model queries: lines of orders clustered by supplier, and embeddings as descriptors of a mineral."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import level_trees as V
from ..operators import models as L
from ..operators import resampling as R
from ..operators import spectra as S
from ..operators.stats import as_matrix, product_sums, rank_correlations
from ..session import cut
from .tables import rounded, spectra, table

FEATURES = [f"f{i}" for i in range(8)]


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with two predictions of the price: the mean of the part's type, and the part's own price times quantity."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", F.col("l_extendedprice").alias("y")).join(part, "l_partkey")
    means = lines.groupBy("p_type").agg(F.avg("y").alias("type_mean"))
    return lines.join(means, "p_type").withColumn("own_price", F.col("p_retailprice") * F.col("l_quantity"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, f0..f7, y): y depends on three descriptors and on a value that no model sees."""
    e = lambda i: F.try_element_at("embedding", F.lit(i + 1)).cast("double")
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(e(i).alias(f"f{i}") for i in range(8)), (2 * e(0) - e(1) + 0.5 * e(2) + e(20)).alias("y"))
    return df.na.drop()


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers dealt to five folds: groups and rows of each."""
    df = R.group_folds(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey")
    per = df.groupBy("fold", "l_suppkey").agg(F.count("*").alias("n"))
    return per.groupBy("fold").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def _weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sums per supplier, and twenty draws whose weights follow from the numbers of draw and supplier, for SQL to have them too."""
    sums = R.group_sums(_predicted(spark, sf_dir), "l_suppkey", {"type_mean": "type_mean", "own_price": "own_price"}, "y").withColumnRenamed("l_suppkey", "g")
    draws = sums.select("g").distinct().select("g", F.explode(F.expr("sequence(0L, 19L)")).alias("b")).withColumn("w", F.pmod(F.col("b") * 7 + F.col("g") * 13, F.lit(4)))
    return sums, draws


def bootstrap_r2_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = R.bootstrap_r2(*_weighted(spark, sf_dir))
    return rounded(R.intervals(boot, ["model"]))


def paired_delta_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.paired_differences(R.bootstrap_r2(*_weighted(spark, sf_dir)), "type_mean", ["own_price"]))


def pooled_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.pooled_r2(_weighted(spark, sf_dir)[0], ["model"]))


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred random draws of suppliers."""
    sums = R.group_sums(_predicted(spark, sf_dir), "l_suppkey", {"type_mean": "type_mean", "own_price": "own_price"}, "y")
    groups = R.numbered(sums.select("l_suppkey").distinct(), "l_suppkey")
    boot = R.cluster_bootstrap(sums.join(groups, "l_suppkey"), groups.count(), 300)
    return rounded(R.pooled_r2(sums, ["model"]).join(R.intervals(boot, ["model"]), "model"))


def oof_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part type predicted by the mean price of all others: sums per type, and totals less a type's own."""
    per = _predicted(spark, sf_dir).groupBy("p_type").agg(F.count("*").alias("n_test"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    total = per.agg(F.sum("n_test").alias("n_all"), F.sum("s").alias("s_all"))
    df = per.crossJoin(F.broadcast(total)).withColumn("n_train", F.col("n_all") - F.col("n_test")).withColumn("mean", F.try_divide(F.col("s_all") - F.col("s"), "n_train"))  # one row
    sse = F.col("ss") - 2 * F.col("mean") * F.col("s") + F.col("n_test") * F.col("mean") * F.col("mean")
    return rounded(df.select("p_type", "n_test", "n_train", F.col("mean").alias("train_mean"), F.sqrt(F.try_divide(sse, "n_test")).alias("rmse")), 4)


def lofo_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one label out: skill against the training mean, from one matrix of products per label."""
    matrices, k = L.fold_matrices(_vectors(spark, sf_dir), [*FEATURES, "y"], "label"), len(FEATURES)
    total, rows = sum(matrices.values()), []
    for label, held in sorted(matrices.items(), key=lambda m: str(m[0])):
        train = total - held
        base = L.error_sum(held, np.array([train[0, k + 1] / train[0, 0]]), k + 1)
        error = L.error_sum(held, L.ols_coefficients(train, k), k + 1)
        rows.append((str(label), int(train[0, 0]), int(held[0, 0]), float(1 - error / base) if base > 0 else None))
    return spark.createDataFrame(rows, "held_out string, n_train long, n_test long, skill double")


def _left_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = _folded(spark, sf_dir).withColumn("y2", F.col("f3") - F.col("f0") * F.col("f1"))
    return L.leave_one_family_out(df, {"core": FEATURES[:3], "all": FEATURES}, ["y", "y2"], "label", "fold")


def lofo_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label left out, for two sets of descriptors and two targets: skill, R2 and rank correlation."""
    return rounded(_left_out(spark, sf_dir)[0])


def lofo_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled skill and R2 of the labels left out, and the gap to grouped folds on the same rows."""
    return rounded(_left_out(spark, sf_dir)[1])


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_folds(_vectors(spark, sf_dir), "vec_id")


def lasso_1se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen penalty, its standardised coefficients on all rows."""
    matrices, k = L.fold_matrices(_folded(spark, sf_dir), [*FEATURES, "y"]), len(FEATURES)
    relative, _ = L.lasso_1se(matrices, k)
    b = L.lasso(sum(matrices.values()), k, relative)
    return spark.createDataFrame([(f, float(v), relative) for f, v in zip(FEATURES, b)], "feature string, coefficient double, relative_alpha double")


def lasso_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold R2: the penalty of each outer fold is chosen on the other folds only."""
    matrices, k, error = L.fold_matrices(_folded(spark, sf_dir), [*FEATURES, "y"]), len(FEATURES), 0.0
    total = sum(matrices.values())
    for f, held in matrices.items():
        train = total - held
        relative, _ = L.lasso_1se({g: m for g, m in matrices.items() if g != f}, k)
        mean, sd, _, _ = L.standardised(train, k)
        error += L.error_sum(held, L.raw_coefficients(L.lasso(train, k, relative), mean, sd, mean[k + 1]), k + 1)
    spread = L.error_sum(total, np.array([total[0, k + 1] / total[0, 0]]), k + 1)
    return spark.createDataFrame([("y", float(1 - error / spread), int(total[0, 0]))], "target string, nested_r2 double, n long")


def lasso_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of 100 bootstraps of labels in which a coefficient stays: weighted sums of the labels' matrices."""
    df, k = _vectors(spark, sf_dir), len(FEATURES)
    per = df.groupBy("label").agg(*product_sums([*FEATURES, "y"]))
    groups = R.numbered(per.select("label"), "label")
    cells = [c for c in per.columns if c != "label"]
    weighted = R.bootstrap_sums(per.join(groups, "label"), [], cells, groups.count(), 100)
    kept = np.array([np.abs(L.lasso(as_matrix(r, k + 2), k, 0.1)) > 1e-10 for r in weighted.collect()])  # 100 small matrices
    return spark.createDataFrame(list(zip(FEATURES, kept.mean(0).tolist())), "feature string, frequency double").orderBy(F.desc("frequency"), "feature")


def pls_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets on eight descriptors, one to six components."""
    df = _folded(spark, sf_dir).withColumn("y2", F.col("f3") - F.col("f0"))
    q2 = L.pls_q2(L.fold_matrices(df, [*FEATURES, "y", "y2"]), len(FEATURES), 2)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(q2, 1)], "n_components int, q2 double")


def pls_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of descriptors and targets on two latent variables."""
    df = _vectors(spark, sf_dir).withColumn("y2", F.col("f3") - F.col("f0")).withColumn("all", F.lit(0))
    g = sum(L.fold_matrices(df, [*FEATURES, "y", "y2"], "all").values())
    return rounded(spark.createDataFrame(L.pls_loadings(g, FEATURES, ["y", "y2"]), "side string, variable string, component int, loading double"))


def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise of the out-of-fold error over the variance when a descriptor, or the group of the first three, is permuted: mean
    and spread of five permutations."""
    df, k = _folded(spark, sf_dir), len(FEATURES)
    matrices = L.fold_matrices(df, [*FEATURES, "y"])
    total = sum(matrices.values())
    fits = {f: L.ols_coefficients(total - held, k) for f, held in matrices.items()}
    moved = R.permute(df, FEATURES, ["vec_id"], 0).withColumn("seed", F.lit(0))
    for seed in range(1, 5):
        moved = moved.unionByName(R.permute(df, FEATURES, ["vec_id"], seed).withColumn("seed", F.lit(seed)))
    sets = {f: [f] for f in FEATURES} | {"first_three": FEATURES[:3]}
    scored = L.out_of_fold(moved, FEATURES, fits, name="p_none")
    for name, cols in sets.items():
        scored = L.out_of_fold(scored, [f"permuted_{c}" if c in cols else c for c in FEATURES], fits, name=f"p_{name}")
    mse = lambda n: F.avg(F.pow(F.col("y") - F.col(f"p_{n}"), 2))
    rise = scored.groupBy("seed").agg(*(F.try_divide(mse(n) - mse("none"), F.var_pop("y")).alias(n) for n in sets))
    long = rise.select(F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), F.col(n).alias("v")) for n in sets))).alias("r")).select("r.*")
    return long.groupBy("variable").agg(F.avg("v").alias("importance"), F.stddev_pop("v").alias("sd_repeats"))


def knn_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean target of the 1 and 5 nearest of all rows, for each row whose id is divisible by 20 (the stated query set)."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    near = L.nearest(rows.filter("id % 20 = 0"), rows, 5)
    target = rows.select(F.col("id").alias("neighbour"), F.aggregate("v", F.lit(0.0), lambda a, v: a + v).alias("t"))
    both = near.join(target, "neighbour").groupBy("query")
    return rounded(both.agg(F.count("*").alias("n"), F.avg("t").alias("knn5"), F.min_by("t", F.struct("d2", "neighbour")).alias("knn1")), 5)


def missing_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of two columns with gaps: as they are, filled, filled with flags, flags only; their column means."""
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("b"))
    fitted = L.fit_preparation(lines, ["a", "b"])
    filled = L.prepare(lines, fitted)
    native = lines.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).select(F.lit("native").alias("view"), "a", "b")
    views = filled.agg(*(F.avg(c).alias(c) for c in ("a", "b", "NA_a", "NA_b")))
    return rounded(native.unionByName(views.select(F.lit("median").alias("view"), "a", "b")).unionByName(views.select(F.lit("mask").alias("view"), F.col("NA_a").alias("a"), F.col("NA_b").alias("b"))))


SETS = {"first": FEATURES[:2], "all": FEATURES, "drop_first": FEATURES[2:], "drop_last": FEATURES[:6]}


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold sums per label of 150 boosted trees for each set, target, repeat and fold, and their 300 draws of labels."""
    df = _vectors(spark, sf_dir).withColumn("y2", F.col("f3") - F.col("f0") * F.col("f1"))
    sums = cut(B.tree_grid(df, ["y", "y2"], SETS, "label", "vec_id"))
    return sums, B.grid_draws(sums)


def gbt_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of four sets of descriptors for two targets, five folds three times, with intervals."""
    return rounded(B.grid_scores(*_grid(spark, sf_dir)))


def gbt_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of all descriptors less that of each other set, on the same draws."""
    return rounded(B.grid_contrasts(*_grid(spark, sf_dir), "all"))


def rf_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest of 100 trees on five folds."""
    df = _folded(spark, sf_dir)
    return R.pooled_r2(R.group_sums(L.forest_out_of_fold(df, "y", FEATURES, key="vec_id"), "fold", {"forest": "pred"}, "y"), ["model"])


def gbt_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for two targets of all lines, grown from summed histograms: ten trees on three folds of suppliers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_tax", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"),
                                                    F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    sets = {"line": ["l_quantity", "l_discount", "l_tax"], "all": ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]}
    sums = V.boosted_sums(lines.join(part, "l_partkey", "left"), ["price", "net"], sets, "l_suppkey", "line", folds=3, repeats=1, trees=10, rate=0.3)
    return rounded(R.pooled_r2(sums, ["target", "set"]))


def rf_multioutput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest with vector leaves against a forest for each of three targets, 50 trees of depth 8 on five folds: R2 of both, their
    difference, 300 draws of labels."""
    df = _vectors(spark, sf_dir).withColumn("y2", F.col("f3") - F.col("f0") * F.col("f1")).withColumn("y3", F.col("f4") + F.col("f0"))
    sums = cut(V.forest_sums(df, ["y", "y2", "y3"], FEATURES, "label", "vec_id", trees=50, depth=8))
    return rounded(B.arm_report(sums, B.arm_draws(sums)))


def w1_reference_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape target against a uniform reference and against the pooled profile of each fold's training rows: boosted trees
    of 150 on both with the same folds of labels, R2 with intervals of 300 draws, and the rank correlation of the targets."""
    vectors = _vectors(spark, sf_dir).select("vec_id", *FEATURES)
    shapes = S.subtract_baseline(spectra(spark, sf_dir), fraction=1 / 40).filter("label IS NOT NULL")
    folded = R.group_folds(shapes, "label")
    uniform = folded.select("vec_id", F.ln(S.wasserstein(F.col("corrected"), S.uniform_reference(F.size("corrected")))).alias("uniform"))
    targets = S.fold_targets(folded.select("vec_id", "label", "fold", "corrected"), "fold").join(uniform, "vec_id")
    wide = targets.groupBy("vec_id", "label", "fold").agg(F.first("uniform").alias("uniform"), *(F.first(F.when(F.col("model_fold") == f, F.col("target")), True).alias(f"t{f}") for f in range(5)))
    rows = cut(wide.join(vectors, "vec_id"))
    sets = {"all": FEATURES}
    sums = [B.tree_grid(rows, ["uniform"], sets, "label", "vec_id", fold_column="fold"),
            B.tree_grid(rows, [f"t{f}" for f in range(5)], sets, "label", "vec_id", target_of_fold=[f"t{f}" for f in range(5)], fold_column="fold")]
    both = cut(sums[0].unionByName(sums[1]).withColumn("target", F.when(F.col("target") == "uniform", "fixed uniform").otherwise("training-fold pooled"))
               .groupBy("grp", *B.COMBINATION).agg(*(F.sum(c).alias(c) for c in ("n", "sy", "syy", "see"))))
    own = rows.select("uniform", F.coalesce(*(F.when(F.col("fold") == f, F.col(f"t{f}")) for f in range(5))).alias("pooled"))
    rho = rank_correlations(own, ["uniform"], ["pooled"]).select("rho")  # one row
    scores = B.grid_scores(both, B.grid_draws(both)).select(F.col("target").alias("reference"), "n", "r2", "ci_lo", "ci_hi")
    return rounded(scores.join(F.broadcast(rho)).select("reference", "n", "r2", "ci_lo", "ci_hi", F.when(F.col("reference") == "fixed uniform", F.lit(1.0)).otherwise(F.col("rho")).alias("rank_rho_vs_uniform")))


def settings_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak counts and widths under every setting of the preprocessing, each learnt from the descriptors by 150 boosted trees on the
    same five folds of labels: R2 with intervals of 300 draws, and the difference to the default setting on the same draws."""
    peaks = S.peak_features(spectra(spark, sf_dir), settings=S.SETTINGS).filter("label IS NOT NULL")
    ends = {"n_peak": F.ln(F.when(F.col("n_peak") > 0, F.col("n_peak").cast("double"))), "gamma": F.ln(F.when(F.col("gamma") > 0, F.col("gamma")))}
    names = {f"{e}__{k}": (e, k) for e in ends for k in S.SETTINGS}
    wide = peaks.groupBy("vec_id", "label").agg(*(F.first(F.when(F.col("setting") == k, ends[e]), True).alias(n) for n, (e, k) in names.items()))
    rows = cut(wide.join(_vectors(spark, sf_dir).select("vec_id", *FEATURES), "vec_id"))
    sums = B.tree_grid(rows, list(names), {"all": FEATURES}, "label", "vec_id", repeats=1)
    part = F.split("target", "__")
    sums = cut(sums.withColumns({"set": part[1], "target": part[0]}))
    boot = B.grid_draws(sums)
    scores = B.grid_scores(sums, boot).withColumnRenamed("set", "setting").drop("r2_sd_repeats")
    delta = B.grid_contrasts(sums, boot, "default").select("target", F.substring_index("contrast", " - ", -1).alias("setting"), F.col("delta_r2").alias("default_less_it"), F.col("ci_lo").alias("delta_lo"), F.col("ci_hi").alias("delta_hi"))
    return rounded(scores.join(delta, ["target", "setting"], "left"))


QUERIES = {f.__name__: f for f in (
    settings_models, w1_reference_models, gbt_all_rows, rf_multioutput, group_folds, bootstrap_r2_ci, paired_delta_r2, pooled_r2, cluster_bootstrap, oof_mean_baseline, lofo_linear, lofo_families, lofo_gap, lasso_1se, lasso_nested, lasso_stability, pls_q2, pls_loadings,
    perm_importance, knn_baseline, missing_representation, gbt_sets, gbt_contrasts, rf_arms)}

_SUMS = """
WITH l AS (SELECT l_suppkey AS g, p_type, l_extendedprice AS y, p_retailprice * l_quantity AS own FROM lineitem JOIN part ON l_partkey = p_partkey
), p AS (SELECT *, avg(y) OVER (PARTITION BY p_type) AS tm FROM l
), s AS (SELECT g, 'type_mean' AS model, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, sum((y - tm) ** 2) AS see FROM p GROUP BY g
  UNION ALL SELECT g, 'own_price', count(*), sum(y), sum(y * y), sum((y - own) ** 2) FROM p GROUP BY g
)"""
_BOOT = _SUMS + """, w AS (SELECT b, model, sum(w * n) AS n, sum(w * sy) AS sy, sum(w * syy) AS syy, sum(w * see) AS see FROM (SELECT *, (b * 7 + g * 13) % 4 AS w FROM s, range(20) t(b)) GROUP BY b, model
), r AS (SELECT b, model, 1 - see / nullif(syy - sy * sy / n, 0) AS r2 FROM w
)"""
ORACLES = {
    "bootstrap_r2_ci": _BOOT + "SELECT model, round(quantile_cont(r2, 0.025), 6) AS ci_lo, round(quantile_cont(r2, 0.975), 6) AS ci_hi FROM r GROUP BY model",
    "paired_delta_r2": _BOOT + """, d AS (SELECT a.r2 - c.r2 AS d FROM r a JOIN r c ON a.b = c.b AND a.model = 'type_mean' AND c.model = 'own_price')
SELECT 'type_mean - own_price' AS contrast, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS ci_lo, round(quantile_cont(d, 0.975), 6) AS ci_hi FROM d""",
    "pooled_r2": _SUMS + "SELECT model, sum(n)::BIGINT AS n, round(1 - sum(see) / (sum(syy) - sum(sy) ** 2 / sum(n)), 6) AS r2 FROM s GROUP BY model",
    "oof_mean_baseline": """
WITH l AS (SELECT p_type, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey
), f AS (SELECT p_type, count(*) AS n_test, (SELECT count(*) FROM l) - count(*) AS n_train, ((SELECT sum(y) FROM l) - sum(y)) / ((SELECT count(*) FROM l) - count(*)) AS m FROM l GROUP BY p_type)
SELECT p_type, any_value(n_test) AS n_test, any_value(n_train) AS n_train, round(any_value(m), 4) AS train_mean, round(sqrt(avg((y - m) ** 2)), 4) AS rmse FROM l JOIN f USING (p_type) GROUP BY p_type""",
    "knn_baseline": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
), d AS (SELECT q.vec_id AS query, r.vec_id AS nb, list_sum(r.v) AS t, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) ** 2)) AS d2 FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, nb) AS k FROM d)
SELECT query, count(*) AS n, round(avg(t), 5) AS knn5, round(max(t) FILTER (WHERE k = 1), 5) AS knn1 FROM n WHERE k <= 5 GROUP BY query""",
    "missing_representation": """
WITH l AS (SELECT CASE WHEN l_discount > 0.05 THEN l_discount END AS a, CASE WHEN l_tax > 0 THEN l_tax END AS b FROM lineitem
), m AS (SELECT median(a) AS ma, median(b) AS mb FROM l)
SELECT 'native' AS view, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM l UNION ALL SELECT 'median', round(avg(coalesce(a, ma)), 6), round(avg(coalesce(b, mb)), 6) FROM l, m
UNION ALL SELECT 'mask', round(avg((a IS NULL)::INTEGER), 6), round(avg((b IS NULL)::INTEGER), 6) FROM l""",
}
