"""Report and sensitivity tables that build on the other queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import resampling as R
from ..operators import spectra as S
from ..operators import stats
from ..operators.boxes import overlaps
from ..session import cut
from . import modelling, statistics
from .tables import rounded, spectra, table

#: What the endpoints of a spectrum are.
ENDPOINTS = {
    "n_peak": "detected peaks in 100-1300 1/cm", "s_peak": "-sum p ln p over peak areas", "evenness": "s_peak / ln n_peak", "gamma": "median half-prominence width", "domega_median": "median distance of neighbouring peaks",
    "r_overlap": "gamma / domega_median", "frac_low": "n_low / n_peak", "frac_mid": "n_mid / n_peak", "frac_high": "n_high / n_peak", "shape_w1_distance": "Wasserstein-1 distance to a uniform profile",
    "shape_centroid": "intensity-weighted mean position", "shape_skewness": "standardised third moment of intensity", "eta": "n_peak / Raman-active modes"}
GROUPS = {"group_a": ["f0", "f1"], "group_b": ["f2", "f3", "f4"], "group_c": ["f5", "f6", "f7"]}


def endpoint_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every endpoint of a spectrum: what it is, for how many spectra it is defined, and its mean there."""
    df = S.peak_features(spectra(spark, sf_dir))
    value = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    rows = F.array(*(F.struct(F.lit(c).alias("endpoint"), F.lit(d).alias("definition"), value(c).alias("v")) for c, d in ENDPOINTS.items()))
    return rounded(df.select(F.explode(rows).alias("r")).select("r.*").groupBy("endpoint", "definition").agg(F.count("v").alias("n_defined"), F.avg("v").alias("mean")))


def exclusive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's strongest feature that is not taken yet."""
    picks = stats.exclusive_picks(statistics.spearman_matrix(spark, sf_dir), statistics.TARGETS)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(picks)], "place long, feature string, target string, rho double")


def drop_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of out-of-fold R2 when a group of descriptors is left out, on the same folds and from the same matrices."""
    columns = modelling.FEATURES
    matrices = L.fold_matrices(modelling._folded(spark, sf_dir), [*columns, "y"])
    whole = L.cross_validated_r2(matrices, columns, columns)
    rows = [(g, whole - L.cross_validated_r2(matrices, columns, [c for c in columns if c not in own])) for g, own in GROUPS.items()]
    return spark.createDataFrame(rows, "group_removed string, r2_loss double")


def complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 on all rows (gaps filled and flagged) against complete rows; the first descriptor has gaps that depend on another.

    Medians and flags of a fold are learnt from the other folds.
    """
    df = modelling._folded(spark, sf_dir).withColumn("f0", F.when(F.col("f3") < 0, F.col("f0"))).cache()
    columns = modelling.FEATURES
    complete, n, error, spread = L.fold_matrices(df, [*columns, "y"]), 0.0, 0.0, 0.0
    for fold in complete:
        fitted = L.fit_preparation(df.filter(F.col("fold") != fold), columns)
        names = [*columns, *(f"NA_{c}" for c in fitted["flags"])]
        filled, k = L.fold_matrices(L.prepare(df, fitted), [*names, "y"]), len(names)
        total = sum(filled.values())
        n += filled[fold][0, 0]
        error += L.error_sum(filled[fold], L.ols_coefficients(total - filled[fold], k), k + 1)
        spread = L.error_sum(total, np.array([total[0, k + 1] / total[0, 0]]), k + 1)
    df.unpersist()
    rows = [("all_rows", int(n), float(1 - error / spread) if spread > 0 else None), ("complete_rows", int(sum(m[0, 0] for m in complete.values())), L.cross_validated_r2(complete, columns, columns))]
    return spark.createDataFrame(rows, "rows string, n long, r2 double")


def predictor_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictors on the same folds: none, a category, numbers, both, and the mean of the 1 and 5 nearest training rows; R2 with
    intervals over the same 300 bootstraps of labels, and their differences to the numbers.

    A category's prediction is the mean of its training rows, or the overall mean where a fold has none; both adds that mean of the residuals. Numbers are scaled by deviations for the distances.
    """
    columns = modelling.FEATURES
    df = cut(modelling._folded(spark, sf_dir).withColumn("category", F.pmod(F.hash("label"), F.lit(7))))
    matrices = L.fold_matrices(df, [*columns, "y"])
    total, k = sum(matrices.values()), len(columns) + 1
    df = L.out_of_fold(df, [], {f: np.array([(total - m)[0, k] / (total - m)[0, 0]]) for f, m in matrices.items()}, name="none")
    df = L.out_of_fold(df, columns, {f: L.ols_coefficients(total - m, len(columns)) for f, m in matrices.items()}, name="numbers")

    def other_folds(value: str, name: str) -> DataFrame:
        """(fold, category, name): the mean of the category's values outside the fold, from sums of (category, fold)."""
        per = df.groupBy("category", "fold").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        whole = per.groupBy("category").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
        return per.join(whole, "category").select("fold", "category", F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n")).alias(name))

    df = df.withColumn("left", F.col("y") - F.col("numbers"))
    df = df.join(other_folds("y", "m"), ["fold", "category"]).join(other_folds("left", "shift"), ["fold", "category"])
    df = df.withColumns({"category_mean": F.coalesce("m", "none"), "both": F.col("numbers") + F.coalesce("shift", F.lit(0.0))})
    sd = L.standardised(total, len(columns))[1]
    points = df.select(F.col("vec_id").alias("id"), F.array(*(F.col(c) / float(s) for c, s in zip(columns, sd))).alias("v"), F.col("fold").alias("part"))
    near = L.nearest(points, points, 5).join(df.select(F.col("vec_id").alias("neighbour"), F.col("y").alias("t")), "neighbour")
    df = df.join(near.groupBy(F.col("query").alias("vec_id")).agg(F.avg("t").alias("knn5"), F.min_by("t", F.struct("d2", "neighbour")).alias("knn1")), "vec_id")
    models = ["none", "category_mean", "numbers", "both", "knn1", "knn5"]
    sums = cut(R.group_sums(df, "label", {n: n for n in models}, "y"))
    groups = R.numbered(sums.select("label").distinct(), "label")
    boot = R.cluster_bootstrap(sums.join(groups, "label"), groups.count(), 300)
    r2 = R.pooled_r2(sums, ["model"]).join(R.intervals(boot, ["model"]), "model").select("model", "r2", "ci_lo", "ci_hi")
    return rounded(r2.unionByName(R.paired_differences(boot, "numbers", [m for m in models if m != "numbers"]).select(F.col("contrast").alias("model"), F.col("mean").alias("r2"), "ci_lo", "ci_hi")))


def setting_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the signal-to-noise ratio under each setting with the default one."""
    snr = S.peak_features(spectra(spark, sf_dir), settings=S.SETTINGS).select("vec_id", "setting", "raman_snr")
    wide = snr.groupBy("vec_id").pivot("setting", list(S.SETTINGS)).agg(F.first("raman_snr"))
    return rounded(stats.rank_correlations(wide, ["default"], [s for s in S.SETTINGS if s != "default"]))


def label_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as text boxes on the page of their brand, some long and some tall: which of them overlap, and by how much."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y = F.pmod(k * 7919, F.lit(1009)).cast("double"), F.pmod(k * 104729, F.lit(997)).cast("double")
    boxes = table(spark, sf_dir, "part").select("p_brand", "p_partkey", x.alias("x0"), y.alias("y0"), (x + size * F.when(k % 10 == 0, 16).otherwise(2)).alias("x1"), (y + size / F.when(k % 7 == 0, 1).otherwise(4)).alias("y1"))
    return rounded(overlaps(boxes, "p_brand", "p_partkey").withColumnRenamed("page", "p_brand"))


def curated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a short list of names, compared without regard to case; the first by key of each."""
    wanted = spark.createDataFrame([("SMALL RING", "first"), ("Red Widget", "second"), ("no such part", "third")], "wanted string, role string")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    first = part.groupBy(F.lower("p_name").alias("name")).agg(F.min(F.struct("p_partkey", "p_retailprice")).alias("m"))
    return wanted.join(first, F.lower("wanted") == F.col("name"), "left").select("wanted", "role", "m.p_partkey", "m.p_retailprice")


def ratio_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of return flags among the lines of a supplier, and the supplier's lines per distinct part."""
    flag = F.col("l_returnflag")
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), *(F.count_if(flag == f).alias(f"n_{f.lower()}") for f in "ANR"), F.count_distinct("l_partkey").alias("parts"))
    return rounded(per.select("l_suppkey", "n", *(F.try_divide(f"n_{f}", "n").alias(f"frac_{f}") for f in "anr"), F.try_divide("n", F.when(F.col("parts") > 0, F.col("parts"))).alias("eta")))


QUERIES = {f.__name__: f for f in (endpoint_definitions, exclusive_pairs, drop_group, complete_case, predictor_baselines, setting_agreement, label_overlaps, curated_lookup, ratio_fractions)}

ORACLES = {
    "label_overlaps": """
WITH b AS (SELECT p_brand, p_partkey AS k, ((p_partkey * 7919) % 1009)::DOUBLE AS x0, ((p_partkey * 104729) % 997)::DOUBLE AS y0, p_size * CASE WHEN p_partkey % 10 = 0 THEN 16 ELSE 2 END AS w, p_size / CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 4 END::DOUBLE AS h FROM part
), p AS (SELECT a.p_brand, a.k AS a, b.k AS b, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS dx, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) AS dy FROM b a JOIN b ON a.p_brand = b.p_brand AND a.k < b.k)
SELECT p_brand, a, b, round(dx * dy, 6) AS area FROM p WHERE dx > 0 AND dy > 0""",
    "exclusive_pairs": statistics._rho(False) + """, a AS (SELECT feature, rho FROM rho WHERE target = 'l_extendedprice' AND rho IS NOT NULL ORDER BY abs(rho) DESC, feature LIMIT 1
), b AS (SELECT feature, rho FROM rho WHERE target = 'l_tax' AND rho IS NOT NULL AND feature NOT IN (SELECT feature FROM a) ORDER BY abs(rho) DESC, feature LIMIT 1)
SELECT 0 AS place, feature, 'l_extendedprice' AS target, rho FROM a UNION ALL SELECT 1, feature, 'l_tax', rho FROM b""",
    "curated_lookup": """
WITH w(wanted, role) AS (VALUES ('SMALL RING', 'first'), ('Red Widget', 'second'), ('no such part', 'third'))
SELECT wanted, role, min(p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM w LEFT JOIN part ON lower(p_name) = lower(wanted) GROUP BY 1, 2""",
    "ratio_fractions": "SELECT l_suppkey, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE l_returnflag = '{f}') / count(*)::DOUBLE, 6) AS frac_{f.lower()}" for f in "ANR") + ", round(count(*)::DOUBLE / count(DISTINCT l_partkey), 6) AS eta FROM lineitem GROUP BY 1",
}
