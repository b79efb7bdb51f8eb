"""Statistics and their report tables on lineitem joined with part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from .tables import rounded, table

FEATURES, TARGETS, COVARIATES = ["l_quantity", "l_discount", "p_size"], ["l_extendedprice", "l_tax"], ("l_linenumber", "p_retailprice")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part; a discount of 0 counts as missing, to have pairwise deletion at work."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.col("p_size").cast("double"), "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"), "l_tax", F.col("l_linenumber").cast("double"))
    return lines.join(part, "l_partkey")


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.rank_correlations(_lines(spark, sf_dir), FEATURES, TARGETS))


def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.rank_correlations(_lines(spark, sf_dir), FEATURES, TARGETS, COVARIATES))


def spearman_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.with_interval(S.rank_correlations(_lines(spark, sf_dir), FEATURES, TARGETS))
    return rounded(S.benjamini_hochberg(df).withColumn("stars", F.when(F.col("q") < 0.001, "***").when(F.col("q") < 0.01, "**").when(F.col("q") < 0.05, "*").otherwise("")))


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tests in the panel of their brand: p values with ties, some unknown."""
    k = F.col("p_partkey")
    p = F.when(k % 11 > 0, F.pow(F.pmod(k * 7919, F.lit(997)) / F.lit(997.0), F.lit(3)))
    tests = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("panel"), p.alias("p"))
    return rounded(S.benjamini_hochberg(tests, panel=["panel"]), 9)


def kruskal_eta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.kruskal(_lines(spark, sf_dir), ["p_type"], ["l_extendedprice", "l_quantity"]).drop("p"), 5)


def ols_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity by line and its clustered errors; beta and R2 have an oracle."""
    rows = S.ols(_lines(spark, sf_dir), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return rounded(spark.createDataFrame([(r["term"], r["beta"], r["r2"], r["n"]) for r in rows], "term string, beta double, r2 double, n long"), 5)


def ols_cluster_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ols(_lines(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_discount", "p_size"], "l_suppkey")
    return spark.createDataFrame([tuple(r.values()) for r in rows], "term string, beta double, se double, t double, p double, n long, r2 double, adj_r2 double, se_kind string")


def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors: 1 / (1 - r^2) for both."""
    vif = S.variance_inflation(_lines(spark, sf_dir), ["l_quantity", "l_extendedprice"])
    return rounded(spark.createDataFrame(list(vif.items()), "variable string, vif double"), 5)


def peak_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln price less its fit on ln quantity (at least 40 rows): the fit is one aggregate row joined back."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0").select("l_orderkey", "l_linenumber", F.ln("l_quantity").alias("x"), F.ln("l_extendedprice").alias("y"))
    fit = lines.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n")).filter("n >= 40")
    residuals = lines.crossJoin(F.broadcast(fit)).withColumn("r", F.col("y") - F.col("a") - F.col("b") * F.col("x"))  # one row
    return rounded(residuals.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.avg("r").alias("mean_residual"), F.stddev_pop("r").alias("sd_residual")))


def qc_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations again under other price limits against the main ones: all limits are subsets of one pass."""
    limits = {"main": F.lit(True)} | {f"price>={v}": F.col("l_extendedprice") >= v for v in (2000, 10000, 20000, 50000)}
    found = S.benjamini_hochberg(S.with_interval(S.rank_correlations(_lines(spark, sf_dir), FEATURES, TARGETS, subsets=limits)), panel=["subset"])
    return rounded(S.agreement(found, "main").withColumnRenamed("subset", "spec"))


def limited_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlations of every price limit, as they are."""
    limits = {f"price>={v}": F.col("l_extendedprice") >= v for v in (0, 2000, 10000, 20000, 50000)}
    return rounded(S.rank_correlations(_lines(spark, sf_dir), FEATURES, TARGETS, subsets=limits))


def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest partial correlations: the cut is the report."""
    return partial_spearman(spark, sf_dir).filter("rho IS NOT NULL").orderBy(F.desc(F.abs("rho")), "feature", "target").limit(3)


def headline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pair first, then the strongest others up to four; each with its place."""
    ranked = spearman_matrix(spark, sf_dir).withColumn("fixed", (F.col("feature") == "p_size") & (F.col("target") == "l_tax"))
    top = ranked.orderBy(F.desc("fixed"), F.desc(F.abs("rho")), "feature", "target").limit(4)
    return top.select("feature", "target", "rho", "n", "fixed")


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman_matrix(spark, sf_dir).groupBy("feature").pivot("target", TARGETS).agg(F.first("rho"))


def best_target_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a feature is the strongest of a target."""
    best = spearman_matrix(spark, sf_dir).filter("rho IS NOT NULL").groupBy("target").agg(F.min(F.struct((-F.abs("rho")).alias("r"), "feature"))["feature"].alias("feature"))  # ties by name
    return best.groupBy("feature").agg(F.count("*").alias("wins"))


QUERIES = {f.__name__: f for f in (
    spearman_matrix, partial_spearman, spearman_significance, bh_fdr, kruskal_eta2, ols_single, ols_cluster_robust, variance_inflation, peak_residual,
    qc_sensitivity, limited_correlations, top_correlations, headline_pairs, wide_matrix, best_target_wins)}

_LINES = """
WITH l AS (SELECT l_quantity::DOUBLE AS l_quantity, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount, p_size::DOUBLE AS p_size, l_extendedprice, l_tax, l_linenumber::DOUBLE AS l_linenumber, p_retailprice, p_type, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def _rho(covariates: bool) -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS target, {a} AS x, {b} AS y, l_linenumber AS z, p_retailprice AS w FROM l WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
                               + " AND l_linenumber IS NOT NULL AND p_retailprice IS NOT NULL" * covariates for a in FEATURES for b in TARGETS)
    rank = lambda c: f"rank() OVER (PARTITION BY feature, target ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, target, {c}) - 1) / 2.0::DOUBLE AS r{c}"
    corrs = ", ".join(f"corr(r{a}, r{b}) AS {a}{b}" for a, b in ("xy", "xz", "xw", "yz", "yw", "zw")) if covariates else "corr(rx, ry) AS xy"
    rho = "(p - q * s) / sqrt((1 - q * q) * (1 - s * s))"
    tail = f""", first AS (SELECT feature, target, n, (xy - xw * yw) / sqrt((1 - xw * xw) * (1 - yw * yw)) AS p, (xz - xw * zw) / sqrt((1 - xw * xw) * (1 - zw * zw)) AS q,
  (yz - yw * zw) / sqrt((1 - yw * yw) * (1 - zw * zw)) AS s FROM c), rho AS (SELECT feature, target, n, round({rho}, 6) AS rho FROM first)""" if covariates else ", rho AS (SELECT feature, target, n, round(xy, 6) AS rho FROM c)"
    return f"""{_LINES}, p AS ({parts}), r AS (SELECT feature, target, {", ".join(map(rank, "xyzw" if covariates else "xy"))} FROM p
), c AS (SELECT feature, target, count(*) AS n, {corrs} FROM r GROUP BY feature, target){tail}"""


ORACLES = {
    "limited_correlations": _LINES + ", p AS (" + " UNION ALL ".join(
        f"SELECT 'price>={v}' AS subset, '{a}' AS feature, '{b}' AS target, {a} AS x, {b} AS y FROM l WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND l_extendedprice >= {v}" for v in (0, 2000, 10000, 20000, 50000) for a in FEATURES for b in TARGETS) + """
), r AS (SELECT subset, feature, target, """ + ", ".join(f"rank() OVER (PARTITION BY subset, feature, target ORDER BY {c}) + (count(*) OVER (PARTITION BY subset, feature, target, {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "xy") + """ FROM p)
SELECT subset, feature, target, CASE WHEN count(*) >= 10 THEN round(corr(rx, ry), 6) END AS rho, count(*) AS n FROM r GROUP BY ALL""",
    "spearman_matrix": _rho(False) + "SELECT * FROM rho",
    "partial_spearman": _rho(True) + "SELECT * FROM rho",
    "bh_fdr": """
WITH t AS (SELECT p_partkey, p_brand AS panel, CASE WHEN p_partkey % 11 > 0 THEN pow(((p_partkey * 7919) % 997) / 997.0::DOUBLE, 3) END AS p FROM part
), r AS (SELECT *, p * count(p) OVER (PARTITION BY panel) / row_number() OVER (PARTITION BY panel, p IS NULL ORDER BY p, p_partkey) AS s FROM t)
SELECT p_partkey, panel, round(p, 9) AS p, CASE WHEN p IS NOT NULL THEN round(least(1, min(s) OVER (PARTITION BY panel, p IS NULL ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) END AS q FROM r""",
    "kruskal_eta2": _LINES + " , g AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, p_type AS level, {t} AS y FROM l WHERE {t} IS NOT NULL AND p_type IS NOT NULL" for t in ("l_extendedprice", "l_quantity")) + """
), k AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY target, level) >= 8
), r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2.0::DOUBLE AS rk FROM k
), t AS (SELECT target, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT target, y, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY 1
), v AS (SELECT target, level, sum(rk) AS s, count(*) AS m FROM r GROUP BY 1, 2
), h AS (SELECT target, sum(m)::BIGINT AS n, count(*) AS k_levels, (12 * sum(s * s / m) / (sum(m)::DOUBLE * (sum(m) + 1)) - 3 * (sum(m) + 1)) / (1 - any_value(ties) / (sum(m)::DOUBLE ** 3 - sum(m))) AS h FROM v JOIN t USING (target) GROUP BY 1)
SELECT 'p_type' AS factor, target, round(greatest(0, (h - k_levels + 1) / (n - k_levels)), 5) AS eta2, round(h, 5) AS h, n, k_levels FROM h""",
    "ols_single": _LINES + """
SELECT unnest(['const', 'l_quantity']) AS term, round(unnest([regr_intercept(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity)]), 5) AS beta, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2, count(*) AS n FROM l""",
    "variance_inflation": _LINES + "SELECT unnest(['l_quantity', 'l_extendedprice']) AS variable, round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 5) AS vif FROM l",
    "peak_residual": """
WITH l AS (SELECT l_linenumber, ln(l_quantity) AS x, ln(l_extendedprice) AS y FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0
), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l)
SELECT l_linenumber, count(*) AS n, round(avg(y - a - b * x), 6) + 0 AS mean_residual, round(stddev_pop(y - a - b * x), 6) AS sd_residual FROM l, f GROUP BY 1""",
    "top_correlations": _rho(True) + "SELECT * FROM rho WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, feature, target LIMIT 3",
    "headline_pairs": _rho(False) + "SELECT feature, target, rho, n, feature = 'p_size' AND target = 'l_tax' AS fixed FROM rho ORDER BY fixed DESC, abs(rho) DESC, feature, target LIMIT 4",
    "wide_matrix": _rho(False) + "SELECT feature, max(rho) FILTER (WHERE target = 'l_extendedprice') AS l_extendedprice, max(rho) FILTER (WHERE target = 'l_tax') AS l_tax FROM rho GROUP BY feature",
    "best_target_wins": _rho(False) + ", b AS (SELECT target, arg_max(feature, abs(rho)) AS feature FROM rho GROUP BY 1) SELECT feature, count(*) AS wins FROM b GROUP BY 1",
}
