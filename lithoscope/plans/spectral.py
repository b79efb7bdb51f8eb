"""Queries over spectra: every one is a projection without a shuffle until its last aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..functions.scalars import let
from ..operators import spectra as S
from ..operators.ranking import exact_quantiles
from .tables import rounded, spectra, table


def _corrected(spark: SparkSession, sf_dir: str, fraction: float = 1 / 40) -> DataFrame:
    return S.subtract_baseline(spectra(spark, sf_dir), fraction=fraction)


def _long(df: DataFrame, points: str, *names: str) -> DataFrame:
    return df.select("vec_id", *names, F.posexplode(points).alias("i", "p")).select("vec_id", *names, "i", "p.x", "p.y")


def spectrum_window_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of 400 to 700 with the distance to the point before (within the window)."""
    before = lambda v, i: F.try_element_at(v, F.when(i > 0, i))["x"]
    steps = lambda v: F.transform(v, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"] - before(v, i)).alias("dx")))
    kept = let(S.in_range(F.col("points"), 400.0, 700.0), steps)
    return rounded(spectra(spark, sf_dir).select("vec_id", F.explode(kept).alias("p")).select("vec_id", "p.*"))


def baseline_rollmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(_corrected(spark, sf_dir), "corrected").withColumnRenamed("y", "y_bc").withColumn("i", F.col("i").cast("long")))


def spectral_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.moments(_corrected(spark, sf_dir)).select("vec_id", F.size("corrected").cast("long").alias("n_points"), "total", "centroid", "skewness"))


def wasserstein_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _corrected(spark, sf_dir)
    return rounded(df.select("vec_id", S.wasserstein(F.col("corrected"), S.uniform_reference(F.size("corrected"))).alias("w1")))


def wasserstein_pooled_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the pooled profile of all other labels' rows: one profile per held-out label."""
    df = _corrected(spark, sf_dir)
    grid = _long(df, "corrected", "label").groupBy("label", "i", "x").agg(F.sum("y").alias("y"))
    pooled = grid.groupBy("i", "x").agg(F.sum("y").alias("y_all"))
    profile = (
        grid.join(pooled, ["i", "x"]).withColumn("rest", F.col("y_all") - F.col("y")).groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("x", F.col("rest").alias("y")))).alias("reference")))
    return rounded(df.join(profile, "label").select("vec_id", "label", S.wasserstein(F.col("corrected"), F.col("reference")).alias("w1")))


def w1_fold_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each spectrum to the pooled profile of all spectra outside each of five folds of labels, on 481 places."""
    df = _corrected(spark, sf_dir).filter("label IS NOT NULL").withColumn("fold", F.col("label") % 5)
    return rounded(S.fold_targets(df.select("vec_id", "fold", "corrected"), "fold").select("vec_id", "fold", "model_fold", "target"), 5)


def resampled_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected spectra as shares on a coarser grid of 25 places."""
    df = _corrected(spark, sf_dir).select("vec_id", S.resample(F.col("corrected"), 25).alias("grid"))
    return rounded(_long(df.filter("grid IS NOT NULL"), "grid").select("vec_id", F.col("i").cast("long").alias("i"), F.col("y").alias("share")), 8)


def local_maxima_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir).select("vec_id", F.explode(S.local_maxima(F.col("points"))).alias("p"))
    return rounded(df.select("vec_id", "p.x", "p.y"))


def robust_noise_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_corrected(spark, sf_dir).select("vec_id", S.robust_noise(F.transform("corrected", lambda p: p["y"])).alias("sigma"), S.spacing_median(F.col("corrected")).alias("dx")))


def peak_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record per spectrum under the default settings."""
    df = S.peak_features(spectra(spark, sf_dir))
    return rounded(df.drop("points", "corrected", "peaks"))


def band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands of the local maxima: count, entropy of heights, median height."""
    df = spectra(spark, sf_dir).withColumn("peaks", F.transform(F.filter(S.local_maxima(F.col("points")), lambda p: p["y"] > 0), lambda p: F.struct(p["x"].alias("pos"), p["y"].alias("width"), p["y"].alias("area"))))
    for name, (low, high) in S.BANDS.items():
        df = df.withColumn(name, S.band_summary(F.col("peaks"), low, high))
    return rounded(df.select("vec_id", *(F.col(f"{b}.{c}").cast("long" if c == "n" else "double").alias(f"{c}_{b}") for b in S.BANDS for c in ("n", "entropy", "width"))))


def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each spectrum under two widths of the baseline, in one pass."""
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("setting"), F.lit(f).alias("fraction")) for n, f in (("default", 1 / 40), ("broad", 23 / 64)))))
    df = spectra(spark, sf_dir).withColumn("g", both).withColumn("f", F.col("g.fraction"))
    return rounded(S.moments(S.subtract_baseline(df, fraction="f")).select("vec_id", "g.setting", "total", "centroid"))


def settings_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak counts under all settings, and their rank agreement is left to ``spearman``."""
    df = S.peak_features(spectra(spark, sf_dir), settings=S.SETTINGS)
    return rounded(df.groupBy("setting", "error").agg(F.count("*").alias("n"), F.avg("n_peak").alias("mean_peaks"), F.avg("gamma").alias("mean_width")))


def spectral_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: baseline, shape statistics, quality checks, then exact quartiles per label and over all."""
    df = S.moments(_corrected(spark, sf_dir)).filter((F.size("corrected") >= S.LEAST_POINTS) & F.col("skewness").isNotNull())
    both = F.explode(F.array(F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lit("All")))
    kept = df.select(both.alias("group"), "centroid")
    return rounded(exact_quantiles(kept, ["group"], "centroid", {"q25": 0.25, "median": 0.5, "q75": 0.75}))


def event_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series: median positive gap of the events of a user within a day, in seconds.

    Series are cut by the day so that a user who makes a third of all events is many bounded arrays.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    days = table(spark, sf_dir, "events").filter(F.col("ts").isNotNull()).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct(seconds.alias("x"), F.col("value").alias("y")))).alias("points"))
    return rounded(days.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size("points").cast("long").alias("n"), S.spacing_median(F.col("points")).alias("gap")), 3)


def peak_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and evenness of the price shares of each order's lines, as two sums combined before the shuffle.

    With T the total, -sum(p ln p) = ln T - sum(v ln v) / T, so that no window over the order is needed.
    """
    v = F.col("l_extendedprice")
    sums = table(spark, sf_dir, "lineitem").filter(v > 0).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(v).alias("t"), F.sum(v * F.ln(v)).alias("s"))
    entropy = F.when(F.col("n") == 1, 0.0).otherwise(F.ln("t") - F.try_divide("s", "t"))
    return rounded(sums.select("l_orderkey", "n", entropy.alias("entropy"), F.try_divide(entropy, F.when(F.col("n") > 1, F.ln(F.col("n").cast("double")))).alias("evenness")))


QUERIES = {f.__name__: f for f in (
    spectral_cohort, spectrum_window_points, baseline_rollmin, spectral_moments, wasserstein_uniform, wasserstein_pooled_reference, w1_fold_targets, resampled_profile,
    local_maxima_candidates, robust_noise_mad, peak_features, band_summary, settings_grid, settings_peaks, event_spacing, peak_entropy)}

# --- oracles ---------------------------------------------------------------------------------------------------------

_POINTS = """
WITH p AS (
  SELECT vec_id, label, (i - 1)::BIGINT AS i, 100 + 1200 * (i - 1)::DOUBLE / 63 AS x, e::DOUBLE AS y
  FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
  WHERE e IS NOT NULL AND isfinite(e)
)"""
_BASE = _POINTS + """, b AS (
  SELECT *, greatest(y - min(y) OVER (PARTITION BY vec_id ORDER BY x, y ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING), 0) AS y_bc FROM p
)"""
_MOMENTS = _BASE + """, m1 AS (
  SELECT vec_id, any_value(label) AS label, count(*) AS n_points, sum(y_bc) AS total, sum(y_bc * x) / nullif(sum(y_bc), 0) AS centroid FROM b GROUP BY vec_id
), m2 AS (
  SELECT vec_id, any_value(m1.label) AS label, any_value(n_points) AS n_points, any_value(total) AS total, any_value(centroid) AS centroid,
    sqrt(sum(y_bc * (x - centroid) ** 2) / nullif(any_value(total), 0)) AS sd, sum(y_bc * (x - centroid) ** 3) / nullif(any_value(total), 0) AS m3
  FROM b JOIN m1 USING (vec_id) GROUP BY vec_id
)"""

ORACLES = {
    "spectral_cohort": _MOMENTS + """, k AS (SELECT * FROM m2 WHERE n_points >= 20 AND sd > 1e-8), g AS (
  SELECT coalesce(label::VARCHAR, 'none') AS "group", centroid FROM k UNION ALL SELECT 'All', centroid FROM k)
SELECT "group", count(*) AS n, round(quantile_cont(centroid, 0.25), 6) AS q25, round(quantile_cont(centroid, 0.5), 6) AS median, round(quantile_cont(centroid, 0.75), 6) AS q75 FROM g GROUP BY 1""",
    "spectrum_window_points": _POINTS + """
SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(x - lag(x) OVER (PARTITION BY vec_id ORDER BY x, y), 6) AS dx FROM p WHERE x BETWEEN 400 AND 700""",
    "baseline_rollmin": _BASE + "SELECT vec_id, i, round(x, 6) AS x, round(y_bc, 6) AS y_bc FROM b",
    "spectral_moments": _MOMENTS + "SELECT vec_id, n_points, round(total, 6) AS total, round(centroid, 6) AS centroid, round(CASE WHEN sd > 1e-8 THEN m3 / sd ** 3 END, 6) AS skewness FROM m2",
    "wasserstein_uniform": _BASE + """, f AS (
  SELECT vec_id, x, sum(y_bc) OVER w / nullif(sum(y_bc) OVER (PARTITION BY vec_id), 0) - count(*) OVER w / count(*) OVER (PARTITION BY vec_id) AS gap, lead(x) OVER (PARTITION BY vec_id ORDER BY x) - x AS dx
  FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY x)
) SELECT vec_id, round(sum(abs(gap) * coalesce(dx, 0)), 6) AS w1 FROM f GROUP BY vec_id""",
    "wasserstein_pooled_reference": _BASE + """, g AS (SELECT label, i, sum(y_bc) AS y FROM b WHERE label IS NOT NULL GROUP BY label, i
), t AS (SELECT i, sum(y_bc) AS y_all FROM b GROUP BY i
), r AS (SELECT g.label, i, y_all - y AS ref FROM g JOIN t USING (i)
), f AS (
  SELECT vec_id, label, sum(y_bc) OVER w / nullif(sum(y_bc) OVER (PARTITION BY vec_id), 0) - sum(ref) OVER w / nullif(sum(ref) OVER (PARTITION BY vec_id), 0) AS gap, lead(x) OVER (PARTITION BY vec_id ORDER BY x) - x AS dx
  FROM b JOIN r USING (label, i) WINDOW w AS (PARTITION BY vec_id ORDER BY x)
) SELECT vec_id, label, round(sum(abs(gap) * coalesce(dx, 0)), 6) AS w1 FROM f GROUP BY vec_id, label""",
    "resampled_profile": _BASE + """, s AS (
  SELECT vec_id, x, y_bc, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y_bc) OVER w, y_bc) AS y2, lead(x) OVER w IS NULL AS last FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY x)
), g AS (
  SELECT vec_id, k, y_bc + coalesce((y2 - y_bc) / nullif(x2 - x, 0), 0) * (100 + k * 50::DOUBLE - x) AS y
  FROM s, range(25) r(k) WHERE 100 + k * 50::DOUBLE >= x AND (100 + k * 50::DOUBLE < x2 OR last)
) SELECT vec_id, k AS i, round(y / sum(y) OVER (PARTITION BY vec_id), 8) AS share FROM g QUALIFY sum(y) OVER (PARTITION BY vec_id) > 0""",
    "w1_fold_targets": _BASE + """, s AS (
  SELECT vec_id, label % 5 AS fold, x, y_bc, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y_bc) OVER w, y_bc) AS y2, lead(x) OVER w IS NULL AS last, count(*) OVER (PARTITION BY vec_id) AS m FROM b WHERE label IS NOT NULL WINDOW w AS (PARTITION BY vec_id ORDER BY x)
), g AS (
  SELECT vec_id, fold, k, y_bc + coalesce((y2 - y_bc) / nullif(x2 - x, 0), 0) * (100 + k * 2.5::DOUBLE - x) AS y
  FROM s, range(481) r(k) WHERE m >= 20 AND 100 + k * 2.5::DOUBLE >= x AND (100 + k * 2.5::DOUBLE < x2 OR last)
), h AS (SELECT vec_id, fold, k, y / sum(y) OVER (PARTITION BY vec_id) AS y FROM g QUALIFY sum(y) OVER (PARTITION BY vec_id) > 0
), r AS (SELECT f.fold AS model_fold, k, sum(y) FILTER (WHERE h.fold <> f.fold) AS ref FROM h, (SELECT DISTINCT label % 5 AS fold FROM b WHERE label IS NOT NULL) f GROUP BY ALL
), c AS (SELECT model_fold, k, sum(ref) OVER (PARTITION BY model_fold ORDER BY k) / sum(ref) OVER (PARTITION BY model_fold) AS cr FROM r
), a AS (SELECT vec_id, fold, k, sum(y) OVER (PARTITION BY vec_id ORDER BY k) AS cp FROM h
), d AS (SELECT vec_id, any_value(fold) AS fold, model_fold, ln(sum(abs(cp - cr) * 2.5::DOUBLE) FILTER (WHERE k < 480)) AS target FROM a JOIN c USING (k) GROUP BY vec_id, model_fold)
SELECT v.vec_id, v.fold, f.fold AS model_fold, round(target, 5) AS target FROM (SELECT DISTINCT vec_id, label % 5 AS fold FROM embeddings WHERE label IS NOT NULL) v
CROSS JOIN (SELECT DISTINCT label % 5 AS fold FROM embeddings WHERE label IS NOT NULL) f LEFT JOIN d ON d.vec_id = v.vec_id AND d.model_fold = f.fold""",
    "local_maxima_candidates": _POINTS + """SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM (
  SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY x, y)) WHERE y > a AND y > b""",
    "robust_noise_mad": _BASE + """, c AS (SELECT vec_id, median(y_bc) AS m FROM b GROUP BY vec_id),
  d AS (SELECT vec_id, median(dx) AS dx FROM (SELECT vec_id, x - lag(x) OVER (PARTITION BY vec_id ORDER BY x) AS dx FROM b) WHERE dx > 0 GROUP BY vec_id)
SELECT vec_id, round(1.4826::DOUBLE * median(abs(y_bc - m)), 6) AS sigma, round(any_value(d.dx), 6) AS dx FROM b JOIN c USING (vec_id) LEFT JOIN d USING (vec_id) GROUP BY vec_id""",
    "band_summary": _POINTS + """, q AS (SELECT vec_id, x, y FROM (
  SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY x, y)) WHERE y > a AND y > b AND y > 0
), k AS (SELECT vec_id, CASE WHEN x < 400 THEN 'low' WHEN x < 700 THEN 'mid' ELSE 'high' END AS band, y FROM q WHERE x BETWEEN 100 AND 1300
), e AS (SELECT vec_id, band, count(*) AS n, -sum(y / t * ln(y / t)) AS entropy, median(y) AS width FROM (SELECT *, sum(y) OVER (PARTITION BY vec_id, band) AS t FROM k) GROUP BY vec_id, band)
SELECT v.vec_id, """ + ", ".join(
        f"coalesce(max(n) FILTER (WHERE band = '{b}'), 0) AS n_{b}, round(coalesce(max(entropy) FILTER (WHERE band = '{b}'), 0), 6) AS entropy_{b}, round(coalesce(max(width) FILTER (WHERE band = '{b}'), 0), 6) AS width_{b}"
        for b in ("low", "mid", "high")) + " FROM embeddings v LEFT JOIN e USING (vec_id) GROUP BY v.vec_id",
    "settings_grid": _POINTS + "".join(f""", b{w} AS (
  SELECT *, greatest(y - min(y) OVER (PARTITION BY vec_id ORDER BY x, y ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING), 0) AS y_bc FROM p
)""" for w in (11, 23)) + " UNION ALL ".join(f"""
SELECT vec_id, '{name}' AS setting, round(sum(y_bc), 6) AS total, round(sum(y_bc * x) / nullif(sum(y_bc), 0), 6) AS centroid FROM b{w} GROUP BY vec_id""" for name, w in (("default", 11), ("broad", 23))),
    "event_spacing": """
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) / 1e6::DOUBLE AS x FROM events WHERE ts IS NOT NULL
), d AS (SELECT user_id, day, x - lag(x) OVER (PARTITION BY user_id, day ORDER BY x) AS dx FROM e)
SELECT user_id, day, count(*) AS n, round(median(dx) FILTER (WHERE dx > 0), 3) AS gap FROM d GROUP BY user_id, day""",
    "peak_entropy": """
WITH s AS (SELECT l_orderkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS p FROM lineitem WHERE l_extendedprice > 0
), e AS (SELECT l_orderkey, count(*) AS n, -sum(p * ln(p)) AS entropy FROM s GROUP BY l_orderkey)
SELECT l_orderkey, n, round(entropy, 6) + 0 AS entropy, round(entropy / CASE WHEN n > 1 THEN ln(n) END, 6) AS evenness FROM e""",
}
