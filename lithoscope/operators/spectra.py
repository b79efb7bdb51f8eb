"""Spectra as one row each: an array of (x, y) points and what is derived from it.

A spectrum comes from one measurement file, so its array is bounded; everything here is a projection over that array
(higher-order functions, one Arrow UDF for peaks) and no operator shuffles. Rows keep their other columns. Missing is
NULL: an undefined statistic never turns into NaN or infinity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_float, entropy_of, let, median_of

#: The analysed range in 1/cm, its bands, and the fewest points of a usable spectrum.
RANGE = (100.0, 1300.0)
BANDS = {"low": (100.0, 400.0), "mid": (400.0, 700.0), "high": (700.0, 1300.0)}
LEAST_POINTS = 20
#: Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


@dataclass(frozen=True)
class Settings:
    """Tunable numbers of peak extraction; fractions of windows are of the number of points."""

    baseline_window: float = 1 / 40
    smoothing_window: float = 1 / 100
    height: float = 0.02
    prominence: float = 0.015
    distance: float = 3.0
    noise_sigmas: float = 5.0


#: The settings that are compared with each other.
SETTINGS = {
    "default": Settings(),
    "smooth_2x": Settings(smoothing_window=2 / 100),
    "strict_peaks": Settings(height=0.04, prominence=0.03, distance=4.0),
    "broad_baseline_2x": Settings(baseline_window=2 / 40),
}


def sorted_points(x: Column, y: Column) -> Column:
    """Points of two parallel arrays in order of x; pairs with a missing or non-finite side go."""
    pairs = F.zip_with(x, y, lambda a, b: F.struct(clean_float(a).alias("x"), clean_float(b).alias("y")))
    return F.array_sort(F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def in_range(points: Column, low: float = RANGE[0], high: float = RANGE[1]) -> Column:
    return F.filter(points, lambda p: p["x"].between(low, high))


def odd_window(n: Column, fraction: Column | float, least: int) -> Column:
    """max(least, whole number of points of the fraction made odd)."""
    return F.greatest(F.lit(least), F.floor(n * fraction).cast("int").bitwiseOR(F.lit(1)))


def rolling_min(y: Column, reach: Column) -> Column:
    """Minimum of each value and ``reach`` neighbours on both sides; the width may differ from row to row."""
    def lowest(v: Column) -> Column:
        first = lambda k: F.greatest(F.lit(1), k - v["reach"])
        return F.transform(F.sequence(F.lit(1), F.size(v["y"])), lambda k: F.array_min(F.slice(v["y"], first(k), k + v["reach"] + 1 - first(k))))

    return F.when(F.size(y) > 0, let(F.struct(y.alias("y"), reach.alias("reach")), lowest)).otherwise(F.array().cast("array<double>"))


def subtract_baseline(df: DataFrame, points: str = "points", fraction: str | float = 1 / 40, out: str = "corrected") -> DataFrame:
    """``out``: the points with the rolling minimum taken off, never below zero."""
    fraction = F.col(fraction) if isinstance(fraction, str) else fraction
    base = lambda p: rolling_min(F.transform(p, lambda q: q["y"]), odd_window(F.size(p), fraction, 11))
    return df.withColumn(out, let(F.col(points), lambda p: F.zip_with(p, base(p), lambda q, b: F.struct(q["x"].alias("x"), F.greatest(q["y"] - b, F.lit(0.0)).alias("y")))))


def _sum(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))


def spacing_median(points: Column) -> Column:
    """Median of the positive distances of neighbouring x; NULL if there is none."""
    def steps(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return median_of(F.filter(F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda b, a: b - a), lambda d: d > 0))

    return let(F.transform(points, lambda p: p["x"]), steps)


def moments(df: DataFrame, points: str = "corrected") -> DataFrame:
    """total, centroid and skewness of x weighted by y. No total: both NULL; spread of 1e-8 or less: no skewness."""
    mean = lambda v, f: F.try_divide(_sum(v["p"], f), F.when(v["total"] > 0, v["total"]))
    powers = lambda v: F.struct(
        v["total"].alias("total"), v["mu"].alias("mu"), F.sqrt(mean(v, lambda q: q["y"] * F.pow(q["x"] - v["mu"], 2))).alias("sd"),
        mean(v, lambda q: q["y"] * F.pow(q["x"] - v["mu"], 3)).alias("third"))
    centred = lambda v: let(F.struct(v["p"].alias("p"), v["total"].alias("total"), mean(v, lambda q: q["y"] * q["x"]).alias("mu")), powers)
    whole = let(F.col(points), lambda p: let(F.struct(p.alias("p"), _sum(p, lambda q: q["y"]).alias("total")), centred))
    m = F.col("__m")
    skewness = F.when(m["sd"] > 1e-8, F.try_divide(m["third"], F.pow(m["sd"], 3)))
    return df.withColumn("__m", whole).withColumns({"total": m["total"], "centroid": m["mu"], "skewness": skewness}).drop("__m")


def wasserstein(first: Column, second: Column) -> Column:
    """Distance of two arrays of (x, y) with y as weights: the area between their cumulative shares; NULL without weight."""
    weighted = lambda points: let(points, lambda p: F.struct(p.alias("p"), _sum(p, lambda q: q["y"]).alias("total")))
    share = lambda v, sign: F.transform(v["p"], lambda q: F.struct(q["x"].alias("x"), (sign * F.try_divide(q["y"], v["total"])).alias("d")))
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("area"))
    step = lambda a, s: F.struct(
        (a["gap"] + s["d"]).alias("gap"), s["x"].alias("x"), (a["area"] + F.coalesce(F.abs(a["gap"]) * (s["x"] - a["x"]), F.lit(0.0))).alias("area"))
    area = lambda v: F.when(
        (v["a"]["total"] > 0) & (v["b"]["total"] > 0), F.aggregate(F.array_sort(F.concat(share(v["a"], F.lit(1.0)), share(v["b"], F.lit(-1.0)))), start, step)["area"])
    return let(F.struct(weighted(first).alias("a"), weighted(second).alias("b")), area)


def uniform_reference(n: Column, low: float = RANGE[0], high: float = RANGE[1]) -> Column:
    """n points of equal weight, evenly spaced over the range."""
    place = lambda m, i: F.lit(low) + F.coalesce(i * F.try_divide(F.lit(high - low), m - 1), F.lit(0.0))
    return let(n, lambda m: F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: F.struct(place(m, i).alias("x"), F.lit(1.0).alias("y"))))


def resample(points: Column, n: int = 481, low: float = RANGE[0], high: float = RANGE[1]) -> Column:
    """y at n even places by linear interpolation (ends clamped) as shares of their total.

    NULL below 20 points or without a total. Bracketing pairs are found per place, so the cost is places times points.
    """
    def at(p: Column, g: Column) -> Column:
        def between(below: Column) -> Column:
            a, b = F.try_element_at(p, F.greatest(below, F.lit(1))), F.try_element_at(p, F.least(below + 1, F.size(p)))
            slope = F.coalesce(F.try_divide(b["y"] - a["y"], b["x"] - a["x"]), F.lit(0.0))
            return F.when(below == 0, a["y"]).otherwise(a["y"] + slope * (g - a["x"]))

        return let(F.size(F.filter(p, lambda q: q["x"] <= g)), between)

    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * ((high - low) / (n - 1)))
    raw = let(points, lambda p: F.when(F.size(p) >= LEAST_POINTS, F.transform(grid, lambda g: F.struct(g.alias("x"), at(p, g).alias("y")))))
    shares = lambda v: F.when(v["total"] > 0, F.transform(v["r"], lambda q: F.struct(q["x"].alias("x"), F.try_divide(q["y"], v["total"]).alias("y"))))
    return let(raw, lambda r: let(F.struct(r.alias("r"), _sum(r, lambda q: q["y"]).alias("total")), shares))


def local_maxima(points: Column) -> Column:
    """Points strictly above both neighbours."""
    def inner(p: Column) -> Column:
        y = lambda i: F.try_element_at(p, i)["y"]
        at = F.filter(F.sequence(F.lit(2), F.greatest(F.size(p) - 1, F.lit(2))), lambda i: (y(i) > y(i - 1)) & (y(i) > y(i + 1)))
        return F.when(F.size(p) >= 3, F.transform(at, lambda i: F.try_element_at(p, i))).otherwise(F.slice(p, 1, 0))

    return let(points, inner)


def robust_noise(values: Column) -> Column:
    """1.4826 times the median distance of the values from their median."""
    distances = lambda v: F.transform(v["y"], lambda y: F.abs(y - v["m"]))
    return let(values, lambda y: MAD_SCALE * let(F.struct(y.alias("y"), median_of(y).alias("m")), lambda v: median_of(distances(v))))


def band_summary(peaks: Column, low: float, high: float) -> Column:
    """n, entropy of areas and median width of the peaks in a band; the last band holds its upper end, an empty one zeros."""
    own = F.filter(peaks, lambda p: (p["pos"] >= low) & ((p["pos"] <= high) if high == RANGE[1] else (p["pos"] < high)))
    return F.struct(
        F.size(own).alias("n"), entropy_of(F.transform(own, lambda p: p["area"])).alias("entropy"),
        F.coalesce(median_of(F.transform(own, lambda p: p["width"])), F.lit(0.0)).alias("width"))


# --- peaks: sequential by nature, so one Arrow UDF over whole spectra -------------------------------------------------


def smooth(y: np.ndarray, window: int, order: int = 3) -> np.ndarray:
    """Local cubic fits: the middle of each window, and one fit of the outermost window at either end."""
    half, places = window // 2, np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    fit = places @ np.linalg.pinv(places)  # row i: weights of the fitted value at place i
    out = np.convolve(y, fit[half][::-1], "same")
    out[:half], out[-half:] = fit[:half] @ y[:window], fit[-half:] @ y[-window:]
    return out


def plateau_maxima(y: np.ndarray) -> np.ndarray:
    """Middles of runs of equal values that are higher than what lies on both sides."""
    starts = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    ends, level = np.r_[starts[1:], len(y)] - 1, y[starts]
    up = np.r_[False, level[1:] > level[:-1]] & np.r_[level[:-1] > level[1:], False]
    return (starts[up] + ends[up]) // 2


def prominence(y: np.ndarray, peak: int) -> tuple[float, int, int]:
    """Height over the higher of the two lowest points before a higher value, and the places of these points."""
    higher = np.flatnonzero(y > y[peak])
    left, right = higher[higher < peak], higher[higher > peak]
    a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(y))
    low_left = peak - int(np.argmin(y[a : peak + 1][::-1]))
    low_right = peak + int(np.argmin(y[peak:b]))
    return y[peak] - max(y[low_left], y[low_right]), low_left, low_right


def crossing(y: np.ndarray, peak: int, base: int, height: float) -> float:
    """Place between peak and base where y falls to ``height``, by linear interpolation."""
    step = 1 if base > peak else -1
    i = peak
    while i != base and y[i] > height:
        i += step
    return i - step * (height - y[i]) / (y[i - step] - y[i]) if y[i] < height else float(i)


def spectrum_peaks(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float | None, list[float], list[float], list[float]]:
    """Signal to noise, and positions, half-prominence widths and areas of the peaks of one corrected spectrum."""
    n, dx = len(x), float(np.median(np.diff(x)[np.diff(x) > 0]))
    window = max(5, min(max(5, int(n * s.smoothing_window) | 1), n - 1 if n % 2 == 0 else n) | 1)
    smoothed = np.clip(smooth(y, window) if n >= window else y, 0, None)
    rest = y - smoothed
    sigma = MAD_SCALE * float(np.median(np.abs(rest - np.median(rest))))
    peaks = plateau_maxima(smoothed)
    peaks = peaks[smoothed[peaks] >= max(s.height * y.max(), s.noise_sigmas * sigma)]
    apart, kept = max(1, round(s.distance / dx)), []
    for p in sorted(peaks, key=lambda p: (-smoothed[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    least, found = max(s.prominence * y.max(), s.noise_sigmas * sigma), []
    for p in sorted(kept):
        high, left, right = prominence(smoothed, p)
        if high < least:
            continue
        sides = lambda part: (crossing(smoothed, p, left, smoothed[p] - part * high), crossing(smoothed, p, right, smoothed[p] - part * high))  # noqa: B023, E731
        (a, b), (lo, hi) = sides(0.5), sides(0.95)
        lo, hi = max(0, int(np.floor(lo))), min(n - 1, int(np.ceil(hi)))
        area = float(np.trapezoid(y[lo : hi + 1], x[lo : hi + 1])) if hi > lo else float(y[p] * dx)
        found.append((float(x[p]), (b - a) * dx, max(area, 1e-12)))
    positions, widths, areas = map(list, zip(*found)) if found else ([], [], [])
    return (float(y.max() / sigma) if sigma > 0 else None), positions, widths, areas


PEAKS = T.StructType([T.StructField("snr", T.DoubleType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("pos", "width", "area"))])


@F.pandas_udf(PEAKS)
def _peaks(x: pd.Series, y: pd.Series, s: pd.DataFrame) -> pd.DataFrame:
    rows = (
        spectrum_peaks(np.asarray(a, float), np.asarray(b, float), Settings(**dict(zip(s.columns, c)))) if len(a) >= LEAST_POINTS and max(b) > 0 and len(set(a)) > 1 else (None, [], [], [])
        for a, b, c in zip(x, y, s.itertuples(index=False)))
    return pd.DataFrame(rows, columns=PEAKS.names)


def settings_column(s: Settings) -> Column:
    return F.struct(*(F.lit(float(v)).alias(k) for k, v in vars(s).items()))


def peak_features(df: DataFrame, points: str = "points", settings: dict[str, Settings] | None = None) -> DataFrame:
    """The whole record of each spectrum, once per setting: counts, entropy, widths, spacing, bands, shape, noise, error.

    A failed check leaves its name in ``error`` and NULLs in the features, and the row stays.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), settings_column(s).alias("s")) for k, s in (settings or {"default": Settings()}).items())))
    df = df.withColumn("__grid", grid).withColumn("__raw", F.size(points)).withColumn(points, in_range(F.col(points)))
    df = subtract_baseline(df.withColumn("__f", F.col("__grid.s.baseline_window")), points, "__f")
    top = F.array_max(F.transform("corrected", lambda p: p["y"]))
    error = (
        F.when(F.col("__raw") < LEAST_POINTS, "too_few_points").when(F.size(points) < LEAST_POINTS, "window_too_short")
        .when(spacing_median(F.col(points)).isNull(), "invalid_wavenumber_spacing").when(top <= 0, "flat_spectrum"))
    df = df.withColumn("__p", _peaks(F.transform("corrected", lambda p: p["x"]), F.transform("corrected", lambda p: p["y"]), F.col("__grid.s")))
    df = df.withColumn("peaks", F.arrays_zip(*(F.col(f"__p.{c}").alias(c) for c in ("pos", "width", "area")))).withColumn("error", F.coalesce(error, F.when(F.size("peaks") == 0, "no_peaks"), F.lit("")))
    ok, part = F.col("error") == "", lambda c: F.transform("peaks", lambda p: p[c])
    df = moments(df).withColumns({
        "setting": F.col("__grid.name"), "n_points": F.size(points), "raman_snr": F.col("__p.snr"), "n_peak": F.when(ok, F.size("peaks")),
        "s_peak": F.when(ok, entropy_of(part("area"))), "gamma": F.when(ok, median_of(part("width"))),
        "domega_median": F.when(ok & (F.size("peaks") > 1), spacing_median(F.transform("peaks", lambda p: F.struct(p["pos"].alias("x"))))),
        "shape_w1_distance": F.when(ok, wasserstein(F.col("corrected"), uniform_reference(F.size(points)))),
        "shape_centroid": F.when(ok, F.col("centroid")), "shape_skewness": F.when(ok, F.col("skewness")),
        "peak_positions_cm1": F.when(ok, F.array_join(F.transform(part("pos"), lambda v: F.format_string("%.2f", v)), ";")).otherwise("")})
    df = df.withColumn("r_overlap", F.try_divide("gamma", "domega_median"))
    for name, (low, high) in BANDS.items():
        band = F.when(ok, band_summary(F.col("peaks"), low, high))
        df = df.withColumns({f"n_{name}": band["n"], f"s_{name}": band["entropy"], f"gamma_{name}": band["width"]})
    return df.withColumn("raman_ok", ok).drop("__grid", "__raw", "__f", "__p", "total", "centroid", "skewness")


def fold_references(df: DataFrame, fold: str, profile: str = "profile") -> DataFrame:
    """(model_fold, reference): for each fold the pooled profile of all rows of the other folds, as (x, y) over the common grid.

    Profiles are summed place by place per fold, the sums of the other folds follow from the whole; folds are few.
    """
    places = df.filter(F.col(profile).isNotNull()).select(F.col(fold).alias("__f"), F.explode(profile).alias("p")).groupBy("__f", F.col("p.x").alias("x")).agg(F.sum("p.y").alias("y"))
    whole = places.groupBy("x").agg(F.sum("y").alias("all"))
    folds = df.select(F.col(fold).alias("model_fold")).filter("model_fold IS NOT NULL").distinct()
    own = folds.join(whole).join(places.select(F.col("__f").alias("model_fold"), "x", "y"), ["model_fold", "x"], "left")  # folds x places rows
    rest = F.struct("x", (F.col("all") - F.coalesce("y", F.lit(0.0))).alias("y"))
    return own.groupBy("model_fold").agg(F.array_sort(F.collect_list(rest)).alias("reference"))


def fold_targets(df: DataFrame, fold: str, points: str = "corrected", places: int = 481) -> DataFrame:
    """``df`` with ``model_fold`` and ``target``, a row for each row and fold: the log of the distance of its profile to the
    pooled profile of the rows outside that fold. A model of a fold trains on its rows of other folds and is judged on its own.

    NULL targets where there is no profile (too few points, no intensity) or the distance is 0.
    """
    shaped = df.withColumn("profile", resample(F.col(points), places))
    return (shaped.join(F.broadcast(fold_references(shaped, fold)))  # one row a fold
            .withColumn("target", F.ln(wasserstein(F.col("profile"), F.col("reference")))).drop("profile", "reference"))
