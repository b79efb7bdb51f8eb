"""Cohorts: quality funnel, grouped quartiles, standard scores, levels, bins, transforms, reasons for missing values.

Totals come from one aggregate that is joined back as a single row, never from a window over the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import transform
from .ranking import exact_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def funnel(df: DataFrame, steps: list[tuple[str, Column]], first: str = "All samples") -> DataFrame:
    """(step_no, step, n): rows that pass all steps so far, in one pass. NULL conditions fail, as NaN comparisons would.

    A step whose condition is None (its column is missing) is left out by the caller.
    """
    so_far = [F.lit(True)]
    for _, condition in steps:
        so_far.append(so_far[-1] & F.coalesce(condition, F.lit(False)))
    counts = df.agg(*(F.count_if(c).alias(f"s{i}") for i, c in enumerate(so_far)))
    rows = F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(label).alias("step"), F.col(f"s{i}").alias("n")) for i, label in enumerate([first, *(s[0] for s in steps)])))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def passing(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    return df.filter(reduce(lambda a, s: a & s[1], steps, F.lit(True)))


def with_all(df: DataFrame, group: str, name: str = "All") -> DataFrame:
    """Each row twice: under its own group and under ``name`` (grouping sets of the group and of nothing)."""
    return df.withColumn(group, F.explode(F.array(F.coalesce(F.col(group).cast("string"), F.lit("<NA>")), F.lit(name))))


def median_iqr(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """(group, variable, n, q25, median, q75) of every group and of all rows, exact; one shuffle for all variables."""
    long = with_all(df, group).select(group, F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values))).alias("e"))
    return exact_quantiles(long.select(group, "e.*"), [group, "variable"], "value", QUARTILES)


def standard_scores(df: DataFrame, columns: list[str], sample: bool = True) -> DataFrame:
    """Adds ``z_<column>``; a column without spread gives 0 (population form) or NULL (sample form)."""
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", sd))))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: F.col(f"__s_{c}") if sample else F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return joined.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"__m_{c}"), scale(c)) for c in columns}).drop(*stats.columns)


def pool_rare(df: DataFrame, column: str, least: int, pooled: str, out: str) -> DataFrame:
    """``out``: the level, or ``pooled`` for levels with fewer rows. Counts are combined before the shuffle."""
    common = df.groupBy(column).count().filter(F.col("count") >= least).select(F.col(column).alias("__level"), F.lit(True).alias("__common"))
    return df.join(common, F.col(column).eqNullSafe(F.col("__level")), "left").withColumn(out, F.when(F.col("__common"), F.col(column)).otherwise(pooled)).drop("__level", "__common")


def one_hot(df: DataFrame, column: str, levels: list[str], drop_first: bool = False) -> DataFrame:
    """A 0/1 column per level; missing and unseen levels are all zeros (levels come from the training rows)."""
    used = sorted(levels)[int(drop_first) :]
    return df.withColumns({f"{column}_{level}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0)) for level in used})


def quantile_bins(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Adds ``bin`` (from 0): right-closed bins between exact quantiles of x, equal edges merged. NULL x has no bin."""
    edges = exact_quantiles(df, [], x, {f"e{i}": i / bins for i in range(bins + 1)})
    ends = edges.select(F.array_distinct(F.array(*(f"e{i}" for i in range(bins + 1)))).alias("__edges"))
    bin_ = F.size(F.filter(F.slice("__edges", F.lit(2), F.greatest(F.size("__edges") - 1, F.lit(1))), lambda e: e < F.col(x)))
    return df.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col(x).isNotNull(), bin_)).drop("__edges")  # one row


def usable(df: DataFrame, columns: list[str], least: int = 30) -> DataFrame:
    """(variable, n, usable): enough values and more than one distinct, in one pass (minimum and maximum differ)."""
    stats = df.agg(*(f.alias(f"__{n}_{c}") for c in columns for n, f in (("n", F.count(c)), ("v", F.min(c) < F.max(c)))))
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"__n_{c}").alias("n"), ((F.col(f"__n_{c}") >= least) & F.coalesce(F.col(f"__v_{c}"), F.lit(False))).alias("usable")) for c in columns))
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def choose_transforms(df: DataFrame, columns: list[str], least: int = 30) -> DataFrame:
    """(variable, transform): ``log`` if the skewness is over 1 and ln lessens it, all positive, enough rows; else ``none``."""
    picks = []
    for c in columns:
        log = F.when(F.col(c) > 0, F.ln(c))
        skewed = (F.abs(F.skewness(c)) > 1) & (F.abs(F.skewness(log)) < F.abs(F.skewness(c)))
        picks.append(F.when((F.count(c) >= least) & (F.min(c) > 0) & skewed, "log").otherwise("none").alias(c))
    stats = df.agg(*picks)
    return stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("transform")) for c in columns))).alias("r")).select("r.*")


def apply_transforms(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: transform(F.col(c), kind) for c, kind in kinds.items()})


def reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(feature, status, n, fraction): why values are there or missing; each rule is a CASE over the row.

    Counts are combined before the shuffle; the total is their sum per feature, as every row has one status each.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), rule.alias("status")) for k, rule in rules.items()))).alias("r")).select("r.*")
    counts = long.groupBy("feature", "status").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("__total"))
    return counts.join(totals, "feature").select("feature", "status", "n", F.try_divide(F.col("n"), F.col("__total")).alias("fraction"))
