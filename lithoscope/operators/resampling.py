"""Grouped folds and cluster bootstraps without materialised resamples.

A bootstrap draws whole groups, so a resample is a weight per group: R2 of every draw is a sum of weighted group sums
(n, sum y, sum y^2, sum e^2). Weights follow from the seed and a group's number alone, so each task makes its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 0, fine: int = 1000) -> DataFrame:
    """Adds ``fold`` (0 to k-1); a group never spans folds, and folds are about equal in rows.

    Groups larger than 1 / (fine * k) of all rows, of which there are at most fine * k, are dealt on the driver, the
    largest first to the lightest fold (ties by a hash); smaller ones go by a hash, which balances them. NULL is a group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    large = sizes.filter(F.col("__n") * fine * k > total).select(group, "__n", F.xxhash64(F.col(group), F.lit(seed)).alias("__h")).collect()
    load, dealt = [0] * k, []
    for row in sorted(large, key=lambda r: (-r["__n"], r["__h"])):
        fold = min(range(k), key=lambda i: (load[i], i))
        load[fold] += row["__n"]
        dealt.append((row[group], fold))
    spread = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)).cast("int")
    if not dealt:
        return df.withColumn("fold", spread)
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(dealt, f"__g {kind}, __fold int")  # at most fine * k rows
    return df.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("fold", F.coalesce("__fold", spread)).drop("__g", "__fold")


def cluster_weights(groups: np.ndarray, n_groups: int, n_boot: int, seed: int = 0) -> np.ndarray:
    """How often each of ``groups`` (distinct numbers below ``n_groups``) is in each draw of n_groups with replacement: (group, draw).

    An exact multinomial by halving: of the draws that fall into a range of numbers, a binomial share falls into its lower
    half, drawn by a generator of (seed, range) alone. So any task finds the same weights for any group by itself, in
    log2(n_groups) steps, and a draw's weights sum to n_groups over all groups.
    """
    out, order = np.zeros((len(groups), n_boot), np.int64), np.argsort(groups)
    ordered = np.asarray(groups)[order]
    todo = [(0, n_groups, 0, len(groups), np.full(n_boot, n_groups, np.int64))] if len(groups) else []
    while todo:
        low, high, first, last, drawn = todo.pop()
        if high - low == 1:
            out[order[first:last]] = drawn
            continue
        middle = (low + high) // 2
        share = np.random.default_rng([seed & 0xFFFFFFFF, low, high]).binomial(drawn, (middle - low) / (high - low))
        at = first + int(np.searchsorted(ordered[first:last], middle))
        todo += [t for t in ((low, middle, first, at, share), (middle, high, at, last, drawn - share)) if t[2] < t[3]]
    return out


def bootstrap_sums(rows: DataFrame, by: list[str], cells: list[str], n_groups: int, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, by, cells): sums of the cells over each draw of groups, whose number is the column ``g``.

    Tasks weight their own rows and pass on one row a draw and key; there is no table of draws. A null cell counts as 0.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for f in frames:
            if not len(f):
                continue
            number, at = np.unique(f["g"].to_numpy(), return_inverse=True)
            weights = cluster_weights(number, n_groups, n_boot, seed).astype(float)
            values = np.nan_to_num(f[cells].to_numpy(float))
            for key, places in (f.groupby(by, dropna=False, sort=False).indices.items() if by else [((), np.arange(len(f)))]):
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0) + weights[at[places]].T @ values[places]
        for key, sums in held.items():
            yield pd.DataFrame({"b": np.arange(n_boot), **dict(zip(by, key)), **dict(zip(cells, sums.T))})

    made = rows.select("g", *by, *(F.col(c).cast("double").alias(c) for c in cells)).mapInPandas(weigh, ", ".join(["b long", *([kinds] if by else []), *(f"`{c}` double" for c in cells)]))
    return made.groupBy("b", *by).agg(*(F.sum(c).alias(c) for c in cells))


def numbered(groups: DataFrame, group: str) -> DataFrame:
    """Adds ``g``, a gapless number from 0 in order of the group: a running count over ranges, not one global window."""
    from .ranking import value_places

    return groups.join(value_places(groups.select(group).distinct(), [], group).select(group, F.col("before").alias("g")), group)


def group_sums(df: DataFrame, group: str, models: dict[str, str], y: str) -> DataFrame:
    """(group, model, n, sy, syy, see) from one row per observation with a prediction column per model."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred")) for m, c in models.items()))
    long = df.select(group, F.col(y).cast("double").alias("y"), F.explode(rows).alias("r")).select(group, "y", "r.*").na.drop()
    return long.groupBy(group, "model").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.pow(F.col("y") - F.col("pred"), 2)).alias("see"))


def draw_r2(t: DataFrame, by: list[str]) -> DataFrame:
    """(b, by, r2) of summed draws; NULL if a draw has no spread."""
    sst = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), "n")
    return t.select("b", *by, (1 - F.try_divide(F.col("see"), F.when(sst > 0, sst))).alias("r2"))


def bootstrap_r2(sums: DataFrame, draws: DataFrame) -> DataFrame:
    """(b, model, r2) of ``sums`` with a group number ``g``, for given draws (b, g, w)."""
    w = F.col("w")
    return draw_r2(sums.join(draws, "g").groupBy("b", "model").agg(*(F.sum(w * F.col(c)).alias(c) for c in ("n", "sy", "syy", "see"))), ["model"])


def cluster_bootstrap(sums: DataFrame, n_groups: int, n_boot: int = 300, seed: int = 0, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """(b, by, r2) of ``sums`` with a group number ``g``, over random draws of groups, the same for all models."""
    return draw_r2(bootstrap_sums(sums, list(by), ["n", "sy", "syy", "see"], n_groups, n_boot, seed), list(by))


def pooled_r2(sums: DataFrame, by: list[str]) -> DataFrame:
    t = sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "sy", "syy", "see")))
    sst = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), "n")
    return t.select(*by, "n", (1 - F.try_divide(F.col("see"), F.when(sst > 0, sst))).alias("r2"))


def intervals(boot: DataFrame, by: list[str], value: str = "r2") -> DataFrame:
    """2.5 and 97.5 percentiles over the draws (a bounded number per group)."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return boot.groupBy(*by).agg(p.alias("p")).select(*by, F.col("p")[0].alias("ci_lo"), F.col("p")[1].alias("ci_hi"))


def paired_differences(boot: DataFrame, base: str, others: list[str]) -> DataFrame:
    """(contrast, mean, ci_lo, ci_hi) of base less other on the same draws, by one pivot."""
    wide = boot.groupBy("b").pivot("model", [base, *others]).agg(F.first("r2"))
    rows = F.array(*(F.struct(F.lit(f"{base} - {o}").alias("contrast"), (F.col(base) - F.col(o)).alias("d")) for o in others))
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return long.groupBy("contrast").agg(F.avg("d").alias("mean")).join(intervals(long, ["contrast"], "d"), "contrast")


def permute(df: DataFrame, columns: list[str], key: list[str], seed: int = 0, block: int = 4096) -> DataFrame:
    """The named columns moved together to other rows: a random permutation within random blocks of about ``block`` rows.

    A row's block and its places in two random orders of the block are hashes of its key and the seed, so the result does
    not depend on partitioning. The row at a place of the one order takes the values at that place of the other.
    """
    from pyspark.sql import Window

    n = df.count()
    placed = df.withColumn("__block", F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(2)), F.lit(max(1, n // block))))
    place = lambda salt: F.row_number().over(Window.partitionBy("__block").orderBy(F.xxhash64(*key, F.lit(seed), F.lit(salt)), *key))
    given = placed.select("__block", place(1).alias("__place"), *(F.col(c).alias(f"permuted_{c}") for c in columns))
    return placed.withColumn("__place", place(0)).join(given, ["__block", "__place"]).drop("__block", "__place")
