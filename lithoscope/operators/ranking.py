"""Exact ranks and quantiles of keyed values without a window over a whole key.

A window ordered over a key puts that key into one task; a key may hold a third of all rows. Here equal values of a
key are counted first (combined before the shuffle), then split at approximate quantiles of the key into blocks, and
only blocks are ordered: a value's place is its block's offset plus its place in the block. Offsets are sums over at
most ``blocks`` rows per key. Everything is exact; the approximation only decides where blocks end. There are as many
blocks as a key needs to keep all tasks of a shuffle busy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enough_blocks(df: DataFrame) -> int:
    """The power of two, from 64 to 4096, that is at least four times the shuffle partitions."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(4096, max(64, 1 << (4 * tasks - 1).bit_length()))


def value_places(df: DataFrame, keys: list[str], value: str, blocks: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per key and distinct non-null value: (keys, value, n, before, total); ``blocks`` is a power of two. A row of
    ``df`` stands for as many as its ``weight`` says.

    ``n`` rows hold the value, ``before`` rows of the key hold smaller ones, ``total`` rows hold any. NULL keys form
    a key of their own.
    """
    blocks = blocks or enough_blocks(df)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    ends = [i / blocks for i in range(1, blocks)]
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    drop = [f"__k{i}" for i in range(len(keys))]
    splits = counts.groupBy(*renamed).agg(F.percentile_approx(value, F.lit(ends), F.lit(10 * blocks)).alias("__splits"))
    joined = counts.join(splits, on=same).drop(*drop) if keys else counts.crossJoin(F.broadcast(splits))  # without keys: one row
    placed, step = joined.withColumn("__block", F.lit(0)), blocks // 2
    while step:  # binary search for the number of splits below the value, a projection a step, all in generated code
        placed = placed.withColumn("__block", F.col("__block") + F.when(F.get("__splits", F.col("__block") + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    placed = placed.drop("__splits")
    per_block = placed.groupBy(*keys, "__block").agg(F.sum("n").alias("__rows"))
    up_to = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *renamed, F.col("__block").alias("__b"),
        F.coalesce(F.sum("__rows").over(up_to), F.lit(0)).alias("__offset"), F.sum("__rows").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, on=[F.col("__block") == F.col("__b"), *same]).select(*keys, value, "n", (F.col("__before") + F.col("__offset")).alias("before"), "total")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank", blocks: int | None = None) -> DataFrame:
    """(keys, value, rank): ties share the mean of their ranks."""
    places = value_places(df, keys, value, blocks)
    return places.select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], blocks: int | None = None) -> DataFrame:
    """(keys, n, one column per prob): linearly interpolated quantiles (those of ``percentile``) per key.

    A quantile lies between the values at two places; a row of ``value_places`` tells by itself whether it holds
    them, so that each is picked by a filtered aggregate.
    """
    places = value_places(df, keys, value, blocks)
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    picks = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("total") - 1)
        picks += [F.max(F.when(holds(F.floor(h)), F.col(value))).alias(f"__lo_{name}"), F.max(F.when(holds(F.ceil(h)), F.col(value))).alias(f"__hi_{name}")]
    out = places.groupBy(*keys).agg(F.max("total").alias("n"), *picks)
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n") - 1)
        out = out.withColumn(name, F.col(f"__lo_{name}") + (h - F.floor(h)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")))
    return out.select(*keys, "n", *probs)
