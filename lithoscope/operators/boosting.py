"""Boosted regression trees as a grid of jobs: predictor sets x targets x repeats x folds.

While a fit's rows fit into a task, a job is one task: rows go to the jobs that train on them, as blocks of numbers (80 bytes
a row of eight columns, so 2 million rows are 160 MB). Histograms of all tasks, for each node of each tree of each job, would be
more to shuffle until a job has some ten million rows. Beyond ``max_rows`` rows the same fits are grown from histograms that the executors sum (``level_trees``), so every row is trained on, however many there
are. All rows are predicted, each by the model of its own fold. Missing values need no filling: a split sends them to the
better side.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Block, error_sums, packed, read
from .resampling import cluster_bootstrap, intervals, numbered, pooled_r2

COMBINATION = ["target", "set", "repeat"]


class Trees(NamedTuple):
    """Complete binary trees, a row each: nodes level by level, values up to the threshold go left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    leaves: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, every = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, missing_left, leaves in zip(*self[1:], strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                value = x[every, feature[node]]
                node = 2 * node + 1 + np.where(np.isnan(value), ~missing_left[node], value > threshold[node])
            out += leaves[node - len(feature)]
        return out


def best_splits(count: np.ndarray, total: np.ndarray, leaf: int, l2: float) -> tuple[np.ndarray, ...]:
    """Of each node the best (missing goes left, column, last code that goes left), and whether there is one.

    ``count`` and ``total`` are (node, column, code) histograms of rows and residuals; the last code is for missing values.
    """
    left_n, left_g = (np.cumsum(h[..., :-1], axis=2)[:, None] for h in (count, total))
    if (absent := count[..., -1:]).any():
        left_n = np.concatenate((left_n, left_n + absent[:, None]), 1)
        left_g = np.concatenate((left_g, left_g + total[:, None, :, -1:]), 1)
    n, g = (h[:, 0].sum(1)[:, None, None, None] for h in (count, total))
    score = lambda g, n: g * g / np.maximum(n + l2, 1e-12)
    gain = score(left_g, left_n) + score(g - left_g, n - left_n) - score(g, n)
    gain[(left_n < leaf) | (n - left_n < leaf)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    side, column, code = np.unravel_index(best, gain.shape[1:])
    return side == 1, column, code, flat[np.arange(len(flat)), best] > 1e-12


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 150, rate: float = 0.06, depth: int = 3, leaf: int = 15, l2: float = 1.0, bins: int = 255,
              cuts: list[np.ndarray] | None = None) -> Trees:
    """Squared-error boosting on columns cut at their quantiles, or at given ``cuts``; NaN is a missing value."""
    rows, columns = x.shape
    cuts = cuts if cuts is not None else [np.unique(np.quantile(v[~np.isnan(v)], np.linspace(0, 1, bins + 1)[1:-1])) if (~np.isnan(v)).any() else np.zeros(0) for v in x.T]
    codes = np.stack([np.where(np.isnan(v), bins, np.searchsorted(c, v)) for v, c in zip(x.T, cuts, strict=True)]).astype(np.uint8 if bins < 256 else np.int32)
    bounds = np.full((columns, bins), np.inf)
    for j, c in enumerate(cuts):
        bounds[j, : len(c)] = c
    every = np.arange(rows)
    feature, threshold = np.zeros((trees, 2**depth - 1), np.int32), np.full((trees, 2**depth - 1), np.inf)
    missing_left, leaves, base = np.ones(feature.shape, bool), np.zeros((trees, 2**depth)), float(y.mean())
    residual = y - base
    for t in range(trees):
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            at, first, cells = slice(2**level - 1, 2 ** (level + 1) - 1), node * (bins + 1), 2**level * (bins + 1)
            count, total = (np.zeros((2**level, columns, bins + 1)) for _ in range(2))
            for j, own in enumerate(codes):
                cell = first + own
                count[:, j] = np.bincount(cell, minlength=cells).reshape(-1, bins + 1)
                total[:, j] = np.bincount(cell, residual, cells).reshape(-1, bins + 1)
            side, column, code, found = best_splits(count, total, leaf, l2)
            column, code, side = np.where(found, column, 0), np.where(found, code, bins - 1), side | ~found  # all go left if no split is found
            feature[t, at], threshold[t, at], missing_left[t, at] = column, bounds[column, code], side
            own = codes[column[node], every]
            node = 2 * node + np.where(own == bins, ~side[node], own > code[node])
        n = np.bincount(node, minlength=2**depth)
        leaves[t] = rate * np.bincount(node, residual, 2**depth) / np.maximum(n + l2, 1e-12)
        residual -= leaves[t, node]
    return Trees(base, feature, threshold, missing_left, leaves)


def tree_grid(df: DataFrame, targets: list[str], sets: dict[str, list[str]], group: str, key: str, folds: int = 5, repeats: int = 3,
              trees: int = 150, max_rows: int = 2_000_000, seed: int = 0, target_of_fold: list[str] | None = None, fold_column: str | None = None) -> DataFrame:
    """(grp, target, set, repeat, n, sy, syy, see): sums of the out-of-fold predictions of each group.

    Every row with a target is predicted in every repeat by the model of the fold that holds its group, which trains on all
    rows of the other folds: in one task up to ``max_rows`` rows, level by level beyond; models are as many as jobs. Null groups are one group; null and NaN values are missing; rows without a target are
    left out of its jobs; a job without training rows predicts nothing; an empty table gives no row. With
    ``target_of_fold``, the model of fold f learns and predicts the f-th of these columns only. With ``fold_column`` the
    folds are given (0 to folds - 1) and there is one repeat.
    """
    if fold_column:
        repeats = 1
    wanted = lambda t, f: not target_of_fold or target_of_fold[f] == targets[t]
    if df.count() > max_rows:
        from .level_trees import boosted_sums

        return boosted_sums(df, targets, sets, group, key, folds, repeats, trees, seed=seed, target_of_fold=target_of_fold, fold_column=fold_column)
    columns, names = sorted({c for some in sets.values() for c in some}), list(sets)
    inside = [[columns.index(c) for c in sets[name]] for name in names]
    jobs = list(product(range(len(targets)), range(len(names)), range(repeats), range(folds)))
    blocks = cut(packed(df, columns, targets, group, key, folds, repeats, seed, fold_column))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b in read(batch):
                for i, (t, s, r, f) in enumerate(jobs):
                    on = np.flatnonzero((b.folds[r] != f) & ~np.isnan(b.y[t])) if wanted(t, f) else ()
                    if len(on):
                        cells = [np.ascontiguousarray(v).tobytes() for v in (b.key[on], b.x[inside[s]][:, on], b.y[t, on])]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([len(on)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["job", "n", "key", "x", "y"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        job = int(frame["job"].iloc[0])
        key, x, y = (np.concatenate([np.frombuffer(v, kind).reshape(-1, n) for v, n in zip(frame[c], frame["n"], strict=True)], 1) for c, kind in (("key", np.int64), ("x", float), ("y", float)))
        order = np.lexsort((y[0], key[0]))
        model = fit_trees(x[:, order].T, y[0, order], trees)
        return pd.DataFrame([{"job": job, "base": model.base, **{f: v.ravel() for f, v in model._asdict().items() if f != "base"}}])

    dealt = blocks.mapInArrow(deal, "job int, n int, key binary, x binary, y binary").repartition(len(jobs), "job")
    fitted = dealt.groupBy("job").applyInPandas(fit, "job int, base double, feature array<int>, threshold array<double>, missing_left array<boolean>, leaves array<double>")
    models = {m["job"]: Trees(m["base"], *(np.array(m[f]).reshape(trees, -1) for f in Trees._fields[1:])) for m in fitted.collect()}  # one row a job
    shared = df.sparkSession.sparkContext.broadcast(models)

    def held(b: Block) -> Iterator[tuple]:
        for i, (t, s, r, f) in enumerate(jobs):
            on = np.flatnonzero((b.folds[r] == f) & ~np.isnan(b.y[t])) if i in shared.value else ()
            if len(on):
                yield (targets[t], names[s], r), on, b.y[t, on], shared.value[i].predict(np.ascontiguousarray(b.x[inside[s]][:, on].T))

    return error_sums(blocks, held, {"target": "string", "set": "string", "repeat": "int"})


def grid_draws(sums: DataFrame, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """(b, target, set, r2): the mean over the repeats of each draw of groups, the same draws for all models.

    Groups of any type are numbered in order of a 52-bit hash; groups whose hashes are equal are drawn together.
    """
    models = sums.withColumn("__hash", F.shiftrightunsigned(F.xxhash64("grp"), 12))
    groups = numbered(models.select("__hash").distinct(), "__hash")
    boot = cluster_bootstrap(models.join(groups, "__hash"), groups.count(), n_boot, seed, tuple(COMBINATION))
    return boot.groupBy("b", "target", "set").agg(F.avg("r2").alias("r2"))


def arm_draws(sums: DataFrame, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """(b, target, model, r2) of sums with a ``model`` column, as ``grid_draws``."""
    return grid_draws(sums.withColumnRenamed("model", "set"), n_boot, seed).withColumnRenamed("set", "model")


def arm_report(sums: DataFrame, boot: DataFrame) -> DataFrame:
    """(target, model, n, r2, ci_lo, ci_hi, delta_r2, delta_lo, delta_hi) of joint and separate arms; deltas are joint less separate."""
    named = lambda df: df.withColumnRenamed("model", "set")
    scores = grid_scores(named(sums), named(boot)).withColumnRenamed("set", "model")
    delta = grid_contrasts(named(sums), named(boot), "joint").select("target", "delta_r2", F.col("ci_lo").alias("delta_lo"), F.col("ci_hi").alias("delta_hi"))
    return scores.join(delta, "target").select("target", "model", "n", "r2", "ci_lo", "ci_hi", "delta_r2", "delta_lo", "delta_hi")


def grid_scores(sums: DataFrame, boot: DataFrame) -> DataFrame:
    """(target, set, r2, r2_sd_repeats, n, ci_lo, ci_hi)."""
    per = pooled_r2(sums, COMBINATION).groupBy("target", "set").agg(F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("r2_sd_repeats"), F.max("n").alias("n"))
    return per.join(intervals(boot, ["target", "set"]), ["target", "set"])


def grid_contrasts(sums: DataFrame, boot: DataFrame, base: str) -> DataFrame:
    """(target, contrast, delta_r2, ci_lo, ci_hi) of the base set less every other, paired by draw."""
    def less(df: DataFrame, by: list[str]) -> DataFrame:
        first = df.filter(F.col("set") == base).select(*by, F.col("r2").alias("__base"))
        return df.filter(F.col("set") != base).join(first, by).select(*by, F.concat(F.lit(f"{base} - "), "set").alias("contrast"), (F.col("__base") - F.col("r2")).alias("d"))

    means = pooled_r2(sums, COMBINATION).groupBy("target", "set").agg(F.avg("r2").alias("r2"))
    delta = less(means, ["target"]).withColumnRenamed("d", "delta_r2")
    return delta.join(intervals(less(boot, ["b", "target"]), ["target", "contrast"], "d"), ["target", "contrast"])
