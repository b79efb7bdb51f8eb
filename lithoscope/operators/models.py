"""Linear models from sums of products per fold, nearest neighbours in blocks, and MLlib's forests.

One aggregate gives each fold's matrix of products; training sets are differences of such matrices, and fits, paths,
validation errors and components follow on the driver from (k+2) x (k+2) numbers. The data are read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranking import average_ranks, exact_quantiles
from .stats import as_matrix, product_sums


def fold_matrices(df: DataFrame, columns: list[str], fold: str = "fold") -> dict:
    """fold -> matrix of ``[1, *columns]``; rows with a missing value go. Folds are few by definition."""
    used = df.select(fold, *columns).na.drop()
    return {r[fold]: as_matrix(r, len(columns) + 1) for r in used.groupBy(fold).agg(*product_sums(columns)).collect()}


def standardised(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, population sds (0 becomes 1), covariance of the k standardised predictors and with the remaining columns."""
    mean = g[0] / g[0, 0]
    cov = g / g[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))[1 : k + 1]
    sd = np.where(sd > 1e-12, sd, 1.0)
    return mean, sd, cov[1 : k + 1, 1 : k + 1] / np.outer(sd, sd), cov[1 : k + 1, k + 1 :] / sd[:, None]


def error_sum(g: np.ndarray, coefficients: np.ndarray, y: int) -> float:
    """Sum of squared errors of ``[1, x] @ coefficients`` for column y of matrix g."""
    v = np.zeros(len(g))
    v[: len(coefficients)], v[y] = -coefficients, 1.0
    return float(max(v @ g @ v, 0.0))


def raw_coefficients(b: np.ndarray, mean: np.ndarray, sd: np.ndarray, mean_y: float) -> np.ndarray:
    slope = b / sd
    return np.r_[mean_y - slope @ mean[1 : len(b) + 1], slope]


def lasso_path(c: np.ndarray, xy: np.ndarray, alphas: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Coefficients for falling penalties by coordinate descent on the covariance (objective: half mean square plus penalty)."""
    b, out = np.zeros(len(xy)), []
    for alpha in alphas:
        for _ in range(rounds):
            before = b.copy()
            for j in np.flatnonzero(np.diag(c) > 1e-12):
                rest = xy[j] - c[j] @ b + c[j, j] * b[j]
                b[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / c[j, j]
            if np.abs(b - before).max(initial=0.0) < tolerance:
                break
        out.append(b.copy())
    return np.array(out)


def lasso_1se(matrices: dict, k: int, n_alpha: int = 60) -> tuple[float, list[float]]:
    """The largest relative penalty whose mean error is within a standard error of the least; errors of all penalties."""
    relative, total, errors = np.geomspace(1.0, 1e-3, n_alpha), sum(matrices.values()), []
    for held in matrices.values():
        mean, sd, c, xy = standardised(total - held, k)
        top = np.abs(xy[:, 0]).max()
        path = lasso_path(c, xy[:, 0], relative * top) if top > 0 else np.zeros((n_alpha, k))
        errors.append([error_sum(held, raw_coefficients(b, mean, sd, mean[k + 1]), k + 1) / held[0, 0] for b in path])
    errors = np.array(errors)
    average, se = errors.mean(0), errors.std(0, ddof=1) / np.sqrt(len(errors)) if len(errors) > 1 else 0 * errors[0]
    best = int(average.argmin())
    return float(relative[np.flatnonzero(average <= average[best] + se[best])[0]]), average.tolist()


def lasso(g: np.ndarray, k: int, relative: float) -> np.ndarray:
    """Standardised coefficients at a penalty relative to the one that leaves none."""
    _, _, c, xy = standardised(g, k)
    top = np.abs(xy[:, 0]).max()
    return lasso_path(c, xy[:, 0], np.geomspace(1.0, relative, 10) * top)[-1] if top > 0 else np.zeros(k)


def ols_coefficients(g: np.ndarray, k: int) -> np.ndarray:
    return np.linalg.pinv(g[: k + 1, : k + 1]) @ g[: k + 1, k + 1]


def pls_parts(c: np.ndarray, xy: np.ndarray, components: int) -> tuple[list, list, list]:
    """Directions on standardised X, loadings of X and of Y of 1, 2, ... components, from covariances alone; directions are the
    first singular vectors of what the components before have left."""
    left, directions, loads, answers = xy.copy(), [], [], []
    for _ in range(min(components, len(c))):
        w = np.linalg.svd(left, full_matrices=False)[0][:, 0]
        r = w - sum((p @ w * q for p, q in zip(loads, directions)), np.zeros(len(w)))
        scale = r @ c @ r
        if scale < 1e-12:
            break
        p, q = c @ r / scale, left.T @ r / scale
        left = left - np.outer(p, q) * scale
        directions, loads, answers = [*directions, r], [*loads, p], [*answers, q]
    return directions, loads, answers


def pls_coefficients(c: np.ndarray, xy: np.ndarray, components: int) -> list[np.ndarray]:
    """Coefficients (standardised X to Y) after 1, 2, ... components."""
    directions, _, answers = pls_parts(c, xy, components)
    return [np.array(directions[:a]).T @ np.array(answers[:a]) for a in range(1, len(directions) + 1)]


def pls_loadings(g: np.ndarray, names: list[str], targets: list[str], components: int = 2) -> list[tuple[str, str, int, float]]:
    """(side, variable, component, loading) of all standardised rows, from their matrix of ``[1, *names, *targets]``. A component's
    sign is such that its largest loading of X is positive."""
    k = len(names)
    mean, _, c, xy = standardised(g, k)
    sd_y = np.sqrt(np.clip(np.diag(g)[k + 1 :] / g[0, 0] - mean[k + 1 :] ** 2, 0, None))
    out = []
    for a, (_, p, q) in enumerate(zip(*pls_parts(c, xy / np.where(sd_y > 1e-12, sd_y, 1.0), components), strict=True), 1):
        sign = 1.0 if p[np.abs(p).argmax()] > 0 else -1.0
        out += [("x", n, a, float(sign * v)) for n, v in zip(names, p)] + [("y", n, a, float(sign * v)) for n, v in zip(targets, q)]
    return out


def pls_q2(matrices: dict, k: int, n_targets: int, components: int = 6) -> list[float]:
    """Cumulative Q2 by number of components, pooled over folds and targets that are scaled by the training rows."""
    total, press, spread = sum(matrices.values()), np.zeros(components), 0.0
    for held in matrices.values():
        train = total - held
        mean, sd, c, xy = standardised(train, k)
        sd_y = np.sqrt(np.diag(train)[k + 1 :] / train[0, 0] - mean[k + 1 :] ** 2)
        sd_y = np.where(sd_y > 1e-12, sd_y, 1.0)
        fits = pls_coefficients(c, xy / sd_y, components)
        for t in range(n_targets):
            scale = sd_y[t] ** 2
            spread += error_sum(held, np.array([mean[k + 1 + t]]), k + 1 + t) / scale
            for a in range(components):
                b = fits[min(a, len(fits) - 1)][:, t] * sd_y[t]
                press[a] += error_sum(held, raw_coefficients(b, mean, sd, mean[k + 1 + t]), k + 1 + t) / scale
    return (1 - press / spread).tolist()


def out_of_fold(df: DataFrame, columns: list[str], coefficients: dict, fold: str = "fold", name: str = "pred") -> DataFrame:
    """Adds each row's prediction by the model of its fold: a CASE over the (few) folds, no join."""
    expression = F.lit(None).cast("double")
    for key, b in coefficients.items():
        value = sum((float(v) * F.col(c) for v, c in zip(b[1:], columns)), F.lit(float(b[0])))
        expression = F.when(F.col(fold).eqNullSafe(F.lit(key)), value).otherwise(expression)
    return df.withColumn(name, expression)


def fit_preparation(train: DataFrame, columns: list[str], flag_over: float = 0.02) -> dict:
    """Medians, columns that get a missing flag (equal patterns once), learnt from training rows only."""
    n = train.count()
    medians = {}
    long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")).select("r.*")
    for row in exact_quantiles(long, ["c"], "v", {"m": 0.5}).collect():
        medians[row["c"]] = (row["m"], row["n"])
    missing = [c for c in columns if n and 1 - medians.get(c, (0, 0))[1] / n > flag_over]
    unlike = lambda a, b: F.count_if(F.col(a).isNull() != F.col(b).isNull())
    tests = {(a, b): unlike(a, b).alias(f"{i}") for i, (a, b) in enumerate(combinations(missing, 2))}
    counts = train.agg(*tests.values()).first() if tests else []
    repeats = {b for (_, b), n in zip(tests, counts) if n == 0}
    flags = [c for c in missing if c not in repeats]
    return {"medians": {c: medians.get(c, (0.0, 0))[0] for c in columns}, "flags": flags}


def prepare(df: DataFrame, fitted: dict) -> DataFrame:
    """Missing values filled with the learnt medians, and a 0/1 column per flagged one."""
    flags = {f"NA_{c}": F.col(c).isNull().cast("double") for c in fitted["flags"]}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in fitted["medians"].items()})


def nearest_of_block(v: np.ndarray, qi: np.ndarray, own: np.ndarray, inside: np.ndarray, r: np.ndarray, ri: np.ndarray, part: np.ndarray, k: int, limit: np.ndarray | None = None) -> pd.DataFrame:
    """(query, neighbour, d2): the k nearest rows r of each query v among those that are ``inside`` and of another part.

    One product of matrices gives distances up to rounding; rows within that of the k-th, or of the query's ``limit`` if all have
    one, are measured again, exactly.
    """
    inside = inside & (part != own[:, None])
    qq, rr = (v * v).sum(1)[:, None], (r * r).sum(1)
    with np.errstate(invalid="ignore", over="ignore"):
        if limit is not None and np.isfinite(limit).all():
            at, row = np.nonzero((qq + rr - 2 * (v @ r.T) <= limit[:, None] + 1e-9 * (qq + rr)) & inside)
        else:
            about = np.where(inside, qq + rr - 2 * (v @ r.T), np.inf)
            last = np.partition(about, k - 1, axis=1)[:, k - 1 : k] if k < len(r) else np.full((len(v), 1), np.inf)
            at, row = np.nonzero(inside & ((about <= last + 1e-9 * (qq + rr)) | ~np.isfinite(last)))
        d2 = ((r[row] - v[at]) ** 2).sum(1)
    order = np.lexsort((ri[row], d2, at))
    at, row, d2 = at[order], row[order], d2[order]
    on = np.arange(len(at)) - np.searchsorted(at, at) < k
    return pd.DataFrame({"query": qi[at[on]], "neighbour": ri[row[on]], "d2": d2[on]})


def neighbouring(points: np.ndarray) -> np.ndarray:
    """The points in an order that halves them at the middle of their widest dimension, and the halves in turn."""
    out, left = [], [np.arange(len(points))]
    while left:
        own = left.pop()
        if len(own) < 3:
            out.append(own)
            continue
        order = own[np.argsort(points[own, np.ptp(points[own], axis=0).argmax()], kind="stable")]
        left += [order[len(own) // 2 :], order[: len(own) // 2]]
    return np.concatenate(out)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 1024, max_pivots: int = 512, asked_rows: int = 8192, held_rows: int = 65_536) -> DataFrame:
    """(query, neighbour, d2): the k nearest rows of each query, itself left out; exact, ties by id.

    Both frames are (id long, v array<double>) of equal length; if they have a column ``part`` too, a query's neighbours are
    of other parts than its own (folds). Rows belong to the cell of their nearest pivot, a sample of
    at most ``max_pivots`` rows. A query first searches its nearest cells until they hold more than k rows; the k-th distance
    found there is its radius. By the triangle inequality another cell can only help if its pivot is nearer than the radius
    and the cell's own reach together, and a row of it only if its distance to the pivot differs from the query's by at most
    the radius; a block also only if its bounding box is that near. A task searches about ``held_rows`` rows, in blocks of
    about ``block``, for at most about ``asked_rows`` queries of cells that lie together: what is shuffled goes by such pairs of rows
    and queries, not by a query and each of its cells, and a dense cell is many tasks.
    """
    queries, rows = (df.select("id", "v", F.col("part" if "part" in df.columns else "id").cast("long").alias("part")) for df in (queries, rows))
    n = rows.count()
    drawn = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(int(max(1, min(max_pivots, round(n**0.5))))).collect()
    if not drawn:
        return queries.sparkSession.createDataFrame([], "query long, neighbour long, d2 double")
    pivots = np.array([r["v"] for r in drawn])
    pivots = pivots[neighbouring(pivots)]

    def reach(v: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Distances of vectors to the pivots."""
        return np.concatenate([np.sqrt(((v[i : i + 256, None] - pivots[cells][None]) ** 2).sum(2)) for i in range(0, len(v), 256)])

    def placed(frames):
        for f in frames:
            if len(f):
                d = reach(np.stack(f["v"]))
                cell = d.argmin(1)
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "part": f["part"], "cell": cell.astype(np.int32), "far": d[np.arange(len(d)), cell]})

    home = "id long, v array<double>, part long, cell int, far double"
    members, asking = cut(rows.mapInPandas(placed, home)), cut(queries.mapInPandas(placed, home))
    sizes, asked_sizes, wide = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a pivot
        sizes[r["cell"]], wide[r["cell"]] = r["n"], np.nan_to_num(r["far"], nan=np.inf)
    for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect():
        asked_sizes[r["cell"]] = r["n"]
    start, parts = np.cumsum(sizes) - sizes, -(-sizes // block)
    slices = start // held_rows, (start + np.maximum(parts - 1, 0) * block) // held_rows  # the first and last of a cell
    of_cell = lambda numbers, c="cell": F.get(F.lit(np.asarray(numbers).astype(int).tolist()).cast("array<long>"), F.col(c))
    hashed = lambda count: F.pmod(F.xxhash64("id"), of_cell(np.maximum(count, 1)))

    def held_block(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"cell": f["cell"].iloc[0], "b": f["b"].iloc[0], "id": f["id"].to_numpy().tobytes(), "v": np.stack(f["v"]).tobytes(), "part": f["part"].to_numpy().tobytes(), "far": f["far"].to_numpy().tobytes()}])

    blocks = cut(members.withColumn("b", hashed(parts)).groupBy("cell", "b").applyInPandas(held_block, "cell int, b long, id binary, v binary, part binary, far binary"))
    blocks = blocks.withColumn("s", F.floor((of_cell(start) + F.col("b") * block) / held_rows))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    asked_rows, tasks = int(min(asked_rows, max(block, asked_sizes.sum() // (2 * cores)))), max(4 * cores, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = -(-asked_sizes // asked_rows)
    first_place = (np.cumsum(asked_sizes) - asked_sizes) // asked_rows
    asking = asking.withColumn("g", F.when(of_cell(many) > 1, -1 - of_cell(np.cumsum(many) - many) - hashed(many)).otherwise(of_cell(first_place)))

    def search(asking: DataFrame) -> DataFrame:
        """The k nearest within the radius of each query, or in its nearest cells where it has none, of each task."""
        def asked_block(f: pd.DataFrame) -> pd.DataFrame:
            v, radius = np.stack(f["v"]), f["radius"].to_numpy(float) * (1 + 1e-9) + 1e-12
            d, limit = reach(v), np.full(len(f), np.inf)
            if not f["wider"].iloc[0] and n > k:
                order = np.argsort(d, axis=1, kind="stable")
                last = (np.cumsum(sizes[order], 1) > k).argmax(1)
                limit = d[np.arange(len(d)), order[np.arange(len(d)), last]] * (1 + 1e-12)
            cells = np.flatnonzero((~(d > limit[:, None]) & ~(d - wide > radius[:, None])).any(0) & (sizes > 0))
            s = sorted({i for c in cells for i in range(slices[0][c], slices[1][c] + 1)})
            return pd.DataFrame([{"g": f["g"].iloc[0], "cells": cells.astype(int).tolist(), "slices": [int(i) for i in s], "id": f["id"].to_numpy().tobytes(), "v": v.tobytes(), "part": f["part"].to_numpy().tobytes(), "radius": radius.tobytes(), "near": limit.tobytes()}])

        def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return pd.DataFrame({"query": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "d2": np.zeros(0)})
            qi, own, radius, limit = (np.frombuffer(asked[c].iloc[0], kind).copy() for c, kind in (("id", np.int64), ("part", np.int64), ("radius", float), ("near", float)))
            v = np.frombuffer(asked["v"].iloc[0]).reshape(len(qi), -1)
            d2, found = np.full((len(qi), k), np.nan), np.full((len(qi), k), np.iinfo(np.int64).max)
            cells, place = np.unique(held["cell"].to_numpy(), return_inverse=True)
            near = reach(v, cells)
            for i in near.mean(0)[place].argsort(kind="stable"):
                r = held.iloc[i]
                ri, part, far = (np.frombuffer(r[c], kind) for c, kind in (("id", np.int64), ("part", np.int64), ("far", float)))
                x, d = np.frombuffer(r["v"]).reshape(len(ri), -1), near[:, place[i]]
                gap = np.maximum(np.maximum(np.fmin.reduce(x) - v, v - np.fmax.reduce(x)), 0)
                reached = np.flatnonzero(~(d > limit) & ~(d - wide[cells[place[i]]] > radius) & ~((gap * gap).sum(1) > radius * radius * (1 + 1e-9)))
                for on in (reached[j : j + 1024] for j in range(0, len(reached), 1024)):
                    new = nearest_of_block(v[on], np.arange(len(on)), own[on], ~(np.abs(far - d[on, None]) > radius[on, None]), x, ri, part, k, radius[on] ** 2)
                    if not len(new):
                        continue
                    at = new["query"].to_numpy()
                    some, first = np.unique(at, return_index=True)
                    both_d, both_i = np.full((len(some), 2 * k), np.nan), np.full((len(some), 2 * k), np.iinfo(np.int64).max)
                    both_d[:, :k], both_i[:, :k] = d2[on[some]], found[on[some]]
                    to = np.searchsorted(some, at), k + np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                    both_d[to], both_i[to] = new["d2"], new["neighbour"]
                    order = np.lexsort((both_i, both_d))[:, :k]
                    d2[on[some]], found[on[some]] = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_i, order, 1)
                    radius[on[some]] = np.fmin(radius[on[some]], np.sqrt(d2[on[some], k - 1]) * (1 + 1e-9) + 1e-12)
            at, j = np.nonzero(found < np.iinfo(np.int64).max)
            return pd.DataFrame({"query": qi[at], "neighbour": found[at, j], "d2": d2[at, j]})

        asked = cut(asking.groupBy("g").applyInPandas(asked_block, "g long, cells array<int>, slices array<long>, id binary, v binary, part binary, radius binary, near binary"))
        held = asked.select(F.col("g").alias("for_g"), F.explode("cells").alias("cell")).join(blocks, "cell").withColumnRenamed("s", "for_s").repartition(tasks, "for_g", "for_s")  # few bytes, much work
        asked = asked.withColumn("s", F.explode("slices")).drop("cells", "slices").repartition(tasks, "g", "s")
        return asked.groupBy("g", "s").cogroup(held.groupBy("for_g", "for_s")).applyInPandas(best, "query long, neighbour long, d2 double")

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy("d2", "neighbour")
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    near = top(search(asking.withColumns({"radius": F.lit(float("inf")), "wider": F.lit(False)})))
    radius = cut(near.filter(F.col("place") == k).select(F.col("query").alias("id"), F.nanvl(F.sqrt("d2"), F.lit(float("inf"))).alias("r")))
    wider = asking.join(radius, "id", "left").withColumns({"radius": F.coalesce("r", F.lit(float("inf"))), "wider": F.lit(True)})
    return top(search(wider)).drop("place")


def filled(x: np.ndarray, train: np.ndarray, flag_over: float = 0.02) -> np.ndarray:
    """``fit_preparation`` and ``prepare`` within a task: NaN filled with medians of the rows ``train``, then a flag for each pattern of gaps."""
    absent = np.isnan(x)
    medians = np.array([np.median(v[train & ~a]) if (train & ~a).any() else 0.0 for v, a in zip(x.T, absent.T)])
    flags = {absent[train, j].tobytes(): j for j in reversed(range(x.shape[1])) if train.any() and absent[train, j].mean() > flag_over}
    return np.column_stack([np.where(absent, medians, x), absent[:, sorted(flags.values())]])


def grown_predictions(x: np.ndarray, y: np.ndarray, weight: np.ndarray, orders: list[np.ndarray], held: np.ndarray, rng: np.random.Generator, depth: int, leaf: int, share: float) -> np.ndarray:
    """What a regression tree on the rows that have a weight says of the rows ``held``, which go down while it grows.

    ``x`` is (column, row), ``orders`` are the rows that may have a weight by the value of each column. A level of all nodes is a
    few passes over each column: rows lie in order of (node, value); all left children come before all right ones, which keeps it.
    """
    used, place = np.flatnonzero(weight > 0), np.cumsum(weight > 0) - 1
    orders, asked, going, pred = [place[o[weight[o] > 0]] for o in orders], x[:, held], np.arange(len(held)), np.zeros(len(held))
    x, y, weight, chosen, nodes = np.ascontiguousarray(x[:, used]), y[used], weight[used], int(np.ceil(share * len(x))), 1
    node, own_node, every = np.zeros(len(used), np.intp), np.zeros(len(held), np.intp), np.arange(len(used))  # of training rows, of those asked, training rows that are left
    for level in range(depth + 1):
        at, nth = node[orders[0]], node[every]
        starts = np.searchsorted(at, np.arange(nodes))
        target, w = y[orders[0]], weight[orders[0]]
        m = np.bincount(at, w, nodes)
        mean = np.bincount(at, w * target, nodes) / m
        wanted = (np.bincount(own_node[going], minlength=nodes) > 0) & (m >= 2 * leaf) & (np.minimum.reduceat(target, starts) < np.maximum.reduceat(target, starts)) & (level < depth)
        allowed = (rng.random((nodes, len(x))).argsort(1) < chosen) & wanted[:, None]
        residual = np.zeros(len(y))
        residual[every] = weight[every] * (y[every] - mean[nth])  # sums to zero in a node
        best, column, threshold, last = np.zeros(nodes), np.zeros(nodes, np.intp), np.zeros(nodes), np.r_[at[1:] > at[:-1], True]
        for j, order in enumerate(orders if wanted.any() else ()):
            v, w, left = x[j].take(order), weight.take(order), residual.take(order)
            n, left = np.cumsum(w), np.cumsum(left)
            n_before, before = n[starts] - w[starts], left[starts] - residual[order[starts]]
            on = np.flatnonzero(allowed[:, j].take(at[:-1]) & (v[:-1] < v[1:]) & ~last[:-1])  # a split may follow these places
            own = at.take(on)
            n, left = n.take(on) - n_before.take(own), left.take(on) - before.take(own)
            rest = m.take(own) - n
            gain = np.where((n >= leaf) & (rest >= leaf), left * left * (1 / n + 1 / rest), 0.0)
            if not len(on):
                continue
            first = np.flatnonzero(np.r_[True, own[1:] > own[:-1]])
            most = np.zeros(nodes)
            most[own[first]] = np.maximum.reduceat(gain, first)
            most = np.where(most > best, most, np.inf)
            hit = np.flatnonzero(gain == most.take(own))
            hit = hit[np.r_[True, own[hit][1:] > own[hit][:-1]][: len(hit)]]  # the first of each node
            i, low, high = own[hit], v[on[hit]], v[on[hit] + 1]
            middle = (low + high) / 2
            best[i], column[i], threshold[i] = gain[hit], j, np.where(middle < high, middle, low)
        split = best > 0
        child, done = np.cumsum(split) - 1, ~split[own_node[going]]
        pred[going[done]] = mean[own_node[going[done]]]
        going, every, alive = going[~done], every[split[nth]], split[at]
        if not len(going):
            return pred
        nodes, right = 2 * int(split.sum()), np.zeros(len(y), bool)
        for values, which, of in ((asked, going, own_node), (x, every, node)):
            old = of[which]
            moves = values[column[old], which] > threshold[old]
            of[which] = child[old] + moves * (nodes // 2)
            if of is node:
                right[which] = moves
        for j, order in enumerate(orders):
            order = order[alive]
            moves = right.take(order)
            orders[j] = np.concatenate((order[~moves], order[moves]))
    return pred


def forest_out_of_fold(df: DataFrame, y: str, columns: list[str], trees: int = 100, depth: int = 30, fold: str = "fold", seed: int = 0, key: str | None = None,
                       max_rows: int = 1_000_000) -> DataFrame:
    """Adds ``pred``: a forest (leaves of 3, 0.7 of the columns a split, Poisson weights) fitted per fold on the rest.

    Columns are filled with the training folds' medians and flagged. Up to ``max_rows`` rows a task holds all rows (a few hundred
    bytes each) and grows its share of all folds' trees, down which the fold's rows go: deep trees have nearly as many nodes
    as rows, which MLlib passes around as histograms, a level a job. So the rows are sent to four tasks a core, not to each
    tree. Beyond, the forest is MLlib's, to its greatest depth. ``key`` (else a row's place) seeds the weights.
    """
    if 0 < df.count() <= max_rows:
        from .blocks import packed, read
        from .level_trees import poisson

        known = cut(df.withColumn("__id", F.monotonically_increasing_id()))
        folds = sorted((r[0] for r in known.select(fold).distinct().collect()), key=lambda f: (f is not None, f))  # draws are seeded by a fold's place
        place = F.coalesce(*(F.when(F.col(fold).eqNullSafe(F.lit(f)), F.lit(i)) for i, f in enumerate(folds)))
        every = [(f, t) for f in range(len(folds)) for t in range(trees)]
        n_jobs = min(len(every), 4 * df.sparkSession.sparkContext.defaultParallelism)
        blocks = packed(known.withColumn("__f", place), columns, [y], "__id", key or "__id", len(folds), 1, seed, "__f")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, b in read(batch):
                    cells = [pa.array([v.tobytes()], pa.binary()) for v in (b.grp.to_numpy()[b.g], b.key, b.folds, b.x, b.y)]
                    for job in range(n_jobs):
                        yield pa.RecordBatch.from_arrays([pa.array([job], pa.int32()), *cells], names=["job", "id", "key", "f", "x", "y"])

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0)[i].as_py(), [np.frombuffer(b.column(1 + c)[i].as_buffer(), kind) for c, kind in enumerate((np.int64, np.int64, np.int32, float, float))]) for b in batches for i in range(b.num_rows)]
            if not got:
                return
            job = got[0][0]
            number, hashed, f, wide, target = (np.concatenate([cells[c].reshape(-1, len(cells[0])) for _, cells in got], 1) for c in range(5))
            del got
            order = np.lexsort((number[0], hashed[0]))  # trees do not depend on how the rows came
            number, hashed, f, wide, target = number[0][order], hashed[0][order], f[0][order], wide[:, order].T, target[0][order]
            own = every[job * len(every) // n_jobs:(job + 1) * len(every) // n_jobs]
            for g in sorted({g for g, _ in own}):
                train, numbers = f != g, [t for h, t in own if h == g]
                x, held, total = filled(wide, train), np.flatnonzero(~train), 0.0
                fit = np.flatnonzero(train & ~np.isnan(target))
                x = np.ascontiguousarray(x.T)
                orders = [fit[np.argsort(v[fit], kind="stable")] for v in x]
                for t in numbers if len(fit) else ():
                    weight = np.zeros(len(target))
                    weight[fit] = poisson(hashed[fit], t)
                    weight[fit] = weight[fit] if weight.any() else 1.0
                    total = total + grown_predictions(x, target, weight, orders, held, np.random.default_rng([seed, g, t]), depth, 3, 0.7)
                n = len(numbers) if len(fit) else 0
                yield pa.RecordBatch.from_arrays([pa.array(number[held]), pa.array(np.broadcast_to(total, len(held)).astype(float)), pa.array(np.full(len(held), n, np.int64))], names=["__id", "s", "n"])

        dealt = blocks.mapInArrow(deal, "job int, id binary, key binary, f binary, x binary, y binary").repartitionById(n_jobs, "job")
        grown = dealt.mapInArrow(grow, "__id long, s double, n long").groupBy("__id").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("pred"))
        return known.join(grown, "__id").select(*df.columns, "pred")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    def one(f) -> DataFrame:
        train, held = df.filter(~F.col(fold).eqNullSafe(F.lit(f))), df.filter(F.col(fold).eqNullSafe(F.lit(f)))
        fitted = fit_preparation(train, columns)
        inputs = VectorAssembler(inputCols=[*columns, *(f"NA_{c}" for c in fitted["flags"])], outputCol="__x")
        model = RandomForestRegressor(featuresCol="__x", labelCol=y, predictionCol="pred", numTrees=trees, minInstancesPerNode=3, featureSubsetStrategy="0.7", maxDepth=depth, seed=seed)
        return model.fit(inputs.transform(prepare(train.filter(F.col(y).isNotNull()), fitted))).transform(inputs.transform(prepare(held, fitted))).select(*df.columns, "pred")

    with ThreadPool(4) as pool:  # small jobs of several folds side by side
        parts = pool.map(one, [r[0] for r in df.select(fold).distinct().collect()])
    return reduce(DataFrame.unionByName, parts)


def cross_validated_r2(matrices: dict, columns: list[str], chosen: list[str]) -> float | None:
    """Out-of-fold R2 of least squares on some of the columns: parts of the same matrices, whose last column is y."""
    keep = [0, *(1 + columns.index(c) for c in chosen), len(columns) + 1]
    parts = {f: m[np.ix_(keep, keep)] for f, m in matrices.items()}
    total, k = sum(parts.values()), len(chosen)
    error = sum(error_sum(held, ols_coefficients(total - held, k), k + 1) for held in parts.values())
    spread = error_sum(total, np.array([total[0, k + 1] / total[0, 0]]), k + 1)
    return float(1 - error / spread) if spread > 0 else None


def fold_target_coefficients(df: DataFrame, columns: list[str], fold: str = "fold", model_fold: str = "model_fold", y: str = "target") -> dict:
    """fold -> least squares of a target that differs by model fold, fitted on that fold's rows of the other folds.

    One aggregate with a row for each model fold.
    """
    used = df.filter(~F.col(fold).eqNullSafe(F.col(model_fold))).select(model_fold, *columns, y).na.drop()
    return {r[model_fold]: ols_coefficients(as_matrix(r, len(columns) + 2), len(columns)) for r in used.groupBy(model_fold).agg(*product_sums([*columns, y])).collect()}


def leave_one_family_out(df: DataFrame, sets: dict[str, list[str]], targets: list[str], family: str, fold: str, least_family: int = 5, least_test: int = 5,
                         least_train: int = 30, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Least squares fitted on all other families and judged on one: a table of families and one of pooled figures.

    (set, target, family, n_train, n_test, skill, r2, spearman) for each family of at least ``least_family`` rows, skill
    being against the mean of the training rows; and (set, target, n, skill_pooled, r2_pooled, r2_grouped_folds, gap), the
    last two on the same rows with the folds of the column ``fold``. Fits are differences of the families' matrices of
    products, which the driver holds: more than ``most`` families are an error. Rows with a missing family, target or
    predictor are left out of their job.
    """
    columns, fits, gaps = sorted({c for some in sets.values() for c in some}), [], {}
    if df.select(family).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} families")
    for target in targets:
        cells = {}
        for r in df.filter(F.col(family).isNotNull()).select(family, fold, *columns, target).na.drop(subset=[*columns, target]).groupBy(family, fold).agg(*product_sums([*columns, target])).collect():
            cells[r[family], r[fold]] = as_matrix(r, len(columns) + 2)
        total = sum(cells.values())
        per, folds = {}, {}
        for (name, f), m in cells.items():
            per[name], folds[f] = per.get(name, 0) + m, folds.get(f, 0) + m
        good = [name for name, m in per.items() if m[0, 0] >= max(least_family, least_test) and total[0, 0] - m[0, 0] >= least_train]
        for label, chosen in sets.items():
            keep = np.array([0, *(1 + columns.index(c) for c in chosen), len(columns) + 1])
            part = lambda m: m[np.ix_(keep, keep)]  # noqa: B023, E731
            for name in good:
                train = part(total - per[name])
                b = np.zeros(len(columns) + 1)
                b[keep[:-1]] = ols_coefficients(train, len(chosen))
                fits.append((label, target, name, b.tolist(), float(train[0, -1] / train[0, 0]), int(train[0, 0])))
            error = sum(error_sum(part(m), ols_coefficients(part(total - folds[f]), len(chosen)), len(chosen) + 1) for (name, f), m in cells.items() if name in set(good))
            used = part(sum((per[name] for name in good), np.zeros_like(total)))
            spread = error_sum(used, np.array([used[0, -1] / used[0, 0]]), len(chosen) + 1) if good else 0.0
            gaps[label, target] = float(1 - error / spread) if spread > 0 else None
    spark, kind = df.sparkSession, df.schema[family].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(fits, f"set string, target string, family {kind}, b array<double>, base double, n_train long"))  # a row a fit
    value = F.coalesce(*(F.when(F.col("target") == t, F.col(f"__y_{i}")) for i, t in enumerate(targets)))
    pred = sum((F.get("b", F.lit(i + 1)) * F.col(c) for i, c in enumerate(columns)), F.get("b", F.lit(0)))
    rows = df.select(F.col(family).alias("family"), *(F.col(c).cast("double").alias(c) for c in columns), *(F.col(t).cast("double").alias(f"__y_{i}") for i, t in enumerate(targets)))
    key = ["set", "target", "family"]
    scored = cut(rows.join(table, "family").select(*key, "n_train", "base", value.alias("y"), pred.alias("pred")).na.drop(subset=["y", "pred"]))
    square = lambda c: F.sum(F.pow(c, 2))
    sums = scored.groupBy(*key, "n_train").agg(F.count("*").alias("n_test"), F.sum("y").alias("sy"), square(F.col("y")).alias("syy"), square(F.col("y") - F.col("pred")).alias("see"), square(F.col("y") - F.col("base")).alias("sbb"))
    ranked = scored.join(average_ranks(scored, key, "y", "__ry"), [*key, "y"]).join(average_ranks(scored, key, "pred", "__rp"), [*key, "pred"])
    rho = ranked.groupBy(*key).agg(F.try_divide(F.covar_pop("__ry", "__rp"), F.stddev_pop("__ry") * F.stddev_pop("__rp")).alias("spearman"))
    less = lambda of: 1 - F.try_divide(F.col("see"), F.when(of > 0, of))
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n_test")
    families = sums.join(rho, key).select(*key, "n_train", "n_test", less(F.col("sbb")).alias("skill"), less(spread).alias("r2"), "spearman")
    pooled = sums.groupBy("set", "target").agg(*(F.sum(c).alias(c) for c in ("n_test", "sy", "syy", "see", "sbb")))
    folds = F.broadcast(spark.createDataFrame([(*k, v) for k, v in gaps.items()], "set string, target string, r2_grouped_folds double"))
    out = pooled.join(folds, ["set", "target"]).select("set", "target", F.col("n_test").alias("n"), less(F.col("sbb")).alias("skill_pooled"), less(spread).alias("r2_pooled"), "r2_grouped_folds")
    return families, out.withColumn("gap", F.col("r2_grouped_folds") - F.col("r2_pooled"))
