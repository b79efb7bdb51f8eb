"""Trees of many fits at once, grown level by level from histograms that the executors sum; no fit has a row limit.

A pass over the rows grows one level of every tree of a batch. Each task adds, for every tree and every node that may
still be split, the rows and the residuals of each (column, code) cell; a shuffle by (tree, node) brings the tasks' sums
together, one node at a time, and its best split leaves as one row. The driver only ever sees splits. A child's rows and
sums are known from its parent's split, so the values of leaves cost no pass.

* ``boosted_sums``: squared-error boosting of (target, predictor set, repeat, fold) fits. The rows carry the predictions of
  all fits of the batch; they are written again every few trees, the trees since then are applied on the way.
* ``forest_sums``: random forests whose leaves are vectors. A fit on several targets shares its partitions, its split score
  is summed over the standardised targets; a fit on one target is the same with a vector of one. Rows are drawn with Poisson
  weights hashed from (tree, row), columns are drawn per node.

Columns are cut once at quantiles of all rows (no target is read for that). Missing values have a code of their own and a
split sends them to the better side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Block, changed, error_sums, packed, read

MISSING = 255
SPLIT = ["job", "node", "column", "code", "side", "a", "g", "b", "h"]
TREE = {"feature": np.int32, "code": np.int32, "missing_left": bool, "left": np.int32, "value": float}


@dataclass
class Tree:
    """Nodes in the order in which they were made; a leaf has feature -1. ``value`` holds a vector a node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)])
    open: list[int] = field(default_factory=lambda: [0])
    table: np.ndarray | None = None  # the leaf of every byte of sides, once it was asked for

    def split(self, node: int, feature: int, code: int, missing_left: bool, values: tuple[np.ndarray, np.ndarray]) -> list[int]:
        """The two children of ``node``, made from a split."""
        self.feature[node], self.code[node], self.missing_left[node], self.left[node], self.table = feature, code, missing_left, len(self.feature), None
        for value in values:
            for name, v in (("feature", -1), ("code", 0), ("missing_left", True), ("left", 0), ("value", value)):
                getattr(self, name).append(v)
        return [self.left[node], self.left[node] + 1]

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of codes, which are (column, row)."""
        if len(self.feature) <= 17:  # comparisons of whole columns are less work than a walk of every row
            return self.by_sides()[self.sides(codes)]
        feature, code, missing_left, left = (np.asarray(x) for x in (self.feature, self.code, self.missing_left, self.left))
        node, going = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        while len(going):
            going = going[feature[node[going]] >= 0]
            at = node[going]
            own = codes[feature[at], going]
            node[going] = left[at] + np.where(own == MISSING, ~missing_left[at], own > code[at])
        return node

    def grown(self) -> Tree:
        """The same tree as five arrays: an object a node is much to hold and to send for a thousand trees."""
        return Tree(*(np.asarray(getattr(self, name), kind) for name, kind in TREE.items()), [])

    def inner(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f >= 0]

    def sides(self, codes: np.ndarray) -> np.ndarray:
        """A byte a row: bit i is set if the row would go right at the i-th of at most eight inner nodes."""
        out = np.zeros(codes.shape[1], np.uint8)
        for i, node in enumerate(self.inner()):
            own = codes[self.feature[node]]
            right = own > self.code[node]
            if self.missing_left[node]:
                right &= own != MISSING
            out |= right.view(np.uint8) << np.uint8(i)
        return out

    def by_sides(self) -> np.ndarray:
        """The leaf of every such byte."""
        if self.table is not None:
            return self.table
        inner = self.inner()
        bit, out = {node: i for i, node in enumerate(inner)}, np.zeros(1 << len(inner), np.int64)
        for byte in range(len(out)):
            node = 0
            while self.feature[node] >= 0:
                node = self.left[node] + (byte >> bit[node] & 1)
            out[byte] = node
        self.table = out
        return out

    def predict(self, codes: np.ndarray) -> np.ndarray:
        if len(self.feature) <= 17:
            return np.stack([v.take(self.sides(codes)) for v in np.asarray(self.value)[self.by_sides()].T], 1)
        return np.asarray(self.value)[self.place(codes)]


def best_split(count: np.ndarray, total: np.ndarray, leaf: int, l2: float, allowed: np.ndarray) -> tuple | None:
    """(column, last code that goes left, missing goes left, (n, sums) of both sides) of a node, or None.

    ``count`` is (column, code), ``total`` (column, code, target); the score g^2 / (n + l2) is summed over the targets.
    """
    left_n, left_g = np.cumsum(count[:, :-1], 1)[None], np.cumsum(total[:, :-1], 1)[None]
    if count[:, -1].any():
        left_n = np.concatenate((left_n, left_n + count[None, :, -1:]))
        left_g = np.concatenate((left_g, left_g + total[None, :, -1:]))
    first = int(allowed.argmax())  # a column that is counted holds all rows
    n, g = count[first].sum(), total[first].sum(0)
    score = lambda g, n: (g * g).sum(-1) / np.maximum(n + l2, 1e-12)
    gain = score(left_g, left_n) + score(g - left_g, n - left_n) - score(g, n)
    gain[(left_n < leaf) | (n - left_n < leaf) | ~allowed[None, :, None]] = -np.inf
    side, column, code = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[side, column, code] > 1e-12:
        return None
    n_left, g_left = left_n[side, column, code], left_g[side, column, code]
    return int(column), int(code), bool(side), ((n_left, g_left), (n - n_left, g - g_left))


@dataclass
class Batch:
    """Fits that grow together: what each trains on and the tree that it grows now."""

    columns: int
    trees: list[Tree]
    allowed: list[np.ndarray]
    leaf: int
    l2: float
    rate: float
    draw: int | None = None
    seed: int = 0

    def mask(self, job: int, node: int) -> np.ndarray:
        """The columns that a node may be split by."""
        if self.draw is None:
            return self.allowed[job]
        out = np.zeros(self.columns, bool)
        out[np.random.default_rng([self.seed, job, node]).permutation(self.columns)[: self.draw]] = True
        return self.allowed[job] & out


def node_sums(codes: np.ndarray, at: np.ndarray, nodes: int, columns: list[int], weight: np.ndarray | None, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((node, column, code) weights, (node, column, code, target) weighted residuals) of rows at nodes ``at``; other columns stay 0."""
    n, sums = np.zeros((nodes, len(codes), 256)), np.zeros((nodes, len(codes), 256, wrong.shape[1]))
    first, weighted = at.astype(np.int64) << 8, [np.ascontiguousarray(w if weight is None else w * weight) for w in wrong.T]
    for c in columns:
        cell = first + codes[c]
        n[:, c] = np.bincount(cell, weight, nodes << 8).reshape(nodes, 256)
        for t, w in enumerate(weighted):
            sums[:, c, :, t] = np.bincount(cell, w, nodes << 8).reshape(nodes, 256)
    return n, sums


def grow_level(rows: DataFrame, batch: Batch, residual, cells: int = 1 << 24, pieces=None) -> bool:
    """Splits the open nodes of every tree of the batch by one pass; False if none was split.

    ``residual(block, job)`` gives (codes of the rows that train, their weights or None for 1, residuals as (row, target)). A task
    holds sums of at most about ``cells`` numbers before it passes them on. ``pieces(Arrow batch)`` gives blocks and the jobs
    that they are for, by default all.
    """
    pieces = pieces or (lambda read_batch: ((block, range(len(batch.trees))) for _, block in read(read_batch, np.uint8)))
    width = batch.columns * 256
    used = [np.flatnonzero(a).tolist() for a in batch.allowed]

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            out = []
            while held:
                job, (nodes, n, sums) = held.popitem()
                for i, node in enumerate(nodes):
                    flat = np.where(batch.mask(job, node)[:, None], n[i], 0.0).ravel()  # no sums of columns that a node does not draw
                    on = np.flatnonzero(flat)
                    if len(on):
                        out.append((job, node, on.astype(np.int32).tobytes(), flat[on].tobytes(), sums[i].reshape(width, -1)[on].tobytes()))
                if out and (len(out) >= 1000 or not held):
                    columns, out = list(zip(*out, strict=True)), []
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["job", "node", "cells", "n", "sums"])

        for read_batch in batches:
            for block, jobs in pieces(read_batch):
                for job in jobs:
                    tree = batch.trees[job]
                    if not tree.open:
                        continue
                    codes, weight, wrong = residual(block, job)
                    number = np.full(len(tree.feature), -1)  # of each node among the open ones
                    number[tree.open] = np.arange(len(tree.open))
                    at = number[tree.place(codes)] if tree.feature[0] >= 0 else np.zeros(codes.shape[1], np.int64)
                    if (at < 0).any():
                        here = np.flatnonzero(at >= 0)
                        codes, at, wrong, weight = codes[:, here], at[here], wrong[here], None if weight is None else weight[here]
                    n, sums = node_sums(codes, at, len(tree.open), used[job], weight, wrong)
                    if job in held:
                        held[job][1][:] += n
                        held[job][2][:] += sums
                    else:
                        held[job] = (tree.open, n, sums)
                        size += n.size + sums.size
                    if size > cells:
                        yield from passed()
                        size = 0
        yield from passed()

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = n = sums = None
        out: list[tuple] = []

        def chosen() -> None:
            if key is not None:
                shape = (batch.columns, 256)
                out.append((*key, *told(n.reshape(shape), sums.reshape(*shape, -1), batch, *key)))

        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.job, row.node) != key:
                    chosen()
                    key = (row.job, row.node)
                    n, sums = np.zeros(width), None
                on = np.frombuffer(row.cells, np.int32)
                part = np.frombuffer(row.sums).reshape(len(on), -1)
                sums = np.zeros((width, part.shape[1])) if sums is None else sums
                n[on] += np.frombuffer(row.n)
                sums[on] += part
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=SPLIT)
                out.clear()
        chosen()
        if out:
            yield pd.DataFrame(out, columns=SPLIT)

    slices = sum(len(tree.open) for tree in batch.trees) * width >> 21  # a slice of some two million cells is sorted in memory
    to = (slices, "job", "node") if slices > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ("job", "node")
    parts = rows.mapInArrow(histograms, "job int, node int, cells binary, n binary, sums binary").repartition(*to).sortWithinPartitions("job", "node", "cells", "n", "sums")
    splits = parts.mapInPandas(choose, "job int, node int, column int, code int, side boolean, a double, g array<double>, b double, h array<double>").collect()
    opened: dict[int, list[int]] = {}
    for s in sorted(splits, key=lambda s: (s["job"], s["node"])):
        opened.setdefault(s["job"], []).extend(split_node(batch.trees[s["job"]], s["node"], tuple(s)[2:], batch))
    for job, tree in enumerate(batch.trees):
        tree.open = opened.get(job, [])
    return any(opened.values())


def told(n: np.ndarray, sums: np.ndarray, batch: Batch, job: int, node: int) -> tuple:
    """(column, code, side, rows and sums of the left, of the right) of a node's best split; column -1 if there is none."""
    drawn = batch.mask(job, node)
    found = best_split(n, sums, batch.leaf, batch.l2, drawn)
    first = int(drawn.argmax())
    whole = (n[first].sum(), sums[first].sum(0))
    column, code, side, ((a, g), (b, h)) = found or (-1, 0, True, (whole, whole))
    return column, code, side, a, g.tolist(), b, h.tolist()


def split_node(tree: Tree, node: int, split: tuple, batch: Batch) -> list[int]:
    """Splits a node as ``told``; the children that may be split themselves."""
    column, code, side, a, g, b, h = split
    value = lambda n, g: batch.rate * np.asarray(g) / np.maximum(n + batch.l2, 1e-12)
    if node == 0:
        tree.value[0] = value(a + (b if column >= 0 else 0), np.asarray(g) + (np.asarray(h) if column >= 0 else 0))
    if column < 0:
        return []
    children = tree.split(node, column, code, side, (value(a, g), value(b, h)))
    return [c for c, n in zip(children, (a, b), strict=True) if n >= 2 * batch.leaf]


def grow_here(codes: np.ndarray, weight: np.ndarray, wrong: np.ndarray, batch: Batch, job: int, depth: int, number: int) -> Tree:
    """The tree ``number`` of a batch, level by level as ``grow_level`` does, from rows that one task holds."""
    tree, node = Tree(), np.zeros(codes.shape[1], np.int64)
    columns = np.flatnonzero(batch.allowed[job]).tolist()
    for _ in range(depth):
        n, sums = node_sums(codes, node, len(tree.open), columns, weight, wrong)
        opened, place = [], np.full(len(tree.feature) + 2 * len(tree.open), -1)
        for i, at in enumerate(tree.open):
            opened += split_node(tree, at, told(n[i], sums[i], batch, number, at), batch)
        place[opened] = np.arange(len(opened))
        feature, code, missing_left, left = (np.asarray(v) for v in (tree.feature, tree.code, tree.missing_left, tree.left))
        at = np.asarray(tree.open)[node]
        own = codes[np.maximum(feature[at], 0), np.arange(len(at))]
        node = np.where(feature[at] >= 0, place[left[at] + np.where(own == MISSING, ~missing_left[at], own > code[at])], -1)
        tree.open = opened
        if not opened:
            break
        on = np.flatnonzero(node >= 0)
        if len(on) < len(node):
            codes, weight, wrong, node = codes[:, on], weight[on], wrong[on], node[on]
    tree.open = []
    return tree


def quantile_cuts(df: DataFrame, columns: list[str], bins: int = 255) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts of each column at quantiles of its known values, from one aggregate."""
    ends = F.lit([i / bins for i in range(1, bins)])
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*(F.percentile_approx(number(c), ends, F.lit(20 * bins)).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [np.unique(row[f"c{i}"] or []) for i in range(len(columns))]


def target_moments(blocks: DataFrame, targets: int, repeats: int, folds: int) -> dict:
    """(repeat, fold) -> (n, mean, sd) over the rows of the other folds, each an array over the targets; tasks add up."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((repeats, folds, targets, 3))
        for batch in batches:
            for _, b in read(batch, np.uint8):
                for t, y in enumerate(b.y):
                    known = np.flatnonzero(~np.isnan(y))
                    for r in range(repeats):
                        for m, v in enumerate((None, y[known], y[known] ** 2)):
                            held[r, :, t, m] += np.bincount(b.folds[r, known], v, folds)
        places = list(product(range(repeats), range(folds), range(targets)))
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(*p, *held[p]) for p in places], columns=["r", "f", "t", "n", "s", "q"]), preserve_index=False)

    parts = blocks.mapInArrow(add, "r long, f long, t long, n double, s double, q double")
    got, out = np.zeros((repeats, folds, targets, 3)), {}
    for row in parts.groupBy("r", "f", "t").agg(*(F.sum(c).alias(c) for c in "nsq")).collect():
        got[row["r"], row["f"], row["t"]] = row["n"], row["s"], row["q"]
    for repeat, fold in product(range(repeats), range(folds)):
        n, s, q = np.moveaxis(got[repeat, [f for f in range(folds) if f != fold]].sum(0), -1, 0)
        mean = s / np.maximum(n, 1)
        sd = np.sqrt(np.clip(q / np.maximum(n, 1) - mean * mean, 0, None))
        out[repeat, fold] = (n, mean, np.where(sd > 1e-12, sd, 1.0))
    return out


def with_predictions(blocks: DataFrame, predicted) -> DataFrame:
    """``blocks`` with ``pred`` replaced by ``predicted(block)``, (column, row), written anew."""
    schema = blocks.schema if "pred" in blocks.columns else blocks.withColumn("pred", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in read(batch, np.uint8):
                yield changed(batch.slice(i, 1), "pred", [predicted(b).tobytes()])

    return cut(blocks.mapInArrow(run, schema))


def boosted_sums(df: DataFrame, targets: list[str], sets: dict[str, list[str]], group: str, key: str, folds: int = 5, repeats: int = 3, trees: int = 150,
                 rate: float = 0.06, depth: int = 3, leaf: int = 15, l2: float = 1.0, seed: int = 0, most_jobs: int = 240, every: int = 12,
                 target_of_fold: list[str] | None = None, fold_column: str | None = None) -> DataFrame:
    """(grp, target, set, repeat, n, sy, syy, see) of out-of-fold predictions, as ``boosting.tree_grid``, from all rows.

    Fits run in batches of about ``most_jobs``, whole (target, set, repeat) combinations at a time.
    """
    repeats = 1 if fold_column else repeats
    wanted = lambda t, f: not target_of_fold or target_of_fold[f] == targets[t]
    columns = sorted({c for some in sets.values() for c in some})
    combinations = list(product(range(len(targets)), range(len(sets)), range(repeats)))
    step = max(1, most_jobs // folds)
    width = min(step, len(combinations)) * folds
    names, rows = list(sets), cut(packed(df, columns, targets, group, key, folds, repeats, seed, fold_column, quantile_cuts(df, columns), MISSING, max(1024, min(1 << 15, (1 << 21) // max(width, 1)))))
    moments, out = target_moments(rows, len(targets), repeats, folds), None
    for low in range(0, len(combinations), step):
        some = combinations[low:low + step]
        jobs = [(t, s, r, f) for t, s, r in some for f in range(folds)]
        allowed = [np.isin(columns, sets[names[s]]) for _, s, _, _ in jobs]
        base = np.array([moments[r, f][1][t] for t, _, r, f in jobs])
        state, since = rows, []

        def current(b: Block, job: int, base: np.ndarray, since: list) -> np.ndarray:
            """Predictions of a fit: what the block holds, and the trees since then."""
            pred = np.full(b.n, base[job]) if b.pred is None else b.pred[job].copy()
            for grown in since:
                pred += grown[job].predict(b.x)[:, 0]
            return pred

        for k in range(trees):
            batch = Batch(len(columns), [Tree() for _ in jobs], allowed, leaf, l2, rate)

            def residual(b: Block, job: int, jobs: list = jobs, base: np.ndarray = base, since: list = list(since)) -> tuple:  # noqa: B008
                t, _, r, f = jobs[job]
                known = b.once("known", lambda: [~np.isnan(y) for y in b.y])
                alike = b.once("alike", lambda: [next(u for u in range(len(known)) if (known[u] == known[v]).all()) for v in range(len(known))])
                key = (alike[t], r, f, wanted(t, f))
                on = b.once(key, lambda: np.flatnonzero((b.folds[r] != f) & known[t] & wanted(t, f)))
                return b.once((*key, "x"), lambda: b.x[:, on]), None, (b.y[t] - current(b, job, base, since))[on][:, None]

            for _ in range(depth):
                if not grow_level(state, batch, residual):
                    break
            since.append(batch.trees)
            if len(since) == every and k < trees - 1:
                state = with_predictions(state, lambda b, base=base, since=list(since): np.stack([current(b, j, base, since) for j in range(len(base))]))
                since = []

        def held(b: Block, some: list = some, base: np.ndarray = base, since: list = list(since)) -> Iterator[tuple]:  # noqa: B008
            for i, (t, s, r) in enumerate(some):
                for f in range(folds):
                    on = np.flatnonzero((b.folds[r] == f) & ~np.isnan(b.y[t])) if moments[r, f][0][t] > 0 and wanted(t, f) else ()
                    if len(on):
                        yield (targets[t], names[s], r), on, b.y[t, on], current(b, i * folds + f, base, since)[on]

        sums = error_sums(state, held, {"target": "string", "set": "string", "repeat": "int"}, np.uint8)
        out = sums if out is None else out.unionByName(sums)
    return out


def poisson(key: np.ndarray, tree: int, most: int = 8) -> np.ndarray:
    """Poisson(1) weights of rows, hashed from key and tree (splitmix steps)."""
    with np.errstate(over="ignore"):
        z = np.asarray(key).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, most)]))
    return np.searchsorted(steps, u).astype(float)


def forest_sums(df: DataFrame, targets: list[str], columns: list[str], group: str, key: str, folds: int = 5, repeats: int = 1, trees: int = 100,
                depth: int = 10, leaf: int = 3, share: float = 0.7, seed: int = 0, most_jobs: int = 1000, max_rows: int = 2_000_000, together: int = 8, cells: int = 1 << 25) -> DataFrame:
    """(grp, model, target, repeat, n, sy, syy, see) of joint and separate forests on the rows that have all targets.

    Joint forests have vector leaves over all targets, separate ones are a forest for each; both see the same folds and row
    weights. Depth bounds a tree's nodes, which the driver holds, whatever the rows are. The coded rows of a fold's training
    set are dealt once to a task for every ``together`` numbers of trees. Up to ``max_rows`` rows it grows these trees; beyond,
    a fold's rows are dealt in parts and the same trees grow from the parts' histograms. A part passes on a node's sums once,
    however many rows it has, so what is shuffled a level goes by the parts: at most one for each ``max_rows`` rows, and no
    more than keep all cores busy. A task holds sums of about ``cells`` numbers, for which fewer trees may go together.
    """
    arms = [("joint", list(range(len(targets))))] + [("separate", [t]) for t in range(len(targets))]
    rows = cut(packed(df, columns, targets, group, key, folds, repeats, seed, None, quantile_cuts(df, columns), MISSING, complete=True))
    moments = target_moments(rows, len(targets), repeats, folds)
    jobs = [(a, r, f, k) for k in range(trees) for a in range(len(arms)) for r in range(repeats) for f in range(folds)]
    state, slots = rows, 2 * len(targets) * repeats  # a prediction for each (target, arm kind, repeat): each row has one fold
    count, cores = rows.agg(F.sum("n")).first()[0] or 0, df.sparkSession.sparkContext.defaultParallelism
    whole = count <= max_rows
    if not whole:
        together = max(1, min(together, cells // (sum(1 + len(own) for _, own in arms) * len(columns) << (7 + depth))))  # 256 codes, 2^(depth - 1) nodes

    for low in range(0, len(jobs), most_jobs):
        some = jobs[low:low + most_jobs]
        batch = Batch(len(columns), [Tree() for _ in some], [np.ones(len(columns), bool)] * len(some), leaf, 0.0, 1.0, max(1, round(share * len(columns))), seed + low)

        def drawn(y: np.ndarray, key: np.ndarray, job: int, some: list = some) -> tuple:
            """(rows with a weight, their weights, their residuals) of a job's training rows."""
            a, r, f, k = some[job]
            weight = poisson(key, k + trees * r)
            on = np.flatnonzero(weight > 0)
            _, mean, sd = moments[r, f]
            return on, weight[on], ((y[:, on].T - mean) / sd)[:, arms[a][1]]

        tasks = sorted({(r, f, k // together) for _, r, f, k in some})
        numbers = [[i for i, (_, r, f, k) in enumerate(some) if (r, f, k // together) == task] for task in tasks]
        if whole:
            batch.trees = trees_of_tasks(dealt(rows, tasks), batch, numbers, drawn, depth)
        else:
            parts = max(1, min(-(-count // max(1, max_rows)), -(-4 * cores // len(tasks))))
            shared = cut(dealt(rows, tasks, parts))

            def pieces(read_batch: pa.RecordBatch, numbers: list = numbers, parts: int = parts) -> Iterator[tuple]:
                return (((key, x, y), numbers[part // parts]) for part, key, x, y in dealt_rows(read_batch))

            def residual(b: tuple, job: int, drawn=drawn) -> tuple:
                on, weight, wrong = drawn(b[2], b[0], job)
                return b[1][:, on], weight, wrong

            for _ in range(depth):
                if not grow_level(shared, batch, residual, cells, pieces):
                    break

        def add(b: Block, some: list = some, grown: list = [tree.grown() for tree in batch.trees]) -> np.ndarray:  # noqa: B006, B008
            pred = np.zeros((slots, b.n)) if b.pred is None else b.pred.copy()
            rows_of = {(r, f): np.flatnonzero(b.folds[r] == f) for r in range(repeats) for f in range(folds)}
            codes_of = {p: b.x[:, on] for p, on in rows_of.items()}
            for (a, r, f, _), tree in zip(some, grown, strict=True):
                on = rows_of[r, f]
                if len(on):
                    _, mean, sd = moments[r, f]
                    own, values = arms[a][1], tree.predict(codes_of[r, f])
                    for j, t in enumerate(own):
                        pred[(t * 2 + (a > 0)) * repeats + r, on] += (values[:, min(j, values.shape[1] - 1)] * sd[t] + mean[t]) / trees
            return pred

        state = with_predictions(state, add)

    def held(b: Block) -> Iterator[tuple]:
        for t, kind_of, r in product(range(len(targets)), range(2), range(repeats)):
            yield (["joint", "separate"][kind_of], targets[t], r), np.arange(b.n), b.y[t], b.pred[(t * 2 + kind_of) * repeats + r]

    return error_sums(state, held, {"model": "string", "target": "string", "repeat": "int"}, np.uint8)


def dealt(blocks: DataFrame, tasks: list[tuple], parts: int = 1) -> DataFrame:
    """(part, n, key, x, y): the training rows of each task (repeat, fold, any), in ``parts`` parts by their keys; a part is a partition."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b in read(batch, np.uint8):
                own = (b.key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                for i, (r, f, _) in enumerate(tasks):
                    for p in range(parts):
                        on = np.flatnonzero((b.folds[r] != f) & (own == p))
                        if len(on):
                            cells = b.once((r, f, p), lambda: [np.ascontiguousarray(v).tobytes() for v in (b.key[on], b.x[:, on], b.y[:, on])])  # noqa: B023
                            yield pa.RecordBatch.from_arrays([pa.array([i * parts + p], pa.int32()), pa.array([len(on)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["part", "n", "key", "x", "y"])

    return blocks.mapInArrow(deal, "part int, n int, key binary, x binary, y binary").repartitionById(max(1, len(tasks) * parts), "part")


def dealt_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(part, key, x, y) of each row of a dealt batch; x and y are (column, row)."""
    for i in range(batch.num_rows):
        part, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        yield part, *(np.frombuffer(batch.column(2 + c)[i].as_buffer(), kind).reshape(shape) for c, (kind, shape) in enumerate(((np.int64, n), (np.uint8, (-1, n)), (float, (-1, n)))))


def trees_of_tasks(parts: DataFrame, batch: Batch, numbers: list[list[int]], drawn, depth: int) -> list[Tree]:
    """The trees of all jobs, grown by tasks that each hold the training rows of a (repeat, fold); ``numbers`` are a task's jobs."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for b in batches for row in dealt_rows(b)]
        if not got:
            return
        key, x, y = (np.concatenate([row[c] for row in got], -1) for c in (1, 2, 3))
        order = np.argsort(key, kind="stable")  # sums of rows do not depend on how they came
        key, x, y, out = key[order], x[:, order], y[:, order], []
        for i in numbers[got[0][0]]:
            on, weight, wrong = drawn(y, key, i)
            tree = grow_here(x[:, on], weight, wrong, batch, i, depth, i)
            out.append((i, *(getattr(tree.grown(), name).tobytes() for name in TREE)))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c else pa.int32()) for c, v in enumerate(zip(*out, strict=True))], names=["job", *TREE])

    grown = parts.mapInArrow(grow, "job int, " + ", ".join(f"{name} binary" for name in TREE))
    trees = [Tree() for _ in batch.trees]
    for row in grown.collect():  # a row a tree
        cells = {name: np.frombuffer(row[name], kind) for name, kind in TREE.items()}
        trees[row["job"]] = Tree(**cells | {"value": cells["value"].reshape(len(cells["feature"]), -1)}, open=[])
    return trees
