"""Regressions of many responses on tiers of predictors, with an effect of every group, from one scan of the rows.

Group effects need no columns: a slope with group effects is the slope of columns less their group means, and sums of
products of such columns follow from plain sums per group, ``sum(ab) - sum(a) sum(b) / n``. So there may be any number of
groups. One pass reduces the rows to sums per (job, group), a second one, which knows slopes and group means, to scores per
cluster and HC3's products. Every row passes once for all jobs, not once for each; tasks add up in numpy before they shuffle, so
a shuffle carries a row for each task and group, or share of a cluster. A cluster's sums are much wider than a row, so the second
pass deals the rows by cluster first, a few shares each for large clusters to be several tasks. The driver sees a matrix for each job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_tail
from ..session import cut

POOLED = "small groups together"


@dataclass(frozen=True)
class Job:
    """A regression: ``where`` limits its rows, ``absorb`` gives every group an effect."""

    response: str
    tier: str
    predictors: tuple[str, ...]
    absorb: bool = False
    where: Column | None = None


def t_quantiles(df: list[float], p: float = 0.05) -> dict[float, float]:
    """The t whose two-sided tail is ``p``, for each number of degrees of freedom, by one bisection of them all."""
    free = np.unique(np.asarray(df, float))
    low, high = np.zeros(len(free)), np.full(len(free), 1e3 if len(free) and free[0] > 1 else 1e6)
    for _ in range(60):
        middle = (low + high) / 2
        above = t_tail(middle, free) > p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return dict(zip(free.tolist(), ((low + high) / 2).tolist(), strict=True))


class Layout:
    """Where the variables and conditions of jobs lie in the rows, and each job's values of an Arrow batch."""

    def __init__(self, jobs: list[Job]):
        self.names = list(dict.fromkeys(c for j in jobs for c in (j.response, *j.predictors)))
        self.conditions = list({id(j.where): j.where for j in jobs if j.where is not None}.values())
        place = {id(c): i for i, c in enumerate(self.conditions)}
        self.jobs = [([self.names.index(c) for c in (j.response, *j.predictors)], j.absorb, None if j.where is None else place[id(j.where)]) for j in jobs]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"conditions": [None] * len(self.conditions)}  # tasks get columns' values, not columns

    def rows(self, df: DataFrame, group: str, cluster: str | None) -> DataFrame:
        """(level, cluster, v0.., w0..): the variables as doubles and whether each condition holds, a row for each of ``df``."""
        return df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("level"), (F.col(cluster) if cluster else F.lit(None).cast("int")).alias("cluster"),
                         *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(self.names)), *(F.coalesce(c, F.lit(False)).alias(f"w{i}") for i, c in enumerate(self.conditions)))

    def read(self, batch: pa.RecordBatch, by: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, starts, order, x, flags) of a batch in the order of its column ``by``: a key and where it starts, (variable, row), (condition, row)."""
        coded = batch.column(batch.schema.get_field_index(by)).dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
        column = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)[order]
        x = np.stack([column(f"v{i}").astype(float) for i in range(len(self.names))])
        flags = np.stack([column(f"w{i}").astype(bool) for i in range(len(self.conditions))]) if self.conditions else np.zeros((0, len(order)), bool)
        return coded.dictionary, starts, order, x, flags

    def values(self, number: int, x: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(z, known) of a job: response and predictors as (variable, row), zero in rows that lack one or that it leaves out."""
        inside, _, condition = self.jobs[number]
        known = ~np.isnan(x[inside]).any(0)
        if condition is not None:
            known = known & flags[condition]
        return np.where(known, x[inside], 0.0), known


class Sums:
    """Sums of rows by key within a task; handed on when they are many."""

    def __init__(self, width: int, most: int = 1 << 22):
        self.width, self.most, self.place, self.sums = width, max(1, most // max(width, 1)), {}, np.zeros((0, width))

    def add(self, keys: list, rows: np.ndarray) -> None:
        at = np.array([self.place.setdefault(k, len(self.place)) for k in keys], np.int64)
        if len(self.place) > len(self.sums):
            self.sums = np.concatenate((self.sums, np.zeros((max(len(self.place), len(self.sums), 64) + len(keys), self.width))))
        self.sums[at] += rows  # keys of a batch differ

    def taken(self) -> tuple[list, np.ndarray]:
        out = list(self.place), self.sums[: len(self.place)].copy()
        self.place, self.sums = {}, np.zeros((0, self.width))
        return out


def level_sums(rows: DataFrame, layout: Layout, most: int) -> DataFrame:
    """(job, level, n, s_i, p_i_j): sums and sums of products of each job by level, one pass with a combiner in each task."""
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    names = ["n", *(f"s_{i}" for i in range(most)), *(f"p_{i}_{j}" for i, j in pairs)]
    absorbing, width = [i for i, j in enumerate(layout.jobs) if j[1]], len(names)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, held = np.zeros((len(layout.jobs), width)), Sums(len(absorbing) * width)

        def told(jobs: list, levels: list, sums: np.ndarray) -> pa.RecordBatch:
            on = np.flatnonzero(sums[:, 0] > 0)
            columns = [pa.array(np.asarray(jobs, np.int32)[on]), pa.array([levels[i] for i in on], pa.string()), *(pa.array(c) for c in sums[on].T.copy())]
            return pa.RecordBatch.from_arrays(columns, names=["job", "level", *names])

        def passed() -> Iterator[pa.RecordBatch]:
            levels, sums = held.taken()
            for a, job in enumerate(absorbing):
                yield told([job] * len(levels), levels, sums[:, a * width:(a + 1) * width])

        for batch in batches:
            if not batch.num_rows:
                continue
            levels, starts, _, x, flags = layout.read(batch, "level")
            grouped = np.zeros((len(starts), len(absorbing), width))
            for number, (inside, absorb, _) in enumerate(layout.jobs):
                z, known = layout.values(number, x, flags)
                k = len(inside)
                at = [0, *range(1, 1 + k), *(1 + most + n for n, (_, j) in enumerate(pairs) if j < k)]
                if absorb:
                    parts = np.stack([known.astype(float), *z, *(z[i] * z[j] for i, j in pairs if j < k)])
                    grouped[:, absorbing.index(number), at] = np.add.reduceat(parts, starts, axis=1).T
                else:
                    products = z @ z.T
                    plain[number, at] += [known.sum(), *z.sum(1), *(products[i, j] for i, j in pairs if j < k)]
            if absorbing:
                held.add(levels.to_pylist(), grouped.reshape(len(starts), -1))
                if len(held.place) > held.most:
                    yield from passed()
        yield from passed()
        yield told(list(range(len(layout.jobs))), [""] * len(layout.jobs), plain)

    parts = rows.drop("cluster").mapInArrow(combined, "job int, level string, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("job", "level").agg(F.sum("n").cast("long").alias("n"), *(F.sum(n).alias(n) for n in names[1:]))


def error_parts(rows: DataFrame, layout: Layout, fits: dict, means: DataFrame | None, most: int, clustered: bool) -> tuple[dict, dict, dict]:
    """(scores' products by cluster, HC3's products, clusters) of each fitted job, from one pass over the rows.

    A task adds the scores of its rows by cluster and, for HC3, the weighted products of all; both travel in the same columns.
    """
    numbers, slots, width = sorted(fits), {}, 0
    for number in numbers:
        k = len(layout.jobs[number][0]) - 1
        slots[number] = (width, k)
        width += max(k + 1, k * (k + 1) // 2)
    upper = lambda k: [(i, j) for i in range(k) for j in range(i, k)]
    absorbing = {number: i for i, number in enumerate(n for n, j in enumerate(layout.jobs) if j[1])}
    local = {n: (f["slope"], f["scaled"], f["mean"], f["n"]) for n, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, hc3, held = None, np.zeros(width), Sums(width)

        def told(hc: bool, keys: list, sums: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([hc] * len(keys), pa.bool_()), pa.array(keys, kind), *(pa.array(c) for c in sums.T.copy())]
            return pa.RecordBatch.from_arrays(columns, names=["hc", "cluster", *(f"u{i}" for i in range(width))])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("cluster").type
            keys, starts, order, x, flags = layout.read(batch, "cluster")
            scores = np.zeros((width, len(order)))
            if "means" in batch.schema.names:
                own = batch.column(batch.schema.get_field_index("means")).flatten().to_numpy().reshape(len(order), -1)[order].T
            for number in numbers:
                z, known = layout.values(number, x, flags)
                low, k = slots[number]
                slope, scaled, mean, size = local[number]
                if number in absorbing:
                    at = absorbing[number] * (most + 1)
                    m, size = own[at + 1:at + 2 + k], np.where(known, own[at], 1.0)
                else:
                    m = mean[: k + 1, None]
                z = np.where(known, z - m, 0.0)
                e, x_ = z[0] - slope[:k] @ z[1:], z[1:]
                leverage = 1 / size + ((scaled[:k, :k] @ x_) * x_).sum(0)
                weighted = (x_ * (e / np.maximum(1 - leverage, 1e-8)) ** 2) @ x_.T
                hc3[low:low + len(upper(k))] += [weighted[i, j] for i, j in upper(k)]
                if clustered:
                    scores[low:low + k], scores[low + k] = x_ * e, known
            if clustered:
                held.add(keys.to_pylist(), np.add.reduceat(scores, starts, axis=1).T)
                if len(held.place) > held.most:
                    yield told(False, *held.taken())
        if kind is not None:
            yield told(False, *held.taken())
            yield told(True, [None], hc3[None])

    if means is not None:
        nothing = F.array(*[F.lit(0.0)] * len(absorbing) * (most + 1))  # levels that no such job uses
        rows = rows.join(means, "level", "left").withColumn("means", F.coalesce("means", nothing))
    cluster = rows.schema["cluster"].dataType.simpleString()
    parts = rows.drop("level").mapInArrow(run, f"hc boolean, cluster {cluster}, " + ", ".join(f"u{i} double" for i in range(width)))
    per = cut(parts.groupBy("hc", "cluster").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(width))))
    spread = lambda r, number: {f"w_{i + 1}_{j + 1}": r[slots[number][0] + n] for n, (i, j) in enumerate(upper(slots[number][1]))}
    row = per.filter("hc").first()  # one row
    hc3 = {number: spread(list(row)[2:], number) for number in numbers}
    if not clustered:
        return {}, hc3, {}
    products = [F.sum(F.col(f"u{low + i}") * F.col(f"u{low + j}")).alias(f"w_{number}_{i + 1}_{j + 1}") for number, (low, k) in slots.items() for i, j in upper(k)]
    r = per.filter("NOT hc").agg(*products, *(F.count_if(F.col(f"u{low + k}") > 0).alias(f"c_{number}") for number, (low, k) in slots.items())).first()  # one row
    scores = {number: {f"w_{i + 1}_{j + 1}": r[f"w_{number}_{i + 1}_{j + 1}"] for i, j in upper(k)} for number, (low, k) in slots.items()}
    return scores, hc3, {number: r[f"c_{number}"] for number in numbers}


def tiered_regressions(df: DataFrame, jobs: list[Job], group: str, cluster: str | None = None, least_group: int = 15, least_spare: int = 20,
                       least_clusters: int = 20, errors: bool = True, broadcast_levels: int = 100_000, values: dict[str, Column] | None = None, shares: int = 4) -> DataFrame:
    """(response, tier, term, beta, se, ci_lo, ci_hi, p, vif, n, r2, adj_r2, se_kind, n_clusters, n_groups, y_sd), a row for each slope.

    Coefficients are standardised by population deviations. Groups of fewer than ``least_group`` rows of a job share one
    effect, a null group is a group. Constant predictors are dropped; a job without ``least_spare`` rows more than
    predictors, or whose response is constant, gives no row. Errors are clustered (CR1, clusters - 1 degrees of freedom)
    from ``least_clusters`` clusters on, else HC3; a row without a cluster is a cluster of such rows. Without ``errors`` the
    rows are read once, and errors, intervals, p and the numbers of clusters are NULL. ``values`` are columns that jobs use and
    that are made of those of ``df`` after its rows were dealt by cluster, in ``shares`` parts each: a shuffle carries ``df``'s own.
    """
    spark, most = df.sparkSession, max(len(j.predictors) for j in jobs) + 1
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    sums = [*(f"s_{i}" for i in range(most)), *(f"p_{i}_{j}" for i, j in pairs)]
    layout = Layout(jobs)
    rows = layout.rows(df.withColumns(values or {}), group, cluster)
    cells = cut(level_sums(rows, layout, most))
    again = [F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums)]
    named = F.when(F.col("n") >= least_group, F.concat(F.lit("="), "level")).otherwise(POOLED)
    grouped = cells.withColumn("group", named)
    groups = cut(grouped.groupBy("job", "group").agg(*again))
    inside = {f"c_{i}_{j}": F.sum(F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")) for i, j in pairs}
    totals = groups.groupBy("job").agg(*again, F.count("*").alias("groups"), *(c.alias(name) for name, c in inside.items())).collect()  # a row a job

    fits = {}
    for r in totals:
        job, n = jobs[r["job"]], r["n"]
        k = len(job.predictors) + 1
        full = lambda name: np.array([[r[f"{name}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])  # noqa: B023, E731
        mean = np.array([r[f"s_{i}"] for i in range(k)]) / n
        cov = full("p") / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        keep = [i for i in range(1, k) if sd[i] > 1e-12]
        if n < len(job.predictors) + least_spare or not keep or not sd[0] > 1e-12:
            continue
        within = full("c") / np.outer(np.where(sd > 1e-12, sd, 1), np.where(sd > 1e-12, sd, 1))
        inverse = np.linalg.pinv(within[np.ix_(keep, keep)])
        beta = inverse @ within[keep, 0]
        correlation = cov[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep])
        fits[r["job"]] = {"n": n, "keep": keep, "sd": sd, "beta": beta, "inverse": inverse, "k": len(keep) + r["groups"], "groups": r["groups"],
                          "r2": 1 - (within[0, 0] - beta @ within[keep, 0]) / n, "vif": np.diag(np.linalg.pinv(correlation)), "mean": mean}
    schema = ("response string, tier string, term string, beta double, se double, ci_lo double, ci_hi double, p double, vif double, n long, r2 double, adj_r2 double, "
              "se_kind string, n_clusters long, n_groups long, y_sd double")
    if not fits:
        return spark.createDataFrame([], schema)
    for f in fits.values():
        f["slope"], f["scaled"], scale = np.zeros(most - 1), np.zeros((most - 1, most - 1)), f["sd"][f["keep"]]
        at = [i - 1 for i in f["keep"]]
        f["slope"][at] = f["beta"] * f["sd"][0] / scale
        f["scaled"][np.ix_(at, at)] = f["inverse"] / np.outer(scale, scale)
    meats, clusters = {}, {}
    if errors:
        means, absorbing = None, [i for i, j in enumerate(jobs) if j.absorb]
        if absorbing:
            own = groups.select("job", "group", F.col("n").cast("double").alias("m_0"), *((F.col(f"s_{i}") / F.col("n")).alias(f"m_{i + 1}") for i in range(most)))
            per = grouped.filter(F.col("job").isin(absorbing)).select("job", "level", "group").join(own, ["job", "group"])
            means = per.groupBy("level").agg(F.array(*(F.coalesce(F.max(F.when(F.col("job") == a, F.col(f"m_{i}"))), F.lit(0.0)) for a in absorbing for i in range(most + 1))).alias("means"))
            means = cut(means)
            means = F.broadcast(means) if means.count() <= broadcast_levels else means
        if cluster:
            plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
            dealt = df.repartition(F.col(cluster), F.pmod(F.xxhash64(*plain), F.lit(shares))).sortWithinPartitions(cluster)
            rows = layout.rows(dealt.withColumns(values or {}), group, cluster)
        scores, hc3, clusters = error_parts(rows, layout, fits, means, most, cluster is not None)
        meats = {number: scores[number] if clusters.get(number, 0) >= least_clusters else hc3[number] for number in fits}
    out, counted = [], {number: clusters.get(number, 0) for number in fits}
    freedom = {number: float(counted[number] - 1 if counted[number] >= least_clusters else f["n"] - f["k"]) for number, f in fits.items()}
    quantile = t_quantiles([v for v in freedom.values() if v > 0]) if errors else {}
    told = lambda v: None if np.isnan(v) else float(v)
    for number, f in sorted(fits.items()):
        job, keep, n, k = jobs[number], f["keep"], f["n"], f["k"]
        clustered, free, se = counted[number] >= least_clusters, freedom[number], np.full(len(keep), np.nan)
        if errors:
            w = np.array([[meats[number][f"w_{min(i, j)}_{max(i, j)}"] for j in keep] for i in keep]) / np.outer(f["sd"][keep], f["sd"][keep]) / f["sd"][0] ** 2
            if clustered:
                w = w * counted[number] / (counted[number] - 1) * (n - 1) / (n - k)
            se = np.sqrt(np.clip(np.diag(f["inverse"] @ w @ f["inverse"]), 0, None))
        t = np.divide(f["beta"], se, out=np.full(len(keep), np.nan), where=se > 0)
        p, reach = t_tail(t, free), quantile.get(free, np.nan) * se
        for i, c in enumerate(keep):
            beta = float(f["beta"][i])
            spread = (float(se[i]), float(beta - reach[i]), float(beta + reach[i])) if errors else (None, None, None)
            out.append((job.response, job.tier, job.predictors[c - 1], beta, *spread, told(p[i]), float(f["vif"][i]), int(n), float(f["r2"]), float(1 - (1 - f["r2"]) * (n - 1) / (n - k)) if n > k else None,
                        ("cluster" if clustered else "HC3") if errors else None, int(counted[number]) if errors else None, int(f["groups"]), float(f["sd"][0])))
    return spark.createDataFrame(out, schema)
