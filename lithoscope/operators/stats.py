"""Rank statistics and regression in a few passes over the data.

Pairs that need the same rows share them: a column is ranked once in each population of rows, from counts of its values, and all
pairs come from one aggregate, not one job or one copy of the rows per pair. Regression reads sums of products (a k x k matrix) and solves them on the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_pvalue, t_pvalue, t_tail
from ..session import cut
from .ranking import value_places


def wanted_pairs(features: list[str], targets: list[str], covariates: tuple[str, ...] = (), trivial: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str]]:
    """All pairs but those of a column with itself or a covariate, and the trivial ones."""
    return [(a, b) for a in features for b in targets if a != b and a not in covariates and (a, b) not in trivial]


def named(number: str, names: list[tuple[str, str]], into: tuple[str, str]) -> list[Column]:
    """The two names that belong to a number, as columns."""
    return [F.get(F.array(*(F.lit(n[i]) for n in names)), F.col(number)).alias(c) for i, c in enumerate(into)]


def masked(df: DataFrame, columns: list[str], subsets: dict[str, Column]) -> DataFrame:
    """The columns as numbers (NaN is missing), the bit pattern ``__m`` of a row's missing ones and a flag ``__s<i>`` for each subset."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    rows = df.select(*(F.coalesce(c, F.lit(False)).alias(f"__s{i}") for i, c in enumerate(subsets.values())), *map(number, columns))
    bits = (F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns))
    return rows.withColumn("__m", sum(bits, F.lit(0).cast("long")))


def populations(patterns: list[int], wanted: list[tuple[str, str]], columns: list[str], covariates: tuple[str, ...], n_subsets: int) -> tuple[list[Column], list[list], list[set]]:
    """(whether a row belongs to it, its pairs as (subset, number), its columns) of each population: pairs that need the same rows share one.

    A pair's population is the set of occurring patterns of missing columns without any of its own, in a subset.
    """
    bit, numbers, pairs, used = {c: 1 << i for i, c in enumerate(columns)}, {}, [], []
    for k, (a, b) in enumerate(wanted):
        need = sum(bit[c] for c in {a, b, *covariates})
        complete = tuple(sorted(m for m in patterns if not m & need))
        for s in range(n_subsets if complete else 0):
            p = numbers.setdefault((s, complete), len(numbers))
            if p == len(pairs):
                pairs.append([])
                used.append(set())
            pairs[p].append((s, k))
            used[p].update((a, b, *covariates))
    return [F.col(f"__s{s}") & F.col("__m").isin(list(complete)) for s, complete in numbers], pairs, used


def _partial(products: dict, a: str, b: str, covariates: tuple[str, ...]) -> float | None:
    """Correlation of two columns from their products, the covariates taken out one at a time; None if undefined."""
    names, known = [a, b, *covariates], {}
    for x, y in combinations(names, 2):
        spread = np.sqrt(products[frozenset((x,))]) * np.sqrt(products[frozenset((y,))])
        known[frozenset((x, y))] = products[frozenset((x, y))] / spread if spread > 0 else None
    for i in reversed(range(len(covariates))):
        z, left, now = covariates[i], [a, b, *covariates[:i]], {}
        for x, y in combinations(left, 2):
            p, q, r = (known[frozenset(pair)] for pair in ((x, y), (x, z), (y, z)))
            rest = 0.0 if None in (p, q, r) else (1 - q * q) * (1 - r * r)
            now[frozenset((x, y))] = (p - q * r) / np.sqrt(rest) if rest > 0 else None
        known = now
    rho = known[frozenset((a, b))]
    return None if rho is None else float(rho)


def rank_correlations(df: DataFrame, features: list[str], targets: list[str], covariates: tuple[str, ...] = (), trivial: tuple[tuple[str, str], ...] = (),
                      subsets: dict[str, Column] | None = None, most: int = 4096, shared: int = 1_000_000) -> DataFrame:
    """(feature, target, rho, n): correlation of average ranks, the covariates' ranks taken out, after pairwise deletion.

    The rows are read twice, however many pairs and subsets there are. The first pass counts the values of each column by pattern
    of missing columns and subset; ranks in each population of rows follow from these counts (``value_places``). A rank less
    the mean rank of its population is exact, so that variances come from the counts as well. The second pass looks up the
    ranks and adds up their products. A column with up to ``shared`` ranks is looked up in a broadcast table, others by a join.

    Partial correlation follows from the pairwise ones by removing a covariate at a time. Too few rows (10 and one per
    covariate) or a constant column: NULL. Pairs without any complete row do not appear. With ``subsets`` (name -> condition)
    there is a first column ``subset``. More than ``most`` patterns of missing columns are an error.
    """
    wanted, given = wanted_pairs(features, targets, covariates, trivial), subsets or {"": F.lit(True)}
    columns = list(dict.fromkeys([c for pair in wanted for c in pair] + list(covariates)))
    names, flags, spark = list(given), [f"__s{i}" for i in range(len(given))], df.sparkSession
    schema = ("subset string, " if subsets else "") + "feature string, target string, rho double, n long"
    if not wanted:
        return spark.createDataFrame([], schema)
    rows = masked(df, columns, given)
    each = rows.select("__m", *flags, F.posexplode(F.array(*columns)).alias("__c", "__v")).filter("__v IS NOT NULL")
    counts = cut(each.groupBy("__c", "__v", "__m", *flags).agg(F.count("*").alias("__n")))
    patterns = [r["__m"] for r in counts.select("__m").distinct().limit(most + 1).collect()]
    if len(patterns) > most:
        raise ValueError(f"more than {most} patterns of missing columns")
    inside, pairs, used = populations(patterns, wanted, columns, covariates, len(given))
    if not pairs:
        return spark.createDataFrame([], schema)
    owns = (F.when(on & F.col("__c").isin([columns.index(c) for c in used[p]]), F.lit(p)) for p, on in enumerate(inside))
    per = counts.select("__c", "__v", "__n", F.explode(F.array_compact(F.array(*owns))).alias("__p"))
    places = cut(value_places(per, ["__c", "__p"], "__v", weight="__n").withColumn("__r", F.col("before") + (F.col("n") - F.col("total")) / 2))
    known = places.groupBy("__c", "__p").agg(F.max("total").alias("total"), F.count("*").alias("values"), F.sum(F.col("n") * F.col("__r") * F.col("__r")).alias("square")).collect()  # a row a column and population
    size, ranks = [0] * len(columns), [[] for _ in columns]
    for r in known:
        size[r["__c"]] += r["values"]
        ranks[r["__c"]].append(r["__p"])
    looked = rows
    for c in sorted(range(len(columns)), key=lambda c: -size[c]):  # joins that shuffle come first, while rows are narrow
        own = places.filter(F.col("__c") == c).groupBy(F.col("__v").alias(columns[c])).agg(*(F.max(F.when(F.col("__p") == p, F.col("__r"))).alias(f"__r{c}_{p}") for p in ranks[c]))
        looked = looked.join(F.broadcast(own) if size[c] <= shared else own, columns[c], "left")
    needs = [sorted({tuple(sorted(columns.index(c) for c in pair)) for _, k in some for pair in combinations((*wanted[k], *covariates), 2)}) for some in pairs]
    total = {(r["__c"], r["__p"]): r["total"] for r in known}
    sums = [F.sum(F.when(on, F.col(f"__r{a}_{p}") * F.col(f"__r{b}_{p}"))).alias(f"{a}_{b}_{p}") for p, on in enumerate(inside) for a, b in needs[p] if (a, p) in total]
    got, out = looked.agg(*sums).first() if sums else {}, []
    for p, some in enumerate(pairs):
        products = {frozenset((columns[r["__c"]],)): r["square"] for r in known if r["__p"] == p}
        if products:  # else no row
            products |= {frozenset((columns[a], columns[b])): got[f"{a}_{b}_{p}"] for a, b in needs[p]}
            for s, k in some:
                n = total[columns.index(wanted[k][0]), p]
                rho = _partial(products, *wanted[k], covariates) if n >= 10 + len(covariates) else None
                out.append((*([names[s]] if subsets else []), *wanted[k], rho, n))
    return spark.createDataFrame(out, schema)


def with_interval(df: DataFrame, n_covariates: int = 0) -> DataFrame:
    """Adds p (two-sided t) and the 95 % interval by Fisher's z with the wider standard error for ranks."""
    r, n, k = F.col("rho"), F.col("n"), n_covariates
    free = n - 2 - k
    z = F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))
    se = F.sqrt((1 + r * r / 2) / F.greatest(n - 3 - k, F.lit(1)))
    out = df.withColumn("p", t_pvalue(r * F.sqrt(free / F.greatest(F.lit(1e-12), 1 - r * r)), free))
    return out.withColumns({"ci_lo": F.tanh(z - 1.96 * se), "ci_hi": F.tanh(z + 1.96 * se)})


def benjamini_hochberg(df: DataFrame, p: str = "p", panel: list[str] | None = None, out: str = "q") -> DataFrame:
    """Adds q within each panel of tests. A panel is a table of results, so its window is small; NULL p has NULL q.

    Tied p share their largest rank, which gives all of them the q that the step-up rule would.
    """
    known = Window.partitionBy(*(panel or [F.lit(0)]), F.col(p).isNull())
    rank = F.count("*").over(known.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    step = df.withColumn("__q", F.col(p) * F.count("*").over(known) / rank)
    least = F.min("__q").over(known.orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.least(least, F.lit(1.0)))).drop("__q")


def kruskal(df: DataFrame, factors: list[str], targets: list[str], least: int = 8) -> DataFrame:
    """(factor, target, eta2, h, n, k_levels, p): Kruskal-Wallis with ties and its effect size, levels of ``least`` rows or more.

    Fewer than two levels: NULL statistics.
    """
    wanted = [(f, t) for f in factors for t in targets]
    rows = F.array(*(F.struct(F.lit(i).alias("pair"), F.col(f).cast("string").alias("level"), F.col(t).cast("double").alias("y")) for i, (f, t) in enumerate(wanted)))
    long = df.select(F.explode(rows).alias("r")).select("r.*").na.drop()
    every = cut(long.groupBy("pair", "level", "y").agg(F.count("*").alias("c")))  # equal values of a level have one rank: the rows are read once
    large = every.groupBy("pair", "level").agg(F.sum("c").alias("m")).filter(F.col("m") >= least).drop("m")
    counts = every.join(large, ["pair", "level"])
    places = cut(value_places(counts, ["pair"], "y", weight="c"))
    ties = places.groupBy("pair").agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    ranks = places.select("pair", "y", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    per_level = counts.join(ranks, ["pair", "y"]).groupBy("pair", "level").agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("m"))
    n, k = F.col("n"), F.col("k_levels")
    raw = F.try_divide(12 * F.col("s"), n * (n + 1)) - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.try_divide(F.col("ties"), F.pow(n, F.lit(3)) - n))
    out = per_level.groupBy("pair").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count("*").alias("k_levels")).join(ties, "pair")
    out = out.withColumn("h", F.when(k >= 2, h))
    eta = F.greatest(F.lit(0.0), F.try_divide(F.col("h") - k + 1, F.when(n > k, n - k)))
    return out.select(*named("pair", wanted, ("factor", "target")), F.when(F.col("h").isNotNull(), eta).alias("eta2"), "h", "n", "k_levels", chi2_pvalue(F.col("h"), k - 1).alias("p"))


def product_sums(columns: list[str], weight: Column | None = None) -> list[Column]:
    """Aggregates of the upper triangle of X'X, ``[1, *columns]`` being X."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(w * x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]


def as_matrix(row, k: int) -> np.ndarray:
    """The symmetric k x k matrix of a row of ``product_sums``."""
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"g_{i}_{j}"] or 0.0
    return m


def ols(df: DataFrame, y: str, columns: list[str], cluster: str | None = None, least_clusters: int = 20) -> list[dict]:
    """One row per term: beta, se, t, p, n, r2, adj_r2, se_kind. Rows with a missing value go.

    Standard errors: clustered (CR1, df = clusters - 1) if there are enough clusters, else HC3 (df = n - k). Scores
    are summed per cluster by the executors; the driver sees k x k matrices only.
    """
    used = df.select(y, *columns, *([cluster] if cluster else [])).na.drop()
    k, names = len(columns) + 1, ["const", *columns]
    g = as_matrix(used.agg(*product_sums([*columns, y])).first(), k + 1)
    n, xtx, xty, yy, sum_y = g[0, 0], g[:k, :k], g[:k, k], g[k, k], g[0, k]
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    dot = lambda v: sum((float(b) * c for b, c in zip(v, x)), F.lit(0.0))
    scored = used.withColumn("__e", F.col(y) - dot(beta))
    clusters = used.select(cluster).distinct().count() if cluster else 0
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    if clusters >= least_clusters:
        scores = scored.groupBy(cluster).agg(*(F.sum(c * F.col("__e")).alias(f"s{i}") for i, c in enumerate(x)))
        meat = as_matrix(scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g_{i}_{j}") for i, j in upper)).first(), k)
        meat, free, kind = meat * clusters / (clusters - 1) * (n - 1) / (n - k), clusters - 1, "cluster"
    else:
        leverage = sum((c * dot(row) for c, row in zip(x, inverse)), F.lit(0.0))
        u = scored.withColumn("__u", F.col("__e") / F.greatest(1 - leverage, F.lit(1e-8)))
        meat, free, kind = as_matrix(u.agg(*(F.sum(x[i] * x[j] * F.pow("__u", F.lit(2))).alias(f"g_{i}_{j}") for i, j in upper)).first(), k), n - k, "HC3"
    se = np.sqrt(np.clip(np.diag(inverse @ meat @ inverse), 0, None))
    sse, sst = yy - 2 * beta @ xty + beta @ xtx @ beta, yy - sum_y**2 / n
    r2 = 1 - sse / sst if sst > 0 else None
    t = np.divide(beta, se, out=np.full(k, np.nan), where=se > 0)
    p = t_tail(t, np.full(k, float(free)))
    clean = lambda v: None if v is None or np.isnan(v) else float(v)
    return [{"term": names[i], "beta": float(beta[i]), "se": float(se[i]), "t": clean(t[i]), "p": clean(p[i]), "n": int(n), "r2": clean(r2),
             "adj_r2": clean(1 - (1 - r2) * (n - 1) / (n - k)) if r2 is not None else None, "se_kind": kind} for i in range(k)]


def variance_inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Diagonal of the inverse of the correlation matrix, from one aggregate."""
    g = as_matrix(df.select(*columns).na.drop().agg(*product_sums(columns)).first(), len(columns) + 1)
    mean = g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return dict(zip(columns, np.diag(np.linalg.pinv(cov / np.outer(sd, sd))).tolist()))


def agreement(table: DataFrame, main: str, strong_q: float = 0.05, strong_rho: float = 0.2) -> DataFrame:
    """A row for each other subset of a table of correlations (subset, feature, target, rho, q): the strong pairs of the subset
    ``main``, the share of them with the same sign in the other, and with the same sign and q below 0.05 there."""
    first = table.filter(F.col("subset") == main).select("feature", "target", F.col("rho").alias("a"), F.col("q").alias("qa"))
    both = table.filter(F.col("subset") != main).select("subset", "feature", "target", F.col("rho").alias("b"), F.col("q").alias("qb")).join(first, ["feature", "target"])
    strong = (F.col("qa") < strong_q) & (F.abs("a") >= strong_rho)
    same = F.signum("a") == F.signum("b")
    mean = lambda c: F.avg(F.when(strong, F.coalesce(c, F.lit(False)).cast("int")))
    return both.groupBy("subset").agg(F.count_if(strong).alias("n_strong"), mean(same).alias("same_sign"), mean(same & (F.col("qb") < 0.05)).alias("same_sign_and_q"))


def exclusive_picks(table: DataFrame, targets: list[str], most: int = 10_000) -> list[tuple[str, str, float]]:
    """(feature, target, rho): each target in turn takes its strongest feature that no target before it has.

    Sequential by nature and over a result table, so it runs on the driver; more than ``most`` rows are an error.
    """
    rows = table.filter(F.col("rho").isNotNull() & F.col("target").isin(targets)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a result table has more than {most} rows")
    picks, used = [], set()
    for target in targets:
        free = [r for r in rows if r["target"] == target and r["feature"] not in used]
        if free:
            best = min(free, key=lambda r: (-abs(r["rho"]), r["feature"]))
            used.add(best["feature"])
            picks.append((best["feature"], target, best["rho"]))
    return picks
