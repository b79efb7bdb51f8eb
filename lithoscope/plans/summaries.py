"""Orders, texts and reports made of result tables, and the tiered regressions behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import cohort as C
from ..operators import matching as M
from ..operators import panel as P
from ..operators import spectra as E
from ..operators import stats as S
from ..operators import structure as T
from ..operators.deadline import with_deadline
from ..session import cut, spread
from ..sources import files
from ..sources.sinks import markdown, wide
from . import cohorts, modelling, statistics
from .tables import rounded, table

RESPONSES = ["price", "ln_price", "root_price", "net", "charge", "rebate", "levy", "unit_price", "weighted", "rate", "line", "p_retailprice"]


def _jobs() -> list[P.Job]:
    """Four tiers of every response."""
    tiers = [("M1 core", ("l_quantity",), False, None), ("M2 extended", ("l_quantity", "p_size"), False, None), ("M3 extended + category", ("l_quantity", "p_size"), True, None),
             ("GT discount", ("l_discount", "p_size"), False, F.col("l_discount") > 0)]
    return [P.Job(y, tier, predictors, absorb, where) for y in RESPONSES for tier, predictors, absorb, where in tiers]


def spectrum_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spectra of their customer, with a tier and a laser by number: the one that goes first of each."""
    tiers = F.array(*(F.lit(f"{q}_{o}") for o in ("oriented", "unoriented") for q in ("poor", "fair", "unrated", "excellent")))
    laser = F.when(F.col("o_orderkey") % 3 == 0, "532").otherwise("780")
    spectra = table(spark, sf_dir, "orders").select(
        "o_custkey", F.element_at(tiers, (F.pmod(F.col("o_orderkey") * 7, F.lit(8)) + 1).cast("int")).alias("tier"),
        F.concat(F.lit("M__R"), F.col("o_orderkey").cast("string"), F.lit("__Raman__"), laser, F.lit("__Raman_Data_Processed.txt")).alias("file"))
    ranked = spectra.withColumn("tier_rank", files.tier_rank(F.col("tier")))
    picked = M.pick_first(ranked, "o_custkey", F.lit(True), files.spectrum_order(), ["file", "tier"], F.lit(None).cast("string"))
    return picked.select("o_custkey", "picked.file", "picked.tier")


def structure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minerals of structure file names whose own name may hold double underscores."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("__"), F.col("p_partkey").cast("string"), F.lit(".cif")).alias("file"))
    return part.select("p_partkey", files.structure_name(F.col("file")).alias("mineral"))


def family_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of parts by size, the largest first; the list is a few dozen rows."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "family")).cast("long"))


def family_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by their median price, with the median and quartiles of its share of 3.14159 as text."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), (F.col("p_retailprice") / 3.14159).alias("price"))
    one = C.median_iqr(part, "family", ["price"]).filter("family <> 'All'")
    text = X.median_text(F.col("median"), F.col("q25"), F.col("q75"))
    order = Window.partitionBy(F.lit(0)).orderBy("median", "family")
    return one.select("family", "n", text.alias("price"), F.row_number().over(order).cast("long").alias("place"))


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_tax")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return S.kruskal(lines.join(part, "l_partkey"), ["p_type", "p_brand", "l_returnflag"], ["l_extendedprice", "l_quantity", "l_tax"])


def categorical_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten strongest effects of a category on a target: the cut is the report."""
    top = rounded(_effects(spark, sf_dir).select("factor", "target", "eta2", "n"), 5)
    return top.orderBy(F.desc("eta2"), "factor", "target").limit(10)


def eta2_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects as a matrix of factors by targets."""
    return wide(rounded(_effects(spark, sf_dir), 5), "factor", "target", "eta2", ["l_extendedprice", "l_quantity", "l_tax"])


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations as they are printed: estimate with interval, p, and marks."""
    return _interval_texts(S.rank_correlations(statistics._lines(spark, sf_dir), statistics.FEATURES, statistics.TARGETS))


def _interval_texts(correlations: DataFrame) -> DataFrame:
    df = S.benjamini_hochberg(S.with_interval(correlations))
    return df.select("feature", "target", X.interval_text(F.col("rho"), F.col("ci_lo"), F.col("ci_hi")).alias("estimate"), X.p_text(F.col("p")).alias("p"), X.stars(F.col("q")).alias("mark"))


def p_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts and taxes of lines read as p values: how each is printed."""
    p = F.col("l_tax") * F.col("l_discount") / F.col("l_linenumber") / 7
    return table(spark, sf_dir, "lineitem").select(p.alias("v")).groupBy(X.p_text(F.col("v")).alias("p"), X.stars(F.col("v")).alias("mark")).agg(F.count("*").alias("n"))


def three_digit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over powers of ten, printed with three significant digits."""
    v = F.col("p_retailprice") / F.pow(F.lit(10.0), F.col("p_partkey") % 12 - 2) / 3.14159
    return table(spark, sf_dir, "part").select("p_partkey", X.three_digits(v).alias("text"))


def structure_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as structures with block errors and two groups: which are ok, consistent, and what is told."""
    k = F.col("p_partkey")
    blocks = {"group_theory": F.when(k % 11 == 0, "no group"), "bonds": F.when(k % 7 == 0, "no bonds"), "environments": F.lit("")}
    group, primitive = F.when(k % 5 > 0, k % 230), F.when(k % 3 > 0, F.when(k % 4 == 0, F.lit(1).cast("long")).otherwise(k % 230))
    return table(spark, sf_dir, "part").select("p_partkey", *T.structure_status(blocks, group, primitive, "group_theory"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the type, size and price of their part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", "p_retailprice")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice").join(part, "l_partkey").drop("l_partkey")


def _responses() -> dict[str, Column]:
    """Amounts, rates and their transforms; made after the joins and shuffles, as they are more than what they are made from."""
    price, discount, tax, quantity = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    return {"price": price, "ln_price": F.ln(price), "root_price": F.sqrt(price), "net": price * (1 - discount), "charge": price * (1 - discount) * (1 + tax), "rebate": price * discount, "levy": price * tax,
            "unit_price": price / quantity, "weighted": price * quantity, "rate": tax, "line": F.col("l_linenumber")}


def timed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit sums of parts' numbers, each with a deadline of two seconds; a few records never end."""
    import time

    def digits(number: int) -> int:
        while number % 997 == 17:
            time.sleep(1)
        return sum(map(int, str(number)))

    return with_deadline(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"), "p_partkey", digits, "int", 2.0, "digits")


def tiered_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response on the core predictors, the extended ones, these with an effect of each part type, and on a sub-sample
    (lines with a discount) with its own predictor; standardised slopes with clustered errors, q values within each tier."""
    out = P.tiered_regressions(_lines(spark, sf_dir), _jobs(), "p_type", "l_suppkey", values=_responses())
    return S.benjamini_hochberg(out, panel=["tier"])


def tiered_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slopes and R2 of all tiers, without errors, for SQL to have them too."""
    return rounded(P.tiered_regressions(_lines(spark, sf_dir), _jobs(), "p_type", errors=False, values=_responses()).select("response", "tier", "term", "beta", "n", "r2", "n_groups"), 5)


def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight strongest significant slopes of the extended tiers: the cut is the report."""
    strong = tiered_regressions(spark, sf_dir).filter("q < 0.05 AND tier <> 'M1 core'")
    return strong.orderBy(F.desc(F.abs("beta")), "response", "tier", "term").limit(8)


def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regressions as text, one section for each response and tier; terms are printed with their interval, p and mark."""
    df = tiered_regressions(spark, sf_dir)
    line = F.concat_ws("  ", F.rpad("term", 16, " "), X.interval_text(F.col("beta"), F.col("ci_lo"), F.col("ci_hi")), X.p_text(F.col("p")), X.stars(F.col("q")))
    per = df.groupBy("response", "tier").agg(F.first("n").alias("n"), F.first("r2").alias("r2"), F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.format_string("%s, %s: n = %d, R2 = %.3f\n", "response", "tier", "n", "r2")
    return per.select("response", "tier", F.concat(head, F.array_join("lines", "\n")).alias("text"))


def sparse_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lasso's equation: its six strongest terms, each with how often it stays in a bootstrap."""
    both = modelling.lasso_1se(spark, sf_dir).join(modelling.lasso_stability(spark, sf_dir), "feature").filter(F.abs("coefficient") > 1e-8)
    top = both.orderBy(F.desc(F.abs("coefficient")), "feature").limit(6)
    term = F.format_string("%+.2f*[%s](%.0f%%)", "coefficient", "feature", F.col("frequency") * 100)
    terms = F.array_sort(F.collect_list(F.struct((-F.abs("coefficient")).alias("o"), "feature", term.alias("t"))))
    return top.agg(F.concat(F.lit("z(y) ~ "), F.array_join(F.transform(terms, lambda x: x["t"]), " ")).alias("equation"))


METHODS = (
    "Spectra are cut to {low:g}-{high:g} and need {points} points; the baseline is a rolling minimum over 1/40 of them on either side. Correlations are of average ranks after pairwise deletion, with intervals by Fisher's "
    "z and false discovery rates by Benjamini and Hochberg. Effects of categories are eta squared of Kruskal and Wallis over levels of 8 rows or more. Regressions are standardised, in tiers {tiers}, with errors clustered from "
    "20 clusters on, else HC3; groups of fewer than 15 rows share an effect. Out-of-fold figures never split a group, their intervals are 2.5 and 97.5 percentiles over 300 draws of groups.")


def _told(funnel: list, effects: list, pairs: list, slopes: list) -> str:
    """What the first rows of result tables say, as sentences; a table without rows says nothing."""
    out = []
    if funnel:
        out.append(f"Of {funnel[0]['n']} records {funnel[-1]['n']} pass all {len(funnel) - 1} checks.")
    if effects:
        out.append(f"The strongest category is {effects[0]['factor']}, with an eta squared of {effects[0]['eta2']:.3f} on {effects[0]['target']} (n = {effects[0]['n']}).")
    if pairs:
        up = "rises" if pairs[0]["rho"] > 0 else "falls"
        out.append(f"{pairs[0]['target']} {up} most with {pairs[0]['feature']} (rho = {pairs[0]['rho']:.3f}, n = {pairs[0]['n']}).")
    if slopes:
        out.append(f"The strongest significant slope of the extended tiers is that of {slopes[0]['term']} on {slopes[0]['response']} in {slopes[0]['tier']} ({slopes[0]['beta']:.2f}, 95 % from {slopes[0]['ci_lo']:.2f} to {slopes[0]['ci_hi']:.2f}).")
    return " ".join(out)


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as texts: methods with the parameters in use, what the result tables say, and the tables of cohort, categories and
    correlations; all made from result tables of a few rows, each of which is computed once."""
    correlations = S.rank_correlations(statistics._lines(spark, sf_dir), statistics.FEATURES, statistics.TARGETS)  # a row a pair, for both the finding and the table
    funnel, effects = cut(cohorts.qc_funnel(spark, sf_dir)).orderBy("step_no"), cut(categorical_effects(spark, sf_dir)).orderBy(F.desc("eta2"), "factor", "target")
    pairs = rounded(correlations).filter("rho IS NOT NULL").orderBy(F.desc(F.abs("rho")), "feature", "target").limit(1)
    slopes = top_coefficients(spark, sf_dir).orderBy(F.desc(F.abs("beta")), "response", "tier", "term")
    methods = METHODS.format(low=E.RANGE[0], high=E.RANGE[1], points=E.LEAST_POINTS, tiers=", ".join(dict.fromkeys(j.tier for j in _jobs())))
    texts = [("Methods", methods), ("Findings", _told(funnel.limit(100).collect(), effects.collect(), pairs.collect(), slopes.collect()))]
    parts = [("Cohort", funnel), ("Categorical factors", effects), ("Correlations", _interval_texts(correlations).orderBy("feature", "target"))]
    rows = [*texts, *((title, markdown(df)) for title, df in parts)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "section long, title string, text string")


QUERIES = {f.__name__: f for f in (
    spectrum_pick, structure_names, family_sizes, family_medians, categorical_effects, eta2_matrix, interval_texts, p_texts, three_digit_texts, structure_ok, timed_records, tiered_regressions, tiered_slopes,
    top_coefficients, regression_report, sparse_equations, summary_text)}

_KINDS = """
WITH l AS (SELECT p_type, p_brand, l_returnflag, l_extendedprice, l_quantity, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey
), g AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{t}' AS target, {f} AS level, {t} AS y FROM l WHERE {t} IS NOT NULL AND {f} IS NOT NULL" for f in ("p_type", "p_brand", "l_returnflag") for t in ("l_extendedprice", "l_quantity", "l_tax")) + """
), k AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY factor, target, level) >= 8
), r AS (SELECT *, rank() OVER (PARTITION BY factor, target ORDER BY y) + (count(*) OVER (PARTITION BY factor, target, y) - 1) / 2.0::DOUBLE AS rk FROM k
), t AS (SELECT factor, target, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT factor, target, y, count(*) AS c FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2
), v AS (SELECT factor, target, level, sum(rk) AS s, count(*) AS m FROM r GROUP BY 1, 2, 3
), h AS (SELECT factor, target, sum(m)::BIGINT AS n, count(*) AS k, (12 * sum(s * s / m) / (sum(m)::DOUBLE * (sum(m) + 1)) - 3 * (sum(m) + 1)) / (1 - any_value(ties) / (sum(m)::DOUBLE ** 3 - sum(m))) AS h FROM v JOIN t USING (factor, target) GROUP BY 1, 2
), e AS (SELECT factor, target, round(greatest(0, (h - k + 1) / (n - k)), 5) + 0 AS eta2, n FROM h)"""
_TIERS = [("M1 core", "l_quantity", None, "''", "TRUE"), ("M2 extended", "l_quantity", "p_size", "''", "TRUE"), ("M3 extended + category", "l_quantity", "p_size", "p_type", "TRUE"), ("GT discount", "l_discount", "p_size", "''", "l_discount > 0")]
#: Two slopes by Cramer's rule on products of columns less their group means.
_SLOPES = """
WITH l AS (SELECT p_type, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, p_size::DOUBLE AS p_size, l_linenumber::DOUBLE AS line, l_extendedprice AS price, ln(l_extendedprice) AS ln_price, sqrt(l_extendedprice) AS root_price,
    l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice * l_discount AS rebate, l_extendedprice * l_tax AS levy, l_extendedprice / l_quantity AS unit_price,
    l_extendedprice * l_quantity AS weighted, l_tax AS rate, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey
), j AS (""" + " UNION ALL ".join(f"SELECT '{y}' AS response, '{tier}' AS tier, {level} AS level, {y}::DOUBLE AS y, {a}::DOUBLE AS a, {b or 0}::DOUBLE AS b, '{a}' AS na, {f"'{b}'" if b else 'NULL'} AS nb FROM l WHERE {where}"
                                    for y in RESPONSES for tier, a, b, level, where in _TIERS) + """
), k AS (SELECT * FROM j WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL
), m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY response, tier, level) >= 15 THEN level ELSE '-' END AS grp FROM k
), d AS (SELECT *, y - avg(y) OVER g AS dy, a - avg(a) OVER g AS da, b - avg(b) OVER g AS db, stddev_pop(y) OVER t AS sy, stddev_pop(a) OVER t AS sa, stddev_pop(b) OVER t AS sb FROM m
  WINDOW g AS (PARTITION BY response, tier, grp), t AS (PARTITION BY response, tier)
), s AS (SELECT response, tier, any_value(na) AS na, any_value(nb) AS nb, count(*) AS n, count(DISTINCT grp) AS n_groups, any_value(sy) AS sy, any_value(sa) AS sa, any_value(sb) AS sb,
    sum(da * da) AS aa, sum(da * db) AS ab, sum(db * db) AS bb, sum(da * dy) AS ay, sum(db * dy) AS by_, sum(dy * dy) AS yy FROM d GROUP BY response, tier
), c AS (SELECT *, CASE WHEN nb IS NULL THEN ay / aa ELSE (ay * bb - by_ * ab) / (aa * bb - ab * ab) END AS ca, CASE WHEN nb IS NOT NULL THEN (by_ * aa - ay * ab) / (aa * bb - ab * ab) ELSE 0 END AS cb FROM s WHERE sy > 1e-12
), r AS (SELECT *, 1 - (yy - ca * ay - cb * by_) / (n * sy * sy) AS r2 FROM c)
SELECT response, tier, na AS term, round(ca * sa / sy, 5) + 0 AS beta, n, round(r2, 5) + 0 AS r2, n_groups FROM r
UNION ALL SELECT response, tier, nb, round(cb * sb / sy, 5) + 0, n, round(r2, 5) + 0, n_groups FROM r WHERE nb IS NOT NULL"""
ORACLES = {
    "timed_records": """
SELECT p_partkey, CASE WHEN p_partkey % 997 <> 17 THEN list_sum(list_transform(string_split(p_partkey::VARCHAR, ''), lambda d: d::INTEGER)) END AS digits, CASE WHEN p_partkey % 997 = 17 THEN 'timeout' ELSE 'ok' END AS status FROM part""",
    "tiered_slopes": _SLOPES,
    "spectrum_pick": """
WITH s AS (SELECT o_custkey, ['poor_oriented', 'fair_oriented', 'unrated_oriented', 'excellent_oriented', 'poor_unoriented', 'fair_unoriented', 'unrated_unoriented', 'excellent_unoriented'][(o_orderkey * 7) % 8 + 1] AS tier,
  'M__R' || o_orderkey || '__Raman__' || CASE WHEN o_orderkey % 3 = 0 THEN '532' ELSE '780' END || '__Raman_Data_Processed.txt' AS file FROM orders
), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['excellent_unoriented', 'excellent_oriented', 'fair_unoriented', 'fair_oriented', 'unrated_unoriented', 'unrated_oriented',
  'poor_unoriented', 'poor_oriented'], tier), CASE WHEN file LIKE '%\\_\\_532\\_\\_%' ESCAPE '\\' THEN 0 ELSE 1 END, file) AS k FROM s)
SELECT o_custkey, file, tier FROM r WHERE k = 1""",
    "structure_names": "SELECT p_partkey, replace(p_name, ' ', '__') AS mineral FROM part",
    "family_sizes": "SELECT p_type AS family, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1",
    "family_medians": """
SELECT p_type AS family, count(p_retailprice) AS n, format('{:.3g} [{:.3g}-{:.3g}]', median(p_retailprice / 3.14159::DOUBLE), quantile_cont(p_retailprice / 3.14159::DOUBLE, 0.25), quantile_cont(p_retailprice / 3.14159::DOUBLE, 0.75)) AS price,
  row_number() OVER (ORDER BY median(p_retailprice / 3.14159::DOUBLE), p_type) AS place FROM part GROUP BY 1""",
    "categorical_effects": _KINDS + "SELECT * FROM e ORDER BY eta2 DESC, factor, target LIMIT 10",
    "eta2_matrix": _KINDS + "SELECT factor, " + ", ".join(f"max(eta2) FILTER (WHERE target = '{t}') AS {t}" for t in ("l_extendedprice", "l_quantity", "l_tax")) + " FROM e GROUP BY 1",
    "p_texts": """
WITH v AS (SELECT l_tax * l_discount / l_linenumber / 7 AS v FROM lineitem)
SELECT CASE WHEN v IS NULL THEN '' WHEN v < 0.001 THEN '<0.001' ELSE printf('%.3f', v) END AS p, CASE WHEN v < 0.001 THEN '***' WHEN v < 0.01 THEN '**' WHEN v < 0.05 THEN '*' ELSE '' END AS mark, count(*) AS n FROM v GROUP BY 1, 2""",
    "three_digit_texts": "SELECT p_partkey, format('{:.3g}', p_retailprice / pow(10.0, p_partkey % 12 - 2) / 3.14159::DOUBLE) AS text FROM part",
    "structure_ok": """
WITH s AS (SELECT p_partkey, p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 230 END AS g, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE p_partkey % 230 END END AS p FROM part
), c AS (SELECT *, coalesce(g > 0, false) AS known FROM s
), t AS (SELECT *, CASE WHEN known AND p IS NOT NULL THEN p = g END AS same FROM c)
SELECT p_partkey, known AND k % 11 <> 0 AS ok, same AS symmetry_consistent, concat_ws('; ', CASE WHEN k % 11 = 0 THEN 'group_theory: no group' END, CASE WHEN k % 7 = 0 THEN 'bonds: no bonds' END,
  CASE WHEN NOT same THEN 'sg_mismatch_after_primitive(' || p || ')' END) AS error FROM t""",
}
