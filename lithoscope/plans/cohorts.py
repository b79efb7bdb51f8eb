"""Cohort and matching queries on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import cohort as C
from ..operators import matching as M
from ..operators.ranking import exact_quantiles
from .tables import rounded, table


def qc_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").join(lines, "o_orderkey", "left")
    steps = [("Status in {F,O}", F.col("o_orderstatus").isin("F", "O")), ("Price >= 100000", X.clean_float(F.col("o_totalprice")) >= 100000),
             ("Lines >= 3", F.col("n_lines") >= 3), ("Priority = 1-URGENT", F.col("o_orderpriority") == "1-URGENT")]
    return C.funnel(orders, steps).withColumn("step_no", F.col("step_no").cast("long"))


def cohort_median_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.median_iqr(table(spark, sf_dir, "part").withColumnRenamed("p_type", "family"), "family", ["p_size", "p_retailprice"]))


def family_profile_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("family"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    scored = C.standard_scores(lines, ["l_extendedprice", "l_quantity"]).join(part, "l_partkey")
    long = scored.select("family", F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"z_{c}").alias("z")) for c in ("l_extendedprice", "l_quantity")))).alias("e")).select("family", "e.*")
    return rounded(exact_quantiles(long, ["family", "variable"], "z", {"median_z": 0.5}))


def ratio_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per order of a customer, as quartiles per market segment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    per = orders.join(lines, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    eta = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("family")).join(per, "c_custkey").withColumn("eta", F.try_divide("lines", F.when(F.col("orders") > 0, F.col("orders"))))
    return rounded(exact_quantiles(eta, ["family"], "eta", C.QUARTILES))


def wl_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laser groups of the first whole number in a text, scaled to hit every group."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    text = F.when(k < 10, F.lit("no laser")).when(k < 30, F.lit("532 nm")).when(k < 60, F.concat((F.lit(750) + k).cast("string"), F.lit("nm"))).when(k < 90, F.concat(F.lit("laser "), k.cast("string")))
    return table(spark, sf_dir, "events").groupBy(X.wavelength_group(text).alias("wl_group")).agg(F.count("*").alias("n"))


def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents have no label or text."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("chars")).join(labels, "doc_id", "left")
    unlabelled = F.when(F.coalesce(F.col("chars"), F.lit(0)) == 0, "empty_text").when(F.col("lang") != "en", "other_language").otherwise("not_labelled")
    rules = {c: F.when(F.col(c).isNotNull(), "available").otherwise(unlabelled) for c in ("quality", "toxic")} | {"chars": F.when(F.col("chars").isNotNull(), "available").otherwise("no_text")}
    return rounded(C.reasons(docs, rules))


def rare_level_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.pool_rare(table(spark, sf_dir, "documents").select("source"), "source", 60, "small_sources_pooled", "pooled")
    return docs.groupBy("pooled").agg(F.count("*").alias("n"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("seg"))
    levels = [r[0] for r in customers.select("seg").distinct().filter("seg IS NOT NULL").collect()]  # a handful of levels
    return C.one_hot(customers, "seg", levels).drop("seg")


def decile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = C.quantile_bins(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice")
    both = F.array(F.struct(F.lit("x").alias("c"), F.col("l_extendedprice").cast("double").alias("v")), F.struct(F.lit("y").alias("c"), F.col("l_quantity").cast("double").alias("v")))
    long = exact_quantiles(binned.select("bin", F.explode(both).alias("r")).select("bin", "r.*"), ["bin", "c"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    of = lambda c, q: F.max(F.when(F.col("c") == c, F.col(q))).alias(f"{c}_{q}")
    wide = long.groupBy("bin").agg(F.max(F.when(F.col("c") == "x", F.col("n"))).alias("n"), of("x", "median"), of("y", "q25"), of("y", "median"), of("y", "q75"))
    return rounded(wide.withColumn("bin", F.col("bin").cast("long")))


def auto_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("squared"))
    return C.choose_transforms(lines, lines.columns)


def usable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("constant"), F.when(F.col("l_linenumber") > 99, 1.0).alias("absent"))
    return C.usable(lines, lines.columns)


def name_normalise_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts matched with names in another spelling, grouped on both sides first."""
    part = table(spark, sf_dir, "part").select(X.normalise_name(F.col("p_name")).alias("mineral_norm"), "p_partkey")
    left = part.groupBy("mineral_norm").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))
    spelled = F.transform(F.array(*map(F.lit, ("Small-Ring", "RED  widget", "blue_bolt!", "Nothing (synthetic)"))), lambda v: v)
    right = spark.range(1).select(F.explode(spelled).alias("spelling")).select(X.normalise_name(F.col("spelling")).alias("mineral_norm"), "spelling")
    return M.match_names(left, right, "mineral_norm")


def ambiguous_id_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and size as an identifier: those that carry more than one type."""
    part = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("ident"), "p_type")
    return M.ambiguous_ids(part, "ident", "p_type").select("ident", F.array_join("names", ", ").alias("names"), "n_names")


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    tier = F.substring("o_orderpriority", 1, 1).try_cast("int")
    ok = F.col("o_totalprice") >= 250000
    order = [tier, F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderkey")]
    error = F.concat(F.lit("price_too_low: order "), F.col("o_orderkey").cast("string"))
    return M.pick_first(orders, "o_custkey", ok, order, ["o_orderkey", "o_totalprice"], error)


def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of a customer by priority, status and key whose price is high enough, else why not."""
    return _picks(spark, sf_dir).select("o_custkey", "picked.o_orderkey", "picked.o_totalprice", F.regexp_extract("error", "^[a-z_]+", 0).alias("category"), "error")


def merged_and_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer once: account checked first, then an order picked; failures by stage."""
    customers = table(spark, sf_dir, "customer")
    account = customers.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.struct("c_acctbal")).alias("picked"), F.when(F.col("c_acctbal") < 0, "negative_balance").alias("error"))
    orders = _picks(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey")
    out = M.kept_and_failed(customers, "c_custkey", [("account", account), ("orders", orders)])
    return out.select("c_custkey", F.col("failure").isNull().alias("kept"), F.when(F.col("failure").isNull(), F.col("orders.o_orderkey")).alias("o_orderkey"), F.col("failure.stage").alias("stage"), F.regexp_extract("failure.detail", "^[a-z_]+", 0).alias("category"))


def failure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = merged_and_failures(spark, sf_dir).filter("NOT kept")
    return failed.rollup("stage", "category").agg(F.count("*").alias("n"))


def element_set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types bought by customers of a nation in two years, compared as element sets."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).filter("y IN (1997, 1998)")
    pairs = lines.join(orders, "o_orderkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    sets = pairs.groupBy("c_custkey").agg(*(F.array_sort(F.collect_set(F.when(F.col("y") == y, F.col("p_type")))).alias(f"s{y}") for y in (1997, 1998)))
    known = lambda c: F.when(F.size(c) > 0, F.col(c))
    m = X.element_match(known("s1997"), known("s1998"), F.lit(None).cast("array<string>"))
    return sets.select("c_custkey", m["status"].alias("status"), m["source"].alias("source"))


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as structures with error texts of all kinds, none among them: how many fall into each category."""
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, X.STRUCTURE_CATEGORIES)), (k % len(X.STRUCTURE_CATEGORIES)).cast("int"))
    error = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, "something else").otherwise(F.concat(F.lit("part "), k.cast("string"), F.lit(": "), kind))
    return table(spark, sf_dir, "part").select(X.failure_category(error).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


FORMULAS = [("SiO2", {"Si": 1.0, "O": 2.0}), ("CaCO3", {"Ca": 1.0, "C": 1.0, "O": 3.0}), ("CaSO4", {"Ca": 1.0, "S": 1.0, "O": 4.0}), ("PbCrO4", {"Pb": 1.0, "Cr": 1.0, "O": 4.0}),
            ("Ca5P3O13H", {"Ca": 5.0, "P": 3.0, "O": 13.0, "H": 1.0}), ("NaNO3", {"Na": 1.0, "N": 1.0, "O": 3.0}), ("H3BO3", {"H": 3.0, "B": 1.0, "O": 3.0}), ("FeS2", {"Fe": 1.0, "S": 2.0}),
            ("NaCl", {"Na": 1.0, "Cl": 1.0}), ("Fe", {"Fe": 1.0}), ("C", {"C": 1.0}), ("Al2O3", {"Al": 2.0, "O": 3.0}), ("H2O", {"H": 2.0, "O": 1.0}), ("none", {})]
#: What the rules make of the formulas above, worked out by hand.
FAMILIES = dict(zip((f for f, _ in FORMULAS), ("silicate", "carbonate", "sulfate", "chromate", "phosphate_arsenate_vanadate", "nitrate", "borate", "sulfide_selenide_telluride",
                                               "halide", "native_element", "native_element", "oxide_hydroxide", "oxide_hydroxide", "native_element")))


def family_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as minerals: the formula that a part's number chooses, and the family that the rules make of its amounts."""
    known = F.broadcast(spark.createDataFrame([(i, *f) for i, f in enumerate(FORMULAS)], "i int, formula string, amounts map<string,double>"))  # fourteen rows
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(FORMULAS)).cast("int").alias("i"))
    return part.join(known, "i").select("p_partkey", "formula", X.mineral_family(F.col("amounts")).alias("family"))


QUERIES = {f.__name__: f for f in (
    qc_funnel, cohort_median_iqr, family_profile_zscore, ratio_table, wl_bucket, reason_codes, rare_level_pool, one_hot, decile_bins, auto_transforms, usable_columns,
    name_normalise_match, ambiguous_id_reject, priority_pick, merged_and_failures, failure_breakdown, element_set_status, failure_categories, family_rules)}

_PICKS = """
WITH c AS (SELECT *, TRY_CAST(o_orderpriority[1] AS INTEGER) AS tier, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS st, coalesce(o_totalprice >= 250000, FALSE) AS ok FROM orders
), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ok DESC, tier NULLS FIRST, st, o_orderkey) AS n FROM c
), picks AS (SELECT o_custkey, CASE WHEN ok THEN o_orderkey END AS o_orderkey, CASE WHEN ok THEN o_totalprice END AS o_totalprice,
  CASE WHEN NOT ok THEN 'price_too_low' END AS category, CASE WHEN NOT ok THEN 'price_too_low: order ' || o_orderkey END AS error FROM r WHERE n = 1)"""
_MERGED = _PICKS + """, merged AS (SELECT c_custkey, c_acctbal >= 0 AND p.o_orderkey IS NOT NULL AS kept, CASE WHEN c_acctbal >= 0 THEN p.o_orderkey END AS o_orderkey,
  CASE WHEN c_acctbal < 0 THEN 'account' WHEN p.o_orderkey IS NULL THEN 'orders' END AS stage,
  CASE WHEN c_acctbal < 0 THEN 'negative_balance' WHEN p.o_orderkey IS NULL THEN coalesce(p.category, 'none') END AS category
  FROM customer LEFT JOIN picks p ON c_custkey = o_custkey)"""
_QUARTILES = lambda v: ", ".join(f"round(quantile_cont({v}, {p}), 6) AS {n}" for n, p in C.QUARTILES.items())

ORACLES = {
    "qc_funnel": """
WITH o AS (SELECT *, o_orderstatus IN ('F', 'O') AS a, o_totalprice >= 100000 AS b, coalesce(n_lines, 0) >= 3 AS c, o_orderpriority = '1-URGENT' AS d
  FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey))
SELECT 0 AS step_no, 'All samples' AS step, count(*) AS n FROM o UNION ALL SELECT 1, 'Status in {F,O}', count(*) FILTER (WHERE a) FROM o
UNION ALL SELECT 2, 'Price >= 100000', count(*) FILTER (WHERE a AND b) FROM o UNION ALL SELECT 3, 'Lines >= 3', count(*) FILTER (WHERE a AND b AND c) FROM o
UNION ALL SELECT 4, 'Priority = 1-URGENT', count(*) FILTER (WHERE a AND b AND c AND d) FROM o""",
    "cohort_median_iqr": f"""
WITH l AS (SELECT p_type AS family, 'p_size' AS variable, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_type, 'p_retailprice', p_retailprice FROM part
), g AS (SELECT coalesce(family, '<NA>') AS family, variable, v FROM l UNION ALL SELECT 'All', variable, v FROM l)
SELECT family, variable, count(*) AS n, {_QUARTILES("v")} FROM g WHERE v IS NOT NULL GROUP BY 1, 2""",
    "family_profile_zscore": """
WITH s AS (SELECT avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1, avg(l_quantity) AS m2, stddev_samp(l_quantity) AS s2 FROM lineitem
), z AS (SELECT p_type AS family, (l_extendedprice - m1) / s1 AS z1, (l_quantity - m2) / s2 AS z2 FROM lineitem JOIN part ON l_partkey = p_partkey, s)
SELECT family, 'l_extendedprice' AS variable, count(*) AS n, round(quantile_cont(z1, 0.5), 6) AS median_z FROM z GROUP BY family
UNION ALL SELECT family, 'l_quantity', count(*), round(quantile_cont(z2, 0.5), 6) FROM z GROUP BY family""",
    "ratio_table": f"""
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1
), p AS (SELECT o_custkey, count(*) AS orders, coalesce(sum(n), 0) AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1
), e AS (SELECT c_mktsegment AS family, lines::DOUBLE / orders AS eta FROM customer JOIN p ON c_custkey = o_custkey)
SELECT family, count(*) AS n, {_QUARTILES("eta")} FROM e GROUP BY family""",
    "wl_bucket": """
WITH e AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), t AS (SELECT CASE WHEN k < 10 THEN 'no laser' WHEN k < 30 THEN '532 nm' WHEN k < 60 THEN (750 + k) || 'nm' WHEN k < 90 THEN 'laser ' || k END AS t FROM e
), n AS (SELECT TRY_CAST(nullif(regexp_extract(coalesce(t, ''), '([0-9]+)', 1), '') AS INTEGER) AS n FROM t)
SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n = 532 THEN '532 nm' WHEN n BETWEEN 780 AND 785 THEN '780-785 nm' ELSE 'other' END AS wl_group, count(*) AS n FROM n GROUP BY 1""",
    "reason_codes": """
WITH d AS (SELECT length(text) AS chars, lang, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
), u AS (SELECT *, CASE WHEN coalesce(chars, 0) = 0 THEN 'empty_text' WHEN lang <> 'en' THEN 'other_language' ELSE 'not_labelled' END AS r FROM d
), l AS (SELECT 'quality' AS feature, CASE WHEN quality IS NOT NULL THEN 'available' ELSE r END AS status FROM u UNION ALL SELECT 'toxic', CASE WHEN toxic IS NOT NULL THEN 'available' ELSE r END FROM u
  UNION ALL SELECT 'chars', CASE WHEN chars IS NOT NULL THEN 'available' ELSE 'no_text' END FROM u)
SELECT feature, status, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM documents), 6) AS fraction FROM l GROUP BY 1, 2""",
    "rare_level_pool": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT CASE WHEN n >= 60 THEN source ELSE 'small_sources_pooled' END AS pooled, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
    "one_hot": "SELECT c_custkey, " + ", ".join(f"coalesce((lower(c_mktsegment) = '{s}')::INTEGER, 0) AS seg_{s}" for s in ("automobile", "building", "furniture", "household", "machinery")) + " FROM customer",
    "decile_bins": """
WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS edges, min(l_extendedprice) AS low FROM lineitem
), b AS (SELECT len(list_filter(edges, lambda v: v > low AND v < l_extendedprice)) AS bin, l_extendedprice AS x, l_quantity AS y FROM lineitem, e WHERE l_extendedprice IS NOT NULL)
SELECT bin, count(*) AS n, round(median(x), 6) AS x_median, round(quantile_cont(y, .25), 6) AS y_q25, round(median(y), 6) AS y_median, round(quantile_cont(y, .75), 6) AS y_q75 FROM b GROUP BY bin""",
    "auto_transforms": "".join(f"""{' UNION ALL ' if i else ''}
SELECT '{n}' AS variable, CASE WHEN count(v) >= 30 AND min(v) > 0 AND abs(s) > 1 AND abs(t) < abs(s) THEN 'log' ELSE 'none' END AS transform FROM (
  SELECT v, avg((v - m) ** 3) OVER () / nullif(avg((v - m) ** 2) OVER () ** 1.5, 0) AS s, avg((w - k) ** 3) OVER () / nullif(avg((w - k) ** 2) OVER () ** 1.5, 0) AS t
  FROM (SELECT v, w, avg(v) OVER () AS m, avg(w) OVER () AS k FROM (SELECT {e} AS v, CASE WHEN {e} > 0 THEN ln({e}) END AS w FROM lineitem))) GROUP BY s, t""" for i, (n, e) in enumerate((
        ("l_extendedprice", "l_extendedprice"), ("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("squared", "l_extendedprice * l_extendedprice")))),
    "usable_columns": """
SELECT 'l_quantity' AS variable, count(l_quantity) AS n, count(l_quantity) >= 30 AND count(DISTINCT l_quantity) > 1 AS usable FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), count(l_tax) >= 30 AND count(DISTINCT l_tax) > 1 FROM lineitem
UNION ALL SELECT 'constant', count(*), FALSE FROM lineitem UNION ALL SELECT 'absent', count(*) FILTER (WHERE l_linenumber > 99), FALSE FROM lineitem""",
    "name_normalise_match": """
WITH l AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS mineral_norm, count(*) AS n_parts, min(p_partkey) AS first_part FROM part GROUP BY 1
), r AS (SELECT regexp_replace(lower(spelling), '[^a-z0-9]', '', 'g') AS mineral_norm, spelling FROM (VALUES ('Small-Ring'), ('RED  widget'), ('blue_bolt!'), ('Nothing (synthetic)')) t(spelling))
SELECT * FROM l JOIN r USING (mineral_norm)""",
    "ambiguous_id_reject": """
SELECT ident, string_agg(p_type, ', ' ORDER BY p_type) AS names, count(*) AS n_names FROM (SELECT DISTINCT p_brand || '/' || p_size AS ident, p_type FROM part) GROUP BY 1 HAVING count(*) > 1""",
    "priority_pick": _PICKS + "SELECT * FROM picks",
    "merged_and_failures": _MERGED + "SELECT * FROM merged",
    "failure_breakdown": _MERGED + "SELECT stage, category, count(*) AS n FROM merged WHERE NOT kept GROUP BY ROLLUP (stage, category)",
    "element_set_status": """
WITH p AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS y, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE year(o_orderdate) IN (1997, 1998)
), s AS (SELECT c_custkey, list_sort(list_distinct(list(p_type) FILTER (WHERE y = 1997))) AS a, list_sort(list_distinct(list(p_type) FILTER (WHERE y = 1998))) AS b FROM p GROUP BY 1)
SELECT c_custkey, CASE WHEN a IS NULL OR b IS NULL THEN 'unverified' WHEN a = b THEN 'same_element_set' WHEN list_has_any(a, b) THEN 'partial_element_overlap' ELSE 'disjoint_element_sets' END AS status,
  CASE WHEN a IS NULL THEN 'amcsd_formula_unparseable' WHEN b IS NOT NULL THEN 'measured' ELSE 'unavailable' END AS source FROM s""",
    "failure_categories": f"""
WITH c AS (SELECT [{", ".join(f"'{c}'" for c in X.STRUCTURE_CATEGORIES)}] AS known, p_partkey AS k FROM part
), e AS (SELECT known, CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN 'something else' ELSE 'part ' || k || ': ' || known[k % {len(X.STRUCTURE_CATEGORIES)} + 1] END AS error FROM c)
SELECT CASE WHEN error = '' THEN 'no_atoms' ELSE coalesce(list_filter(known, lambda w: contains(error, w))[1], 'other') END AS category, count(*) AS n FROM e GROUP BY 1""",
    "family_rules": "SELECT p_partkey, formula, family FROM part JOIN (VALUES " + ", ".join(f"({i}, '{f}', '{v}')" for i, (f, v) in enumerate(FAMILIES.items())) + f") t(i, formula, family) ON p_partkey % {len(FAMILIES)} = i",
}
