"""Structure queries: each embedding stands in for a small crystal of eight atoms."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import ELEMENTS, element_of_label, parse_formula
from ..operators import structure as S
from ..session import spread
from ..sources.cells import with_structure
from .tables import rounded, table

#: symbol, electronegativity, mass, radius of the stand-in's elements, and the symbols of its eight atoms.
ELEMENT_DATA = [("Si", 1.9, 28.085, 1.11), ("O", 3.44, 15.999, 0.66), ("Mg", 1.31, 24.305, 1.41), ("Al", 1.61, 26.982, 1.21)]
ATOMS = ("Si", "O", "O", "Mg", "O", "Al", "O", "O")


def _crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, sites): atom i sits at ten times the values 3i, 3i+1, 3i+2."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    site = lambda i: F.struct(F.lit(i).alias("i"), F.array(*(F.try_element_at("embedding", F.lit(3 * i + k + 1)).cast("double") * 10 for k in range(3))).alias("xyz"))
    return rows.select("vec_id", F.array(*(site(i) for i in range(8))).alias("sites"))


def _sites(spark: SparkSession, crystals: DataFrame) -> DataFrame:
    symbols = F.array(*map(F.lit, ATOMS))
    long = crystals.select("vec_id", F.explode("sites").alias("s")).select("vec_id", F.col("s.i").alias("i"), F.try_element_at(symbols, F.col("s.i") + 1).alias("symbol"))
    return S.with_element_data(long, spark.createDataFrame(ELEMENT_DATA, "symbol string, chi double, mass double, radius double"))


def bond_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    crystals = _crystals(spark, sf_dir)
    stats = S.bond_statistics(S.neighbours(crystals, "vec_id", 6.0), _sites(spark, crystals), "vec_id")
    return rounded(stats.select("vec_id", "n_bonds", "bonds_per_atom", "mean_bond", "cv_bond", "bond_distortion", "mean_cn", "cn_std", "mean_delta_chi_bond", "mean_reduced_mass", "n_anion_group_types", "anion_group_o_fraction"))


def composition_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted spread of brand-like shares: parts of a type, their price as chi, their size as mass."""
    parts = table(spark, sf_dir, "part").select("p_type", F.col("p_retailprice").alias("chi"), F.col("p_size").cast("double").alias("mass"), F.lit(1.0).alias("weight"))
    return rounded(S.composition_spread(parts, "p_type"))


def env_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments of eight atoms with eight values each; even atoms are one element, odd ones another."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    vectors = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda a: F.transform(F.slice("embedding", a * 8 + 1, F.lit(8)), lambda v: v.cast("double")))
    symbols = F.array(*(F.lit("AB"[i % 2]) for i in range(8)))
    return rounded(S.environment_statistics(rows.select("vec_id", vectors.alias("vectors"), symbols.alias("symbols"))).drop("vectors", "symbols"), 5)


def _groups() -> dict[str, list]:
    """Point groups as signed permutation matrices."""
    signed = [[[s[i] if p[i] == j else 0 for j in range(3)] for i in range(3)] for p in itertools.permutations(range(3)) for s in itertools.product((1, -1), repeat=3)]
    unit, minus = [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[-1, 0, 0], [0, -1, 0], [0, 0, -1]]
    return {"1": [unit], "-1": [unit, minus], "2": [unit, [[-1, 0, 0], [0, 1, 0], [0, 0, -1]]], "4mm": [m for m in signed if m[2] == [0, 0, 1]], "m-3m": signed}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a primitive cell: its number chooses the point group, its size how many atoms sit where every operation
    leaves them."""
    groups = [(i, name, ops) for i, (name, ops) in enumerate(_groups().items())]
    known = F.broadcast(spark.createDataFrame(groups, "g int, point_group string, rotations array<array<array<int>>>"))  # five rows
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(groups)).cast("int").alias("g"), (F.col("p_size") % 7 + 1).cast("int").alias("atoms"))
    cells = spread(part, "p_partkey").join(known, "g").withColumn("fixed", F.array_repeat("atoms", F.size("rotations")))
    return cells.select("p_partkey", "point_group", "atoms", S.mode_counts("rotations", "fixed").alias("m"))


def group_theory_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of vibrations of every part's cell."""
    return rounded(_cells(spark, sf_dir).select("p_partkey", "point_group", "atoms", "m.*"))


def mode_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios derived from the counts of vibrations."""
    return rounded(_cells(spark, sf_dir).select("p_partkey", "point_group", *S.derived_ratios(F.col("m"))))


def label_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made of parts' names: a symbol with a number, in capitals, in quotes, or the words for water and deuterium."""
    k, a = F.col("p_partkey"), F.initcap(F.substring("p_name", 1, 2))
    label = F.when(k % 4 == 0, F.concat(a, F.col("p_size").cast("string"))).when(k % 4 == 1, F.concat(F.upper(a), F.col("p_size").cast("string"))).when(k % 4 == 2, F.concat(F.lit("'"), a, F.lit("'")))
    label = label.when(k % 8 == 3, F.concat(F.lit("wAt"), k.cast("string"))).otherwise("d")
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("element", element_of_label(F.col("label")))


def structure_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as structure texts of two symmetries, some damaged: cell, sites and status that are read from them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lines = [
        F.lit("data_part\n_cell_length_a "), (size + 3).cast("string"), F.lit("(2)\n_cell_length_b 4.5\n_cell_length_c '8'\n_cell_angle_alpha 90\n_cell_angle_beta 90.0(1)\n_cell_angle_gamma "), F.when(k % 9 == 0, "?").otherwise("90"),
        F.lit("\n_publ_text\n;\nloop_ 'not' a loop\n;\nloop_\n_symmetry_equiv_pos_as_xyz\n'x,y,z'\n"), F.when(k % 2 == 0, "'-x, -y, -z'\n").otherwise("# no other\n"),
        F.lit("loop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n_atom_site_occupancy\nSi1 0 0 0 1\nO1 0.5 .5 0.5(1) .\nO2 0."), (k % 8 + 1).cast("string"), F.lit("1 0.2 0.3 0.75\n"), F.when(k % 7 == 0, "Fe1 ? 0 0 1").otherwise("")]
    df = with_structure(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.concat(*lines).alias("text")))
    s = F.col("structure")
    occupied = F.aggregate(s["sites"], F.lit(0.0), lambda a, x: a + x["occupancy"])
    return rounded(df.select("p_partkey", s["volume"].alias("volume"), s["n_operations"].alias("n_operations"), F.size(s["sites"]).alias("n_sites"), occupied.alias("occupied"), s["status"].alias("status")))


SYMBOLS = ("Si", "Fe", "Ca", "Mg", "Na", "Al")


def formula_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of five spellings made of parts' numbers (hydrates, subscripts, charges, comments, an open bracket)."""
    k = F.col("p_partkey")
    x, a, b = F.get(F.array(*map(F.lit, SYMBOLS)), (k % len(SYMBOLS)).cast("int")), (F.col("p_size") % 4 + 1).cast("string"), (k % 3 + 1).cast("string")
    forms = [F.concat(x, a, F.lit("O"), b), F.concat(x, F.lit("(OH)"), a, F.lit("\u00b7"), b, F.lit("H_2_O")), F.concat(x, F.lit("_"), a, F.lit("_O_"), b, F.lit("_; as told")),
             F.concat(x, F.lit("^2+^S"), a), F.concat(x, a, F.lit("(O"))]
    formula = forms[4]
    for i in range(4):
        formula = F.when(k % 5 == i, forms[i]).otherwise(formula)
    df = table(spark, sf_dir, "part").select("p_partkey", formula.alias("formula")).withColumn("m", parse_formula("formula"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    return df.select("p_partkey", "formula", F.when(F.col("m").isNotNull(), told).alias("amounts"))


QUERIES = {f.__name__: f for f in (structure_cells, bond_stats, composition_spread, env_stats, group_theory_modes, mode_ratios, label_elements, formula_amounts)}

#: Per atom less one, worked out by hand from the character tables: distinct modes, freedom of each, seen by Raman, by infrared.
_MODES = """
WITH t(g, point_group, d, f, r, i) AS (VALUES (0, '1', 3, 1, TRUE, TRUE), (1, '-1', 3, 1, FALSE, TRUE), (2, '2', 3, 1, TRUE, TRUE), (3, '4mm', 2, 1, TRUE, TRUE), (4, 'm-3m', 1, 3, FALSE, TRUE)
), c AS (SELECT p_partkey, point_group, (p_size % 7 + 1)::INTEGER AS atoms, (p_size % 7)::INTEGER AS n, d, f, r, g FROM part JOIN t ON p_partkey % 5 = g
), m AS (SELECT *, 3 * n AS n_vib_dof, d * n AS n_vib_distinct, CASE WHEN r THEN d * n ELSE 0 END AS n_raman, d * n AS n_ir, CASE WHEN r THEN d * n ELSE 0 END AS n_overlap, 0 AS n_silent, CASE WHEN r THEN 3 * n ELSE 0 END AS n_raman_dof, 3 * n AS n_ir_dof,
    CASE WHEN r AND n > 0 THEN CASE point_group WHEN '1' THEN 1 ELSE 2 END ELSE 0 END AS n_raman_irreps, CASE WHEN r THEN CASE point_group WHEN '1' THEN 3 * n WHEN '2' THEN 2 * n ELSE n END ELSE 0 END AS max_raman_mult,
    CASE WHEN n > 0 AND point_group = '2' THEN round(-(ln(1 / 3.0::DOUBLE) / 3 + 2 * ln(2 / 3.0::DOUBLE) / 3), 6) WHEN n > 0 AND point_group = '4mm' THEN round(ln(2.0::DOUBLE), 6) ELSE 0 END AS raman_entropy, g IN (1, 4) AS centrosymmetric, '' AS error FROM c)"""
ORACLES = {
    "env_stats": f"""
WITH a AS (SELECT vec_id, i, i % 2 AS el, list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda v: v::DOUBLE) AS v FROM embeddings, range(8) t(i) WHERE embedding IS NOT NULL
), l AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM a
), u AS (SELECT vec_id, i, el, CASE WHEN n > 1e-12 THEN list_transform(v, lambda x: x / n) ELSE v END AS v FROM l
), c AS (SELECT vec_id, el, [{", ".join(f"avg(v[{k}])" for k in range(1, 9))}] AS m FROM u GROUP BY 1, 2
), s AS (SELECT vec_id, sum(list_sum(list_transform(list_zip(u.v, c.m), lambda p: (p[1] - p[2]) ** 2))) / count(*) AS dispersion FROM u JOIN c USING (vec_id, el) GROUP BY 1
), d AS (SELECT p.vec_id, p.i, q.i AS j, sqrt(list_sum(list_transform(list_zip(p.v, q.v), lambda t: (t[1] - t[2]) ** 2))) AS d FROM u p JOIN u q ON p.vec_id = q.vec_id AND p.el = q.el AND p.i < q.i
), r AS (SELECT vec_id, i, el FROM u WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.vec_id = u.vec_id AND d.j = u.i AND d.d <= {S.SAME_ENVIRONMENT})
), e AS (SELECT d.vec_id, d.d FROM d JOIN r x ON x.vec_id = d.vec_id AND x.i = d.i JOIN r y ON y.vec_id = d.vec_id AND y.i = d.j
), g AS (SELECT vec_id, min(d) AS lo, avg(d) AS m, quantile_cont(d, [0.5, 0.9, 0.95]) AS q, max(d) AS hi FROM e GROUP BY 1
), k AS (SELECT vec_id, el, count(*) AS k FROM r GROUP BY 1, 2
), h AS (SELECT vec_id, sum(k)::BIGINT AS n_env, -sum(k / t * ln(k / t)) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY vec_id)::DOUBLE AS t FROM k) GROUP BY 1)
SELECT s.vec_id, round(dispersion, 5) AS intra_species_dispersion, n_env, round(lo, 5) AS min_env_sep, round(m, 5) AS pairwise_env_sep_mean, round(q[1], 5) AS pairwise_env_sep_median, round(q[2], 5) AS pairwise_env_sep_q90,
  round(q[3], 5) AS pairwise_env_sep_q95, round(hi, 5) AS pairwise_env_sep_max, round(entropy, 5) + 0 AS env_count_entropy FROM s JOIN h USING (vec_id) LEFT JOIN g USING (vec_id)""",
    "structure_cells": """
WITH p AS (SELECT p_partkey, p_size, p_partkey % 9 = 0 AS lost, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM part)
SELECT p_partkey, CASE WHEN NOT lost THEN (p_size + 3) * 36::DOUBLE END AS volume, CASE WHEN NOT lost THEN n END AS n_operations, CASE WHEN NOT lost THEN 2 + n END AS n_sites, CASE WHEN NOT lost THEN 2 + 0.75::DOUBLE * n END AS occupied,
  CASE WHEN lost THEN 'no cell' WHEN p_partkey % 7 = 0 THEN 'site Fe1' ELSE 'ok' END AS status FROM p""",
    "bond_stats": f"""
WITH el(symbol, chi, mass, radius) AS (VALUES {", ".join(f"('{s}', {c}::DOUBLE, {m}::DOUBLE, {r}::DOUBLE)" for s, c, m, r in ELEMENT_DATA)}
), a AS (SELECT vec_id, i, ([{", ".join(f"'{s}'" for s in ATOMS)}])[i + 1] AS symbol, embedding[3 * i + 1]::DOUBLE * 10 AS x, embedding[3 * i + 2]::DOUBLE * 10 AS y, embedding[3 * i + 3]::DOUBLE * 10 AS z
  FROM embeddings, range(8) t(i) WHERE embedding IS NOT NULL
), s AS (SELECT * FROM a JOIN el USING (symbol)
), e AS (SELECT p.vec_id, p.i, q.i AS j, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS d, p.symbol, q.symbol AS other, abs(q.chi - p.chi) AS dchi, p.mass * q.mass / (p.mass + q.mass) AS mu,
  p.radius + q.radius AS r, q.chi AS qc, p.chi AS pc FROM s p JOIN s q ON p.vec_id = q.vec_id AND p.i <> q.i
), b AS (SELECT *, coalesce(d >= 1.3 * lag(d) OVER (PARTITION BY vec_id, i ORDER BY d, j), FALSE) AS gap FROM e WHERE d <= 6 AND d > 1e-8 AND d <= 1.3 * r AND qc >= 3.44 - 0.5 - 1e-9 AND qc > pc + 1e-9
), k AS (SELECT * FROM b QUALIFY count(*) FILTER (WHERE gap) OVER (PARTITION BY vec_id, i ORDER BY d, j) = 0
), p AS (SELECT vec_id, i, any_value(symbol) AS symbol, count(*) AS cn, avg(d) AS m, stddev_pop(d) AS sd, sum(d) AS sd_sum, bool_and(other = 'O') AS all_o, list(d) AS ds, list(j) AS js, sum(dchi) AS dchi, sum(mu) AS mu FROM k GROUP BY 1, 2
), f AS (SELECT *, cn >= 2 AS ok, symbol = 'Si' AND cn IN (3, 4) AND all_o AS former, list_sum(list_transform(ds, lambda v: abs(v - m))) / (m * cn) AS bend FROM p
), o AS (SELECT vec_id, count(DISTINCT j) AS go FROM (SELECT vec_id, unnest(js) AS j FROM f WHERE former) GROUP BY 1
), g AS (SELECT vec_id, coalesce(sum(cn) FILTER (WHERE ok), 0)::BIGINT AS n, sum(sd_sum) FILTER (WHERE ok) AS sm, avg(sd / m) FILTER (WHERE ok) AS cv, avg(bend) FILTER (WHERE ok) AS bd, avg(cn) FILTER (WHERE ok) AS mc, stddev_pop(cn) FILTER (WHERE ok) AS cs,
  sum(dchi) FILTER (WHERE ok) AS dc, sum(mu) FILTER (WHERE ok) AS mu, count(DISTINCT symbol || cn) FILTER (WHERE former) AS gt FROM f GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_bonds, round(coalesce(n, 0) / 8, 6) AS bonds_per_atom, round(sm / nullif(n, 0), 6) AS mean_bond, round(cv, 6) AS cv_bond, round(bd, 6) AS bond_distortion, round(mc, 6) AS mean_cn, round(cs, 6) AS cn_std,
  round(dc / nullif(n, 0), 6) AS mean_delta_chi_bond, round(mu / nullif(n, 0), 6) AS mean_reduced_mass, coalesce(gt, 0) AS n_anion_group_types, round(coalesce(go, 0) / 5, 6) AS anion_group_o_fraction
FROM (SELECT DISTINCT vec_id FROM s) LEFT JOIN g USING (vec_id) LEFT JOIN o USING (vec_id)""",
    "composition_spread": """
SELECT p_type, round(sqrt(avg(p_retailprice * p_retailprice) - avg(p_retailprice) ** 2), 6) AS sigma_chi, round(ln(max(p_size)::DOUBLE / min(p_size)), 6) AS mass_contrast FROM part GROUP BY p_type""",
    "group_theory_modes": _MODES + "SELECT * EXCLUDE (n, d, f, r, g) FROM m",
    "mode_ratios": _MODES + """SELECT p_partkey, point_group, round(n_raman / nullif(n_vib_distinct, 0)::DOUBLE, 6) AS raman_mode_fraction, round(1 - n_vib_distinct / nullif(n_vib_dof, 0)::DOUBLE, 6) AS degeneracy_fraction, 'ok' AS status FROM m""",
    "label_elements": f"""
WITH p AS (SELECT p_partkey, p_size, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2, 1)) AS a, [{", ".join(f"'{e}'" for e in ELEMENTS)}] AS known FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN a || p_size WHEN p_partkey % 4 = 1 THEN upper(a) || p_size WHEN p_partkey % 4 = 2 THEN chr(39) || a || chr(39) WHEN p_partkey % 8 = 3 THEN 'wAt' || p_partkey ELSE 'd' END AS label,
  CASE WHEN p_partkey % 8 = 3 THEN 'O' WHEN p_partkey % 8 = 7 THEN 'H' WHEN p_partkey % 4 <> 1 AND list_contains(known, a) THEN a WHEN list_contains(known, a[1]) THEN a[1] END AS element FROM p""",
    "formula_amounts": f"""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, ([{", ".join(f"'{e}'" for e in SYMBOLS)}])[p_partkey % {len(SYMBOLS)} + 1] AS x, (p_size % 4 + 1)::INTEGER AS a, (p_partkey % 3 + 1)::INTEGER AS b FROM part
), l AS (SELECT *, CASE f WHEN 0 THEN [(x, a), ('O', b)] WHEN 1 THEN [(x, 1), ('O', a + b), ('H', a + 2 * b)] WHEN 2 THEN [(x, a), ('O', b)] WHEN 3 THEN [(x, 1), ('S', a)] END AS e FROM p)
SELECT p_partkey, CASE f WHEN 0 THEN x || a || 'O' || b WHEN 1 THEN x || '(OH)' || a || chr(183) || b || 'H_2_O' WHEN 2 THEN x || '_' || a || '_O_' || b || '_; as told' WHEN 3 THEN x || '^2+^S' || a ELSE x || a || '(O' END AS formula,
  array_to_string(list_sort(list_transform(e, lambda t: t[1] || ':' || t[2]::DOUBLE::VARCHAR)), ';') AS amounts FROM l""",
}
