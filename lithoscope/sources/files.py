"""Measurement and structure files as DataFrames.

One ``binaryFile`` scan per kind, any store that Spark reads; paths become columns and texts are parsed by built-in
functions. A file is bounded, so its lines and points stay one array in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..functions.chemistry import element_of_label
from ..functions.scalars import clean_float, let, normalise_name, parse_bool

#: Quality and orientation of spectra, the best first.
TIERS = [
    ("excellent", "unoriented"),
    ("excellent", "oriented"),
    ("fair", "unoriented"),
    ("fair", "oriented"),
    ("unrated", "unoriented"),
    ("unrated", "oriented"),
    ("poor", "unoriented"),
    ("poor", "oriented"),
]
#: Fixed value: words of a structure file that tell high pressure or temperature.
HIGH_PRESSURE = r"(?i)\bgpa\b|\bkbar\b|high[ -]pressure|high[ -]temperature"
_NUMBERS = r"^\s*([-\d.Ee+]+)\s*,\s*([-\d.Ee+]+)\s*$"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.url_decode(F.regexp_extract("path", "([^/]+)$", 1))
    return files.select("path", name.alias("file"), F.decode("content", "ISO-8859-1").alias("content"))


def name_parts(file: Column) -> Column:
    """(mineral, ident, wavelength) of a file name whose stem is split by double underscores; absent parts are empty."""
    parts = F.split(F.regexp_replace(file, r"\.[^.]*$", ""), "__")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(part(1).alias("mineral"), F.upper(F.trim(part(2))).alias("ident"), part(4).alias("wavelength"))


def structure_name(file: Column) -> Column:
    """The mineral of a structure file: its stem up to the last double underscore."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return F.when(stem.contains("__"), F.regexp_extract(stem, "^(.*)__", 1)).otherwise(stem)


def tier_rank(tier: Column) -> Column:
    """Place of a ``<quality>_<orientation>`` name among the tiers, 0 the best; NULL if unknown."""
    return F.try_element_at(F.create_map(*(x for i, (q, o) in enumerate(TIERS) for x in (F.lit(f"{q}_{o}"), F.lit(i)))), tier)


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r\n|\r|\n")


def header(lines: Column) -> Column:
    """Map of the ``##KEY=VALUE`` lines before the first other line that is not blank; keys in capitals, the last of a key wins."""
    def parsed(all_lines: Column) -> Column:
        body = F.array_position(F.transform(all_lines, lambda v: (~v.startswith("##") & (F.trim(v) != "")).cast("int")), 1)
        head = F.filter(F.when(body > 0, F.slice(all_lines, 1, body.cast("int") - 1)).otherwise(all_lines), lambda v: v.startswith("##") & v.contains("="))
        pairs = F.transform(head, lambda v: F.struct(F.upper(F.trim(F.regexp_extract(v, "^##([^=]*)=", 1))).alias("k"), F.trim(F.regexp_extract(v, "^##[^=]*=(.*)$", 1)).alias("v")))
        put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"])))
        return F.aggregate(pairs, F.create_map().cast("map<string,string>"), put)

    return let(lines, parsed)


def body_points(lines: Column) -> Column:
    """Array of (x, y) of the ``number , number`` lines; anything else is skipped."""
    number = lambda v, i: F.regexp_extract(v, _NUMBERS, i).try_cast("double")
    kept = F.filter(lines, lambda v: ~F.trim(v).startswith("##") & v.rlike(_NUMBERS))
    points = F.transform(kept, lambda v: F.struct(clean_float(number(v, 1)).alias("x"), clean_float(number(v, 2)).alias("y")))
    return F.array_sort(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def read_spectra(spark: SparkSession, root: str) -> DataFrame:
    """One row per processed spectrum under ``<quality>_<orientation>`` folders: names, tier, chemistry, points, sorted by x.

    Files of no bytes give no row, as Spark does not read them.
    """
    files = _files(spark, root, "*.{txt,TXT,Txt}").filter(F.col("file").contains("Raman_Data_Processed"))
    tier = F.regexp_extract("path", "/([a-z]+_[a-z]+)/[^/]+$", 1)
    df = files.withColumns({"tier": tier, "tier_rank": tier_rank(tier), "lines": lines_of(F.col("content")), "n": name_parts(F.col("file"))}).filter("tier_rank IS NOT NULL")
    meta = header(F.col("lines"))
    return df.select(
        "path", "file", "n.*", normalise_name(F.col("n.mineral")).alias("mineral_norm"), F.substring_index("tier", "_", 1).alias("quality"), F.substring_index("tier", "_", -1).alias("orientation"), "tier_rank",
        body_points(F.col("lines")).alias("points"), meta.alias("meta")).withColumns({
            f"{c}_chemistry": F.coalesce(F.try_element_at("meta", F.lit(f"{c.upper()} CHEMISTRY")), F.lit("")) for c in ("ideal", "measured")}).drop("meta")


def spectrum_order() -> list[Column]:
    """Which spectrum of a mineral goes first: the better tier, 532 nm, then the name."""
    return [F.col("tier_rank"), F.when(F.col("file").contains("__532__"), 0).otherwise(1), F.col("file")]


def read_structures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per structure file: name, record number, high pressure or temperature flag, repaired text, unknown labels."""
    files = _files(spark, folder, "*.cif")
    fixed = repair(lines_of(F.col("content")))
    return files.select(
        "path", "file", structure_name(F.col("file")).alias("mineral"), normalise_name(structure_name(F.col("file"))).alias("mineral_norm"),
        F.coalesce(F.regexp_extract("file", r"(?i)__(\d+)\.cif$", 1).try_cast("int"), F.lit(10**9)).alias("record"), F.col("content").rlike(HIGH_PRESSURE).alias("is_high_pt"),
        fixed["text"].alias("repaired"), fixed["n_unknown"].alias("n_unknown_labels"))


def structure_order() -> list[Column]:
    """Which structure of a mineral goes first: ambient conditions, the lower record number, then the name."""
    return [F.col("is_high_pt").cast("int"), F.col("record"), F.col("file")]


def repair(lines: Column) -> Column:
    """(text, n_unknown): old tag renamed, END lines dropped, atom labels replaced by elements (X if unknown).

    The loop over lines is one fold; its state says whether a line stands in the atom loop.
    """
    def step(a: Column, raw: Column) -> Column:
        line = F.trim(raw)
        low = F.lower(line)
        fields = F.split(line, r"\s+")
        atom = a["inside"] & (line != "") & ~line.startswith("_") & ~line.startswith("#") & (low != "loop_") & (low != "_atom_site_label") & (F.size(fields) >= 4)
        element = element_of_label(fields[0])
        text = (
            F.when(low == "_space_group_symop_operation_xyz", F.replace(raw, F.lit("_space_group_symop_operation_xyz"), F.lit("_symmetry_equiv_pos_as_xyz")))
            .when(atom, F.concat(F.regexp_extract(raw, r"^(\s*)", 1), F.array_join(F.concat(F.array(F.coalesce(element, F.lit("X"))), F.slice(fields, F.lit(2), F.size(fields))), " "))).otherwise(raw))
        return F.struct(
            F.when(low == "_atom_site_label", True).when(low == "loop_", False).otherwise(a["inside"]).alias("inside"),
            (a["n"] + F.when(atom & element.isNull(), 1).otherwise(0)).alias("n"),
            F.when(F.upper(line) == "END", a["out"]).otherwise(F.concat(a["out"], F.array(text))).alias("out"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(lines, start, step, lambda a: F.struct(F.concat(F.array_join(a["out"], "\n"), F.lit("\n")).alias("text"), a["n"].alias("n_unknown")))


def read_table(spark: SparkSession, path: str, schema: StructType, required: list[str], masked: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    """A CSV result table under a declared schema: infinities and NaN are NULL, flags parsed, ``masked`` columns NULL unless ``mask``.

    A required column that the schema lacks is an error when the plan is made.
    """
    lacking = [c for c in required if c not in schema.names]
    if lacking:
        raise ValueError(f"the table lacks {lacking}")
    flags = [f.name for f in schema if isinstance(f.dataType, BooleanType)]
    raw = StructType([StructField(f.name, StringType()) if f.name in flags else f for f in schema])
    df = spark.read.csv(path, header=True, schema=raw, mode="PERMISSIVE")
    df = df.withColumns({f.name: clean_float(F.col(f.name)) for f in schema if isinstance(f.dataType, DoubleType)} | {c: parse_bool(F.col(c)) for c in flags})
    return df.withColumns({c: F.when(mask, F.col(c)) for c in masked or []}) if mask is not None else df
