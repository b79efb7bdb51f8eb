"""Matching of records by name, rejection of ambiguous identifiers, picks by priority, kept rows and failures.

All picks are aggregates (``min`` and ``min_by`` over a struct), combined before the shuffle: a key with a third of
all candidates is no hot window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ambiguous_ids(df: DataFrame, ident: str, name: str) -> DataFrame:
    """(ident, names, n_names): identifiers that occur under more than one name, names sorted. NULLs do not count."""
    pairs = df.select(ident, name).filter(F.col(ident).isNotNull() & (F.col(ident) != "") & F.col(name).isNotNull()).distinct()
    return pairs.groupBy(ident).agg(F.array_sort(F.collect_set(name)).alias("names"), F.count("*").alias("n_names")).filter("n_names > 1")


def ambiguous_names(ambiguous: DataFrame, ident: str, name: str) -> DataFrame:
    """(name, detail): each name that owns such an identifier, with its identifiers and their names as sorted text."""
    told = F.concat(F.col(ident), F.lit(": "), F.array_join("names", ", "))
    return ambiguous.select(F.explode("names").alias(name), told.alias("__told")).groupBy(name).agg(F.array_join(F.array_sort(F.collect_set("__told")), "; ").alias("detail"))


def pick_first(df: DataFrame, key: str, ok: Column, order: list[Column], payload: list[str], error: Column) -> DataFrame:
    """One row per key: the payload of the first successful candidate, else the error of the first failed one.

    ``order`` must decide every tie. Columns: key, picked (struct or NULL), error (NULL if picked).
    """
    rank = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    passes = F.coalesce(ok, F.lit(False))
    best = F.min(F.when(passes, F.struct(*rank, F.struct(*payload).alias("v"))))
    first_error = F.min(F.when(~passes, F.struct(*rank, error.alias("v"))))
    out = df.groupBy(key).agg(best.alias("__b"), first_error.alias("__e"))
    return out.select(key, F.col("__b.v").alias("picked"), F.when(F.col("__b").isNull(), F.col("__e.v")).alias("error"))


def kept_and_failed(keys: DataFrame, key: str, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Every key once: its picks per stage, or the first stage that failed with its error.

    A stage is (name, DataFrame of key, picked, error). A key that a stage does not know fails there as ``none``.
    """
    out, failed = keys.select(key).distinct(), []
    for name, df in stages:
        out = out.join(df.select(key, F.col("picked").alias(name), F.col("error").alias(f"__{name}")), key, "left")
        failed.append(F.when(F.col(name).isNull(), F.struct(F.lit(name).alias("stage"), F.coalesce(F.col(f"__{name}"), F.lit("none")).alias("detail"))))
    return out.withColumn("failure", F.coalesce(*failed)).drop(*(f"__{name}" for name, _ in stages))


def match_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Inner join of one row per name each, sides grouped beforehand so that no name multiplies."""
    return left.join(right, name)


def merge_records(df: DataFrame, left: list[str], right: list[str], renames: dict[str, str]) -> DataFrame:
    """Fields of two struct columns side by side under their new names; a clash is an error when the plan is made."""
    names = [renames.get(f"{s}.{f}", f) for s in (*left, *right) for f in df.schema[s].dataType.names]
    clash = {n for n in names if names.count(n) > 1}
    if clash:
        raise ValueError(f"merged records share columns: {sorted(clash)}")
    fields = [F.col(f"{s}.{f}").alias(renames.get(f"{s}.{f}", f)) for s in (*left, *right) for f in df.schema[s].dataType.names]
    return df.select(*(c for c in df.columns if c not in (*left, *right)), *fields)


def ordered(df: DataFrame, head: list[str]) -> DataFrame:
    """Preferred columns first, the rest after them in their order."""
    return df.select(*(c for c in head if c in df.columns), *(c for c in df.columns if c not in head))
