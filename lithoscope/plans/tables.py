"""The provided tables, and the spectra that stand in for measurement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectra import sorted_points


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, points): each embedding as a spectrum whose 64 values lie evenly over the analysed range."""
    y = F.transform("embedding", lambda v: v.cast("double"))
    x = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.lit(100.0) + F.lit(1200.0) * i / 63)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", sorted_points(x, y).alias("points"))


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles (all, or the named ones) rounded; -0.0 becomes 0.0."""
    names = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})
