"""Result tables: kept rows and rejects from one frame, wide matrices, Markdown of small tables, a run manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_kept_and_failed(df: DataFrame, folder: str, key: str, failure: str = "failure") -> None:
    """``<folder>/kept`` and ``<folder>/failed`` in one write, split by partition, so that the plan runs once."""
    kept = df.withColumn("__part", F.when(F.col(failure).isNull(), "kept").otherwise("failed"))
    kept.write.partitionBy("__part").mode("errorifexists").parquet(folder)


def read_part(spark, folder: str, part: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("__part") == part).drop("__part")


def wide(df: DataFrame, rows: str, columns: str, value: str, order: list[str]) -> DataFrame:
    """A matrix with the columns in a given order; cells that are not there are NULL."""
    return df.groupBy(rows).pivot(columns, order).agg(F.first(value))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown: missing is empty, doubles have two decimals. Larger results are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *(map(cell, r) for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def write_manifest(spark, folder: str, settings: dict, counts: dict[str, int]) -> None:
    """Settings, versions and row counts of a run as one JSON row, in any store."""
    record = {"settings": settings, "spark": spark.version, "rows": counts}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(folder)
