"""Incremental picks: new spectra arrive as files, and the best candidate of each mineral is kept up to date.

There is no event time and so no watermark: the state is one row per mineral. Each micro-batch is reduced to one
candidate per mineral and joined with the last version of the table; a version is a folder named after the batch, so
that a repeated batch writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def best_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by an order that decides every tie."""
    ranked = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*df.columns).alias("row"))
    return df.groupBy(key).agg(F.min(ranked).alias("m")).select("m.row.*")


def keep_best(stream: DataFrame, key: str, order: list[Column], folder: str, checkpoint: str):
    """Starts the query; ``latest`` reads its table. The query's checkpoint and the table are in shared folders."""
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = version(spark, folder, number - 1)
        rows = batch if old is None else batch.unionByName(old)
        best_of(rows, key, order).write.mode("overwrite").parquet(f"{folder}/{number:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    path = f"{folder}/{number:012d}"
    return spark.read.parquet(path) if number >= 0 and _exists(spark, path) else None
