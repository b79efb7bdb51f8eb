"""The corpus pipeline: quality classifier, toxicity, SimHash near-duplicates, best-fit packing.

Each stage gets all that its predecessor kept, as rows read back from Parquet, and its decisions take effect: the
first three return the columns of ``documents`` for the rows that stay, the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lithoscope.llm._common import shared_dir
from lithoscope.llm.packing import best_fit_pack
from lithoscope.llm.quality_classifier import keep_good
from lithoscope.llm.simhash import keep_one
from lithoscope.llm.toxicity import keep_clean
from lithoscope.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier accepts."""
    return keep_good(docs, _labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon classifier does not call toxic."""
    return keep_clean(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    ship(spark)
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences."""
    ship(spark)
    return best_fit_pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Learnt models, 64-bit hashes and a tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
