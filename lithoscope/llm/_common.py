"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the operator contracts, as the separator that lies between words.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is set, a local session gets a temporary one; on a cluster that is an error, as executors could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lithoscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a short lineage that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: for tables that ``cut`` would store at full width."""
    where = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; pure ASCII texts take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all learnable rows: repeated or conflicting labels of one document collapse to their largest value, null labels go."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )


def bounded_labels(labels: DataFrame, label: str, max_zero: int, max_one: int) -> DataFrame:
    """At most ``max_zero`` and ``max_one`` of the ``learnable_labels`` of either class, the first by a hash of the id."""
    known = learnable_labels(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return (known.filter("y = 0").orderBy(*order).limit(max_zero)).unionByName(
        known.filter("y = 1").orderBy(*order).limit(max_one))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_zero: int, max_one: int) -> DataFrame:
    """(doc_id, text, y): one row of ``docs`` for each of the ``bounded_labels``, of repeated ids the one whose text has the
    smallest digest; so the bound holds after the join too. Ids may be of any type that labels' ids compare with."""
    known = bounded_labels(labels, label, max_zero, max_one)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), digest).alias("r")).select("doc_id", "r.text", "r.y")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ordered_numbers(ids: DataFrame) -> DataFrame:
    """(id, number) of the distinct non-null ids of a one-column frame ``id``: longs in the order of the ids, with gaps.

    Rows are dealt by ranges of ids and numbered within the partitions, so that no task sees all of them.
    """
    placed = cut(ids.na.drop().distinct()).repartitionByRange("id").sortWithinPartitions("id")
    return cut(placed.withColumn("number", F.monotonically_increasing_id()))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as (node, root), root the smallest node reached.

    Alternating large-star and small-star rounds on DataFrames. A node's edges are only ever reduced with
    ``min`` (combined before the shuffle) and joined with one row per node, which adaptive execution splits
    when a node is hot. Each round is written to the shared folder, so lineage stays one round long.
    Self-loops are allowed and name nodes without other links.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(
            large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
                F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
