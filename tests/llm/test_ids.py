"""Ids of other types, clashing names, and one row that repeats very often."""

from pyspark.sql import functions as F

from lithoscope.llm import embedding_dedup, packing, simhash


def test_keep_one_with_text_ids_and_clashing_names(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), (None, "one two three four"), (None, "quite another text here"), ("z", None), ("y", ""), ("c", "x"), ("c", "x"), ("10", "five six"), ("9", "five six")]
    docs = spark.createDataFrame([(*r, 1, 2, "s", None) for r in rows], "doc_id string, text string, __k int, __K_ int, fp string, component_id string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or "", r.text or "") for r in got.collect()) == [("", "quite another text here"), ("10", "five six"), ("a", "one two three four"), ("c", "x"), ("y", "")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_embeddings_with_text_ids(spark):
    unit = [1.0, *[0.0] * 7]
    rows = [("b", unit, 3), ("a", unit, 3), ("c", [1.0, 0.1, *[0.0] * 6], 3), ("d", unit, 4), ("e", None, 3), (None, unit, 3), (None, None, 3)]
    df = spark.createDataFrame([(*r, 7, 1) for r in rows], "vec_id string, embedding array<double>, label int, number int, id int")
    got = embedding_dedup.near_duplicates(df)
    assert dict(got.dtypes)["component_id"] == "string"
    assert sorted(map(str, got.collect())) == sorted(map(str, embedding_rows(got, [
        ("a", 3, "a", True), ("b", 3, "a", False), ("c", 3, "a", False), ("d", 0, "d", True), ("e", 0, "e", True), (None, 3, "a", False), (None, 0, None, False)])))


def embedding_rows(df, rows):
    from pyspark.sql import Row

    return [Row(**dict(zip(df.columns, r, strict=True))) for r in rows]


def test_equal_pieces_use_all_lanes(spark):
    """A third of a million equal rows is spread like any others, and packed as tightly as by one lane."""
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).repartition(3)
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 900).alias("text"))
    pieces = packing.pieces_of(docs.unionByName(texts), packing.tokenizer_path()).checkpoint()
    rows = packing.pack_round(pieces, 8, 4096, 2048, 0.995, True, 0).withColumn("lane", F.spark_partition_id()).groupBy("lane").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 1.2 * 100_600 / 8
    packed = packing.best_fit_pack(docs.unionByName(texts), lane_tokens=1 << 16)
    full = packing.full_sequences(packed).first()
    assert full.fullest <= 4096 and full.sequences <= full.tokens / 4096 * 1.15 + 2
