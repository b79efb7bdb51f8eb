"""Target-distribution importance resampling with a position table of hashed n-grams.

1. Every document's words are exploded with their places; ``lead`` over the document concatenates the words that follow,
   one column for each order of n-gram, and a feature's bucket is a hash of it. The texts are dealt by row first, so that
   the window needs no shuffle of words. The table (row, one bucket a column and order) is written once, narrow.
2. Counts of each bucket over the raw and the target table give its gain, the log ratio of the two smoothed shares; there
   are at most ``buckets`` gains, so they are broadcast.
3. The table joins the gains once for each order; a document's weight is the floored mean over its features.
4. Gumbel noise seeded by the document's id makes a draw without replacement of the highest scores. Ranks come from a
   range partitioning by score whose partitions are numbered by offsets, one row a partition; no task sees all scores.

A document is a row, numbered where it is read; its words meet in one task, as a row does anyway, and rows are spread
evenly whatever their ids are.

Defined results: a null or empty text has no words, no features and weight 0, and is never drawn as it has too few words;
a null id hashes as the empty text and comes last among equal scores; repeated rows are separate documents with equal
scores, ranked in any order; only the named columns are read; an empty raw table gives an empty table, an empty target
table leaves only the raw shares in the gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, written

#: Words before A-Z are lower-cased, which changes no word's ends.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS, ORDERS = 10_000, 2


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def position_table(docs: DataFrame, id_col: str | None, text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, b1, b2, ...): a row for each word, b_n the bucket of the n-gram that begins there (null past the end).

    Documents without words have one row without buckets. Written to the shared folder and read again.
    """
    given = F.col(id_col) if id_col else F.lit(None).cast("long")
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), given.alias("id"), F.col(text_col).alias("text")).repartition("row")
    words = dealt.select("row", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("place", "word")).withColumn("word", ascii_lower(F.col("word")))
    following = Window.partitionBy("row").orderBy("place")
    grams = {f"g{n}": F.concat_ws(" ", "word", *(F.lead("word", k).over(following) for k in range(1, n))) for n in range(2, orders + 1)}
    ends = {f"e{n}": F.lead("word", n - 1).over(following).isNotNull() for n in range(2, orders + 1)}
    placed = words.select("row", "id", "word", *(c.alias(name) for name, c in (grams | ends).items()))
    columns = [bucket(F.col("word"), buckets).alias("b1"), *(F.when(F.col(f"e{n}"), bucket(F.col(f"g{n}"), buckets)).alias(f"b{n}") for n in range(2, orders + 1))]
    return written(placed.select("row", "id", *columns), "positions")


def bucket_counts(table: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, name): features of all orders in each bucket."""
    each = None
    for n in range(1, orders + 1):
        one = table.filter(f"b{n} IS NOT NULL").groupBy(F.col(f"b{n}").alias("bucket")).agg(F.count("*").alias(name))
        each = one if each is None else each.unionByName(one)
    return each.groupBy("bucket").agg(F.sum(name).alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> DataFrame:
    """(bucket, gain) of every bucket that the raw table has: the floored, scaled log ratio of target to raw share."""
    totals = raw.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    both = raw.join(target, "bucket", "left").na.fill(0, ["t"]).crossJoin(F.broadcast(totals))
    x = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (x["t"] + 1) * (x["all_s"] + buckets) / ((x["s"] + 1) * (x["all_t"] + buckets))
    return both.select("bucket", F.floor(scale * F.log(ratio)).cast("long").alias("gain"))


def document_weights(table: DataFrame, gain: DataFrame, orders: int) -> DataFrame:
    """(row, id, n_words, n_features, weight): the floored mean of the gains over all features of a document."""
    joined = table
    for n in range(1, orders + 1):
        joined = joined.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    found = sum((F.when(F.col(f"b{n}").isNotNull(), 1).otherwise(0) for n in range(1, orders + 1)), F.lit(0))
    gained = sum((F.coalesce(f"g{n}", F.lit(0).cast("long")) for n in range(1, orders + 1)), F.lit(0).cast("long"))
    per_doc = joined.groupBy("row").agg(F.first("id").alias("id"), F.count("b1").alias("n_words"), F.sum(found).alias("n_features"), F.sum(gained).alias("total"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    return per_doc.select("row", "id", "n_words", "n_features", mean.alias("weight"))


def gumbel(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """Floored, scaled Gumbel noise of an id: the first 32 bits of a digest of seed and id are its uniform number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` (row, id, n_words, score, ...) with ``rank`` of the drawn rows, from 1 by falling score, ties by id."""
    scored = cut(scored.withColumn("may", F.col("n_words") >= least_words))
    order = [F.col("may").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    numbered = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.count_if("may").alias("can"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"), F.sum("can").over(Window.partitionBy(F.lit(0))).alias("__can"))
    ranked = numbered.withColumn("__part", part).withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    place = F.col("__offset") + F.col("__inside") + 1
    taken = F.col("may") & (place <= F.expr(f"({percent} * __can) div 100"))
    return ranked.withColumn("rank", F.when(taken, place)).drop("__part", "__inside", "__offset", "__can", "__place", "may")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
                        percent: int = 25, least_words: int = 20, seed: int = 7, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``percent`` of those with enough words are drawn."""
    table = position_table(docs, id_col, text_col, orders, buckets)
    wanted = position_table(target, None, target_text_col, orders, buckets)
    gain = gains(bucket_counts(table, orders, "s"), bucket_counts(wanted, orders, "t"), buckets)
    scored = document_weights(table, gain, orders).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    return drawn(scored, percent, least_words).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
