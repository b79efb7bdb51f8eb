"""The thin queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    from .packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back.

    Turns come as records of two layouts, flat for even ids and nested for others; their fingerprints choose the mapping.
    """
    from .chat_format import format_rows, masked, parsed, turn_rows

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '{0}'), (-7L, 1L, 'assistant', '{0}') AS t(conv_id, turn, role, text)".format(said))
    flat = F.struct("conv_id", "turn", "role", "text")
    nested = F.struct(F.struct(F.col("conv_id").alias("id")).alias("conversation"), F.col("turn").alias("position"), F.struct("role", F.col("text").alias("content")).alias("message"))
    records = rows.unionByName(extra).select(F.when(F.col("conv_id") % 2 == 0, F.to_variant_object(flat)).otherwise(F.to_variant_object(nested)).alias("record"))
    out = format_rows(turn_rows(records))
    turns = F.col("__turns")
    return (
        out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("__turns"), masked(F.col("formatted"), F.col("loss")).alias("__loss"))
        .select(
            "conv_id", F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("__loss").cast("long").alias("loss_chars"), F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings of one label."""
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives in the shared folder, read back record by record."""
    from ._common import shared_dir
    from .warc import read_archives, with_revisits, write_archives

    pages = table(spark, sf_dir, "pages")
    archives = write_archives(with_revisits(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    read = read_archives(archives, with_payload=False).filter("record_type IN ('response', 'revisit')")
    page_id, refers_to = (F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "refers_to")))
    return read.select(page_id, "payload_bytes", "payload_digest", "record_type", refers_to)


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document, decoded and compared with its text, and its encoding."""
    from .sentencepiece_sampling import sample_segmentations

    return sample_segmentations(table(spark, sf_dir, "documents"), packed=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from .quality_classifier import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-first rules over all documents."""
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's URL: fixed rules, else trust and distrust propagated over the host graph."""
    from .url_graph import Rule, judge_urls

    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn by how far their n-grams resemble those of the benchmark."""
    from .importance_resampling import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms by which a source stands out."""
    from .source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_chat_format, op3_embedding_dedup, op4_html_extract, op5_warc, op6_sentencepiece_sampling, op7_toxicity, op8_simhash,
    op9_quality_classifier, op10_quality_rules, op11_url_filters, op12_importance_resampling, op13_source_divergence)}
