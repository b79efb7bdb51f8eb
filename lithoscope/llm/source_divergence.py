"""Source divergence audit: how far the term distributions of a language's sources lie apart, and by which terms.

A language keeps the terms of at least ``least_docs`` of its documents (V terms). A group (language and source, or the
language as a whole) with counts c and N in all gives a term the price p(c) = 1 + floor(unit * (c + a) / (N + a * V)), so
a term that the group lacks has the constant price p(0). Two sources' distance is the sum over all V terms of the
differences of price. No table of V terms a pair is made; by inclusion and exclusion over the supports it is

* each group's histogram of counts (count -> number of terms), priced against the other's p(0): as if no term were shared;
* for terms that both have, from the join of their postings: the true difference less the two that were assumed;
* a constant |p(0) - p(0)| for each term that neither has.

Counts and document counts are combined within each task, from the bytes of whole texts, before they are shuffled, so a
source with a third of all rows adds a few rows a task and term. Postings join by (language, term): a term has at most one posting a source, each pair is made once. The
top terms of a group are cut to ``top`` within each task before they meet.

Defined results: null text, language and source are ''; a text without terms leaves its group without counts; a group
without terms has the constant price everywhere; a language without kept terms has distances of 0 and no term rows;
repeated rows count as often as they occur; prices and sums are whole numbers; only the named columns are read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, written

#: A byte of UTF-8 as part of a term: A-Z lower-cased, ASCII other than letters as a blank. No byte of a longer character is ASCII.
AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, most: int = 500_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group.

    A task counts its rows' terms itself and passes the counts on whenever it holds more than ``most`` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, present) in held.items():
                terms = list(n)
                for low in range(0, len(terms), 100_000):
                    some = terms[low:low + 100_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()),
                        pa.array([n[t] for t in some], pa.int64()), pa.array([present[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, present = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(AS_TERMS).split()
                n.update(terms)
                present.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > most:
                yield from passed()
        yield from passed()

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, n: Column, v: Column, unit: int, add: int) -> Column:
    """1 + floor(unit * (count + add) / (n + add * v)), exact for any counts; null where a language keeps no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(unit).cast("decimal(10,0)") * wide(count + add)
    return F.call_function("div", top, F.nullif(wide(n + add * v), F.lit(0).cast("decimal(20,0)"))) + 1


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30,
                      add: int = 5, unit: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source, ``term`` rows for the telling terms."""
    counts = written(term_counts(docs, text_col, lang_col, source_col), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    postings = cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    named = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    whole = postings.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    sizes = postings.groupBy("lang", "source").agg(F.count("*").alias("support"), F.sum("n").alias("total"))
    groups = named.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
    zero = F.lit(0).cast("long")
    groups = cut(groups.withColumn("none", F.coalesce(price(zero, F.col("total"), F.col("v"), unit, add), zero)))

    priced = postings.join(groups.select("lang", "source", "total", "v", "none"), ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("v"), unit, add))
    side = lambda df, s, *names: df.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in names))
    pairs = side(groups, "a", "source", "support", "none").join(side(groups.select("lang", "source", "support", "none", "v"), "b", "source", "support", "none", "v"), "lang").filter("source_a <> source_b")
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    sided = side(histogram, "a", "source", "p", "m").join(pairs.select("lang", "source_a", "source_b", "none_b"), ["lang", "source_a"])
    alone = sided.groupBy("lang", "source_a", "source_b").agg(F.sum(F.abs(F.col("p_a") - F.col("none_b")) * F.col("m_a")).alias("value"))
    constant = pairs.select("lang", "source_a", "source_b", ((F.col("v_b") - F.col("support_a") - F.col("support_b")) * F.abs(F.col("none_a") - F.col("none_b"))).alias("value"))
    posted = lambda s: priced.select("lang", "term", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "none")))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    met = posted("a").join(posted("b"), ["lang", "term"]).filter("source_a < source_b")
    shared = met.groupBy("lang", "source_a", "source_b").agg(F.sum(gap("p_a", "p_b") - gap("p_a", "none_b") - gap("none_a", "p_b") + gap("none_a", "none_b")).alias("value"))
    turned = lambda df: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    every = [alone, turned(alone), constant, shared, turned(shared)]
    total = every[0]
    for more in every[1:]:
        total = total.unionByName(more)
    distance = total.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")).select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")

    usual = whole.join(langs, "lang").select("lang", "term", price(F.col("n"), F.col("all"), F.col("v"), unit, add).alias("q"))
    telling = priced.join(usual, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = telling.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)
    return distance.withColumn("rank", F.row_number().over(ranks)).unionByName(best)
