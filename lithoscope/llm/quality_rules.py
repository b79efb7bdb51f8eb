"""Quality rules, line first [native]: judge every line, drop the lines that fail, then judge what is left.

Everything is a built-in function on one row, so nothing is shuffled and no text leaves the JVM.

Defined results: a null or empty text has no words, so it fails the base rules and is not kept; texts of any
length are read whole; repeated rows are judged alike, one result each; only the two named columns are read, so
extra columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Fixed phrases of page furniture, matched in lower-cased lines.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "javascript is disabled", "click here", "sign up for our newsletter", "subscribe to our",
    "log in to", "back to top", "skip to content", "share on facebook", "follow us on",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda argument, never copied into nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a ``width``-word window found twice or more, the first time included.

    Windows are compared by a 64-bit hash over 64-bit word hashes (two different windows of one text of n words
    meet with a chance below n^2 / 2^64). Only a text with a repeated hash pays for the sort that places it.
    """
    n_windows = F.size(words) - (width - 1)

    def count(starts: Column) -> Column:
        """Words covered by windows at ``starts`` (ascending)."""
        gaps = F.transform(starts, lambda p, i: F.when(i > 0, F.least(F.lit(width), p - F.get(starts, i - 1))).otherwise(width))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def placed(pairs: Column) -> Column:
        twin = F.filter(pairs, lambda x, i: F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twin, lambda x: x["p"])), count)

    def windows(hashes: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        return let(at, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p")))), placed)))

    return F.when(n_windows < 2, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def line_facts(line: Column) -> Column:
    """What the rules read of a line: its words, characters, symbols, bars between items and shouted words."""
    def taken(what: str, by: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(what), F.lit(by)))

    return F.struct(
        line.alias("line"), words_of(line).alias("w"), F.length(line).alias("chars"),
        (F.length(line) - F.length(F.translate(line, SYMBOLS, ""))).alias("symbols"),
        taken(" | ", "  ").alias("bars"), taken("!!", "!").alias("shouts"))


def line_fails(x: Column, max_symbols: float = 0.1, max_bars: float = 0.15, max_shout: float = 0.3) -> Column:
    """True for a line (as facts) that is symbol noise, a navigation row, shouting or page furniture.

    Shares are of the line's characters or words, so that its language, script or length does not matter. The
    phrases of page furniture count from one in forty words on; a paragraph that mentions one stays.
    """
    n = F.size(x["w"])
    return ((x["symbols"] > max_symbols * x["chars"]) | (x["bars"] > max_bars * n) | (x["shouts"] > max_shout * n)
            | (F.regexp_count(x["line"], F.lit("(?i)" + "|".join(BOILERPLATE))) * 40 > F.greatest(n - 1, F.lit(0))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
                  max_repeat_percent: int = 30, max_lost: float = 0.5, with_text: bool = False) -> DataFrame:
    """One row per document: base counts, ``kept_words``, ``base_failed`` and ``kept`` (and the cleaned text).

    A document is dropped if it has fewer than ``min_words`` words, if more than ``max_repeat_percent`` of them lie
    in repeated windows, or if the lines that fail hold more than ``max_lost`` of its words.
    """
    zero = F.lit(0).cast("long")

    def total(lines: Column, f) -> Column:
        return F.aggregate(lines, zero, lambda a, x: a + f(x))

    def measured(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.size(x["w"]) > 0)
        return F.struct(
            let(F.flatten(F.transform(lines, lambda x: x["w"])), lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_window_words(w).alias("n_repeat_words"))).alias("words"),
            total(lines, lambda x: x["symbols"]).alias("n_symbols"),
            let(F.transform(worded, lambda x: x["line"]), lambda t: (F.size(t) - F.size(F.array_distinct(t))).cast("long")).alias("n_dup_lines"),
            let(F.filter(lines, lambda x: ~line_fails(x)), lambda left: F.struct(
                total(left, lambda x: F.size(x["w"])).alias("n"),
                (F.array_join(F.transform(left, lambda x: x["line"]), "\n") if with_text else F.lit(None).cast("string")).alias("text"))).alias("left"))

    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), line_facts)
    facts = let(let(lines, measured), lambda m: F.struct(
        m["words"]["n_words"].alias("n_words"), m["words"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"), m["words"]["n_repeat_words"].alias("n_repeat_words"),
        m["left"]["n"].alias("kept_words"), m["left"]["text"].alias("clean_text"),
        ((m["words"]["n_words"] < min_words) | (100 * m["words"]["n_repeat_words"] > max_repeat_percent * m["words"]["n_words"])).alias("base_failed")))
    # An array of one keeps the facts behind explode, so that the optimizer never copies them into each result column.
    out = docs.select(F.col(id_col), F.explode(F.array(facts)).alias("__f"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "base_failed"]
    kept = ~F.col("__f.base_failed") & (F.col("__f.n_words") - F.col("__f.kept_words") <= max_lost * F.col("__f.n_words"))
    return out.select(id_col, *[F.col(f"__f.{n}") for n in names], kept.alias("kept"), *([F.col("__f.clean_text")] if with_text else []))
