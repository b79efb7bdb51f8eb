"""Column expressions: cleaning, names, labels, transforms and entropy.

All are built-in functions, so they stay inside code generation. Missing is NULL, never NaN or infinity; divisions are
``try_divide`` and casts ``try_cast``, because ANSI mode stays on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean true and false.
TRUE_WORDS = ("true", "1", "1.0")
FALSE_WORDS = ("false", "0", "0.0")

#: Elements that decide a mineral family without oxygen.
CHALCOGENS = ("S", "Se", "Te")
HALOGENS = ("F", "Cl", "Br", "I")
#: Error categories of a structure, in the order in which they are looked for.
STRUCTURE_CATEGORIES = ("parse_failed", "symmetry_failed", "group_theory_failed")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where the body uses it inside a lambda for each element."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def clean_float(x: Column) -> Column:
    """NaN and infinities become NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def normalise_name(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def parse_bool(x: Column, default: bool = True) -> Column:
    """Six spellings; anything else (NULL too) is ``default``."""
    word = F.lower(F.trim(x.cast("string")))
    return F.coalesce(F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False), F.lit(default))


def wavelength_group(x: Column) -> Column:
    """Laser group of the first integer in a text."""
    n = F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), r"(\d+)", 1).try_cast("int")
    return F.when(n.isNull(), "unknown").when(n == 532, "532 nm").when(n.between(780, 785), "780-785 nm").otherwise("other")


def category(x: Column) -> Column:
    """A nullable whole number as a level name; missing is the level ``<NA>``."""
    return F.coalesce(x.try_cast("int").cast("string"), F.lit("<NA>"))


def transform(x: Column, kind: str) -> Column:
    """``log``: ln of positive values; ``log1``: ln(1 + x), x clipped at 0; ``none``."""
    return {"log": F.when(x > 0, F.ln(x)), "log1": F.log1p(F.greatest(x, F.lit(0.0))), "none": x}[kind]


def evenness(entropy: Column, n: Column) -> Column:
    """Entropy over its maximum ln n; NULL below two parts."""
    return F.try_divide(entropy, F.when(n > 1, F.ln(n.cast("double"))))


def entropy_of(weights: Column) -> Column:
    """Shannon entropy of an array of non-negative weights; empty or zero total: 0."""
    def body(pair: Column) -> Column:
        share = lambda v: F.try_divide(v, pair["total"])
        return F.aggregate(pair["w"], F.lit(0.0), lambda a, v: a - F.when((v > 0) & (pair["total"] > 0), share(v) * F.ln(share(v))).otherwise(0.0))

    return let(weights, lambda w: let(F.struct(w.alias("w"), F.aggregate(w, F.lit(0.0), lambda a, v: a + v).alias("total")), body))


def median_of(values: Column) -> Column:
    """Median of an array without NULLs; NULL if empty."""
    at = lambda s, i: F.try_element_at(s, F.greatest(i.cast("int"), F.lit(1)))
    return let(F.array_sort(values), lambda s: F.when(F.size(s) > 0, (at(s, F.floor((F.size(s) + 1) / 2)) + at(s, F.floor(F.size(s) / 2) + 1)) / 2))


def stars(p: Column) -> Column:
    """Significance marks at 0.05, 0.01 and 0.001."""
    return F.when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 5e-2, "*").otherwise("")


def p_text(p: Column) -> Column:
    """A p value with three digits, or that it is below 0.001; missing: empty."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 1e-3, "<0.001").otherwise(F.format_string("%.3f", p))


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """An estimate and its interval with signs and two digits."""
    return F.format_string("%+.2f [%+.2f, %+.2f]", value, low, high)


def three_digits(x: Column) -> Column:
    """A number with three significant digits, without trailing zeros; powers of ten below 0.0001 and from 1000 on.

    As in all texts here, a tie of the shortest decimal is rounded away from zero.
    """
    power = F.format_string("%.2e", x)
    exponent = F.regexp_extract(power, "e(.*)$", 1).cast("int")
    plain = F.lit(None).cast("string")
    for e in range(-4, 3):
        plain = F.when(exponent == e, F.format_string(f"%.{2 - e}f", x)).otherwise(plain)
    bare = lambda text, end: F.regexp_replace(text, rf"(\.[0-9]*?)0+{end}", f"$1{end.strip('$')}")
    dotless = lambda text, end: F.regexp_replace(text, rf"\.{end}", end.strip("$"))
    return F.coalesce(dotless(bare(plain, "$"), "$"), dotless(bare(power, "e"), "e"))


def median_text(median: Column, q25: Column, q75: Column) -> Column:
    """A median with its quartiles."""
    return F.concat(three_digits(median), F.lit(" ["), three_digits(q25), F.lit("-"), three_digits(q75), F.lit("]"))


def failure_category(error: Column) -> Column:
    """Taxonomy of a structure error text: the first known category in it; no text means that there were no atoms."""
    text = F.coalesce(error, F.lit(""))
    return F.coalesce(*(F.when(text.contains(c), c) for c in STRUCTURE_CATEGORIES), F.when(text == "", "no_atoms"), F.lit("other"))


def mineral_family(amounts: Column) -> Column:
    """Coarse family of a map element -> amount (amounts of 0 are absent), by the first rule that holds.

    With oxygen, the ratio of oxygen to a former decides whether the former centres an oxyanion (margin 1e-9).
    """
    there = F.map_filter(F.coalesce(amounts, F.create_map().cast("map<string,double>")), lambda k, v: v > 0)
    amount = lambda *elements: sum((F.coalesce(F.try_element_at(there, F.lit(e)), F.lit(0.0)) for e in elements), F.lit(0.0))
    has = lambda *elements: amount(*elements) > 0
    centres = lambda least, *formers: has(*formers) & (amount("O") >= (least - 1e-9) * amount(*formers))
    only = lambda *elements: F.size(F.array_except(F.map_keys(there), F.array(*map(F.lit, elements)))) == 0
    others = F.size(F.array_remove(F.map_keys(there), "H"))
    oxygen = (
        F.when(has("Si"), "silicate")
        .when(~has("P") & (amount("S") <= amount("C")) & centres(3.0, "C"), "carbonate")
        .when(centres(3.5, "S"), "sulfate").when(centres(3.5, "Cr"), "chromate")
        .when(centres(3.0, "P", "As", "V"), "phosphate_arsenate_vanadate").when(has("B"), "borate")
        .when(~has("C") & centres(3.0, "N"), "nitrate").otherwise("oxide_hydroxide"))
    bare = F.when(has(*CHALCOGENS), "sulfide_selenide_telluride").when(has(*HALOGENS), "halide").otherwise("other")
    return (
        F.when(only("O", "H"), F.when(has("O"), "oxide_hydroxide").otherwise("native_element"))
        .when((others == 1) & ~has("O"), "native_element").when(has("O"), oxygen).otherwise(bare))


def element_match(ours: Column, measured: Column, ideal: Column) -> Column:
    """Struct (status, source) of two element sets; measured chemistry goes before ideal."""
    theirs = F.coalesce(measured, ideal)
    same = F.array_sort(F.array_distinct(ours)) == F.array_sort(F.array_distinct(theirs))
    return F.struct(
        F.when(ours.isNull() | theirs.isNull(), "unverified").when(same, "same_element_set")
        .when(F.arrays_overlap(ours, theirs), "partial_element_overlap").otherwise("disjoint_element_sets").alias("status"),
        F.when(ours.isNull(), "amcsd_formula_unparseable").when(measured.isNotNull(), "measured").when(ideal.isNotNull(), "ideal").otherwise("unavailable").alias("source"))
