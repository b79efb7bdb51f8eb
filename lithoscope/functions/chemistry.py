"""Element labels and formulas."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

#: Symbols that a label may stand for.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se "
    "Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb "
    "Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm").split()  # fmt: skip
#: Electronegativity, mass and radius of an element without data.
DEFAULT_ELEMENT = (2.0, 16.0, 1.5)


#: Labels that are spelled after something else, as patterns, and their elements (water, deuterium).
SPELLED = {r"""(?i)^['"]*wat""": "O", r"""(?i)^['"]*d['"]*$""": "H"}
#: A symbol at the beginning of a label, its first letter in either case; the longer symbols are tried first.
SYMBOL = r"""^['"]*(""" + "|".join(f"[{s[0]}{s[0].lower()}]{s[1:]}" for s in sorted(ELEMENTS, key=len, reverse=True)) + ")"


def element_of_label(label: Column) -> Column:
    """Element of an atom label (Ba1, OH2, Wat1, D); NULL if there is none."""
    spelled = [F.when(label.rlike(pattern), element) for pattern, element in SPELLED.items()]
    return F.coalesce(*spelled, F.nullif(F.initcap(F.regexp_extract(label, SYMBOL, 1)), F.lit("")))


#: What a formula is made of; anything else makes it unreadable.
_TOKEN = re.compile(
    r"(?P<comment>;.*)|(?P<charge>\^\d+[+-]\^)|(?P<blank>[\s_]+)|(?P<join>Â?[·•])|(?P<element>[A-Z][a-z]?)|(?P<open>[(\[])|(?P<close>[)\]])"
    r"|(?P<number>\d(?:_*\d)*(?:\.\d+)?)|(?P<other>.)", re.S)  # fmt: skip
_SILENT = ("comment", "charge", "blank")


def formula_amounts(text: str | None) -> dict[str, float] | None:
    """Element amounts of a formula; parts joined by a dot (hydrates) add up with their leading factors. None if unreadable.

    Read from its end, so that a number is known before what it multiplies: an element, a closed bracket, or, where a
    part begins, the part. Comments after a semicolon, charges and underscores are silent.
    """
    total: dict[str, float] = {}
    part: dict[str, float] = {}
    scales, number = [1.0], None
    said = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text or "") if m.lastgroup not in _SILENT]
    for kind, token in reversed([("join", ""), *said]):
        times = 1.0 if number is None else number
        if kind == "number" and number is None:
            number = float(token.replace("_", ""))
            continue
        if kind == "close":
            scales.append(scales[-1] * times)
        elif kind == "open" and len(scales) > 1 and number is None:
            scales.pop()
        elif kind == "element" and token in ELEMENTS:
            part[token] = part.get(token, 0.0) + scales[-1] * times
        elif kind == "join" and len(scales) == 1 and (part or number is None):
            for element, amount in part.items():
                total[element] = total.get(element, 0.0) + times * amount
            part = {}
        else:
            return None
        number = None
    return total or None


@F.pandas_udf(MapType(StringType(), DoubleType()))
def parse_formula(text: pd.Series) -> pd.Series:
    """Amounts of each formula; equal ones of a batch are read once."""
    known = {t: formula_amounts(t) for t in text.dropna().unique()}
    return pd.Series([known.get(t) for t in text], index=text.index, dtype=object)
