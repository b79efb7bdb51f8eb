"""Structure text (CIF) to cell and sites: one bounded row each, so reading is a projection without a shuffle.

A text is cut into tokens by one pattern (values, quoted values, fields of several lines, comments) and folded into named
columns; a loop is several columns at once. Symmetry operations are read into matrices, and a site's images that fall on
one place, by the distance across cell borders, are one site. What is damaged is told in ``status``; nothing raises.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chemistry import SPELLED, SYMBOL

_TOKEN = re.compile(
    r"^;(?P<field>[^\n]*(?:\n(?!;)[^\n]*)*)\n;|(?<!\S)#[^\n]*|(?<!\S)'(?P<single>(?:[^'\n]|'(?=\S))*)'(?!\S)|(?<!\S)\"(?P<double>(?:[^\"\n]|\"(?=\S))*)\"(?!\S)|(?P<word>\S+)", re.M)
_TERM = re.compile(r"([+-]?)(?:(\d+(?:\.\d+)?)(?:/(\d+))?)?\*?([xyz])?")
#: Names of the columns that are read; the first that is there counts.
CELL = ("_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_angle_alpha", "_cell_angle_beta", "_cell_angle_gamma")
OPERATIONS = ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz")
SITES = ("_atom_site_label", "_atom_site_type_symbol", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z", "_atom_site_occupancy")
#: Images of a site nearer than this (in the cell's unit of length) are one site.
SAME_PLACE = 0.05

STRUCTURE = T.StructType([
    T.StructField("cell", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("volume", T.DoubleType()), T.StructField("n_operations", T.IntegerType()),
    T.StructField("sites", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("element", T.StringType()), T.StructField("occupancy", T.DoubleType()), T.StructField("xyz", T.ArrayType(T.DoubleType()))]))),
    T.StructField("status", T.StringType())])


def columns_of(text: str) -> dict[str, list[str]]:
    """Named columns of a text, in lower case; a single item is a column of one value."""
    columns: dict[str, list[str]] = {}
    open_: list[str] = []  # the columns that values go to, in turn
    heading, turn = False, 0
    for m in _TOKEN.finditer(text):
        word = m["word"]
        if word is not None and word.lower() == "loop_":
            open_, heading, turn = [], True, 0
        elif word is not None and word.lower().startswith(("data_", "save_", "global_", "stop_")):
            open_, heading = [], False
        elif word is not None and word.startswith("_"):
            name = word.lower()
            open_ = [*open_, name] if heading else [name]
            columns[name], turn = [], 0
        elif m.lastgroup and open_:
            columns[open_[turn % len(open_)]].append(m[m.lastgroup])
            turn, heading = turn + 1, False
    return columns


def number(text: str) -> float:
    """A value without the uncertainty in brackets; NaN if it is unknown or no number."""
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:\(\d+\))?", text)
    return float(m[1]) if m else float("nan")


def operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift of an operation such as ``-y, x-y, z+1/3``."""
    rotation, shift = np.zeros((3, 3)), np.zeros(3)
    parts = text.lower().replace(" ", "").split(",")
    if len(parts) != 3:
        raise ValueError(f"operation {text!r}")
    for i, part in enumerate(parts):
        terms = [m for m in _TERM.finditer(part) if m[0]]
        if "".join(m[0] for m in terms) != part or not terms or any(not (m[2] or m[4]) for m in terms):
            raise ValueError(f"operation {text!r}")
        for sign, value, below, axis in (m.groups() for m in terms):
            size = (-1 if sign == "-" else 1) * float(value or 1) / float(below or 1)
            if axis:
                rotation[i, "xyz".index(axis)] += size
            else:
                shift[i] += size
    return rotation, shift


def lattice(lengths: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The cell's edges as rows."""
    alpha, beta, gamma = np.cos(np.radians(angles))
    sine = np.sqrt(1 - gamma**2)
    y = (alpha - beta * gamma) / sine
    return lengths[:, None] * np.array([[1, 0, 0], [gamma, sine, 0], [beta, y, np.sqrt(max(0.0, 1 - beta**2 - y**2))]])


def element_of(label: str) -> str | None:
    spelled = next((e for pattern, e in SPELLED.items() if re.search(pattern, label)), None)
    found = re.search(SYMBOL, label)
    return spelled or (found[1].capitalize() if found else None)


def structure(text: str | None) -> dict:
    """Cell, sites and status of one text."""
    out = {"cell": None, "volume": None, "n_operations": None, "sites": None, "status": "ok"}
    columns = columns_of(text or "")
    first = lambda names: next((columns[n] for n in names if columns.get(n)), [])
    cell = np.array([number((columns.get(n) or ["?"])[0]) for n in CELL])
    if not (np.isfinite(cell).all() and (cell[:3] > 0).all() and (cell[3:] > 0).all() and (cell[3:] < 180).all()):
        return out | {"status": "no cell"}
    edges = lattice(cell[:3], cell[3:])
    volume = float(np.linalg.det(edges))
    if not volume > 1e-6 * cell[:3].prod():
        return out | {"status": "flat cell"}
    try:
        operations = [operation(o) for o in first(OPERATIONS)] or [(np.eye(3), np.zeros(3))]
    except ValueError as e:
        return out | {"status": str(e)}
    out |= {"cell": edges.tolist(), "volume": volume, "n_operations": len(operations)}
    labels, symbols, occupancies = columns.get(SITES[0], []), columns.get(SITES[1], []), columns.get(SITES[5], [])
    xyz = [columns.get(n, []) for n in SITES[2:5]]
    if not labels or any(len(c) != len(labels) for c in xyz):
        return out | {"status": "no sites" if not labels else "sites cut off"}
    sites, told = [], []
    for k, label in enumerate(labels):
        place, element = np.array([number(c[k]) for c in xyz]), element_of(symbols[k] if k < len(symbols) else label) or element_of(label)
        if not np.isfinite(place).all() or element is None:
            told.append(f"site {label}")
            continue
        occupancy = number(occupancies[k]) if k < len(occupancies) else 1.0
        images: list[np.ndarray] = []
        for rotation, shift in operations:
            image = (rotation @ place + shift) % 1.0
            apart = np.array([image - i for i in images]).reshape(-1, 3)
            if not (np.linalg.norm((apart - np.rint(apart)) @ edges, axis=1) < SAME_PLACE).any():
                images.append(image)
        sites += [{"label": label, "element": element, "occupancy": 1.0 if np.isnan(occupancy) else occupancy, "xyz": i.tolist()} for i in images]
    return out | {"sites": sites, "status": "; ".join(told) or "ok"}


@F.pandas_udf(STRUCTURE)
def _structures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([structure(t) for t in text], columns=STRUCTURE.names)


def with_structure(df: DataFrame, text: str | Column = "text", name: str = "structure") -> DataFrame:
    """Adds cell (edges as rows), volume, n_operations, sites (label, element, occupancy, fractional xyz) and status.

    Null and empty texts have the status "no cell". Unknown coordinates or elements leave out that site and are told; a
    missing operation list means the identity; a missing occupancy is 1.
    """
    return df.withColumn(name, _structures(F.col(text) if isinstance(text, str) else text))
