"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a score quantile.

A document's strength is linear in features of its whole text (shares of byte kinds, word and line statistics), which
hold for any language and script. Pairs of one good and one poor document state preferences; the weights minimise the
logistic loss on feature differences. The threshold is the quantile of the training scores that leaves the share of
poor documents below it; a logistic scale around the threshold turns a strength into a score between 0 and 1 that
crosses ``cut_at`` there.

Training uses all labelled rows but held-out ones, and all their pairs: features are computed once for every document and
kept; each step adds up, by class and bin of strength, how many rows there are and their features (a combiner in each task,
at most two thousand rows to the driver), which gives the gradient over all pairs, a bin's rows taken at their mean
strength. The threshold is the exact quantile over all training rows.

Defined results: a null or empty text has zero features and gets a score like any other; without labels of both
classes every score is the share of good labels, or 0.5 without any; labels of unknown ids, null and repeated labels
are ignored or merged; repeated rows are scored alike; only the named columns are read; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import exact_quantiles
from ._common import cut, held_out, learnable_labels

#: Byte kinds whose shares are features, as (name, bytes).
KINDS = (
    ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"), ("space", b" \t\r\x0b\x0c"),
    ("line", b"\n"), ("stop", b".?"), ("shout", b"!"), ("pause", b",;:"), ("bar", b"|"), ("hash", b"#"), ("star", b"*"),
    ("dollar", b"$"), ("percent", b"%"), ("and", b"&"), ("angle", b"<>"), ("bracket", b"()[]{}"), ("quote", b"\"'`"),
    ("slash", b"/\\_=+~^@-"), ("high", bytes(range(128, 256))),
)
FEATURES = tuple(n for n, _ in KINDS) + ("words", "word_length", "distinct", "twins", "shouted", "marked", "bare", "line_words", "line_copies", "common")
_OF = np.full(256, len(KINDS), np.int64)
for _k, (_, _bytes) in enumerate(KINDS):
    _OF[list(_bytes)] = _k
_MARKS = tuple(b"#*$%&|<>!")


def features(text: bytes | None) -> np.ndarray:
    """The feature row of a whole text."""
    out = np.zeros(len(FEATURES))
    words = text.split() if text else []
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(KINDS)] = np.bincount(_OF, weights=counts, minlength=len(KINDS) + 1)[: len(KINDS)] / len(text)
    n = len(words)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = shouted = bare = 0
    for w, c in tally.items():
        if w[-1] in _MARKS:
            marked += c
            if not w[0] > 63:
                bare += c
        if w.isupper():
            shouted += c
    out[len(KINDS):] = (
        np.log1p(n) / 10, min(len(text) / n / 20, 2), len(tally) / n, sum(map(bytes.__eq__, words, words[1:])) / n, shouted / n,
        marked / n, bare / n, min(n / len(lines) / 100, 2), 1 - len(set(lines)) / len(lines), max(tally.values()) / n)
    return out


@dataclass(frozen=True)
class BradleyTerry:
    """Weights on standardised features, the quantile threshold and the scale of the scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0
    cut_at: float = 0.3
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        at = self.slope * (self.strength(x) - self.threshold) + np.log(self.cut_at / (1 - self.cut_at))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of a batch of training rows."""
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)


def _moments(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, tuple]:
    """y -> (n, sum, sum of products) of the standardised features; a task sends a row for each class."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = _rows(batch)
            z = np.clip((x - mean) / scale, -8, 8)
            for c in (0, 1):
                own = z[y == c]
                held[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(held.tolist(), pa.list_(pa.float64()))], names=["y", "m"])

    parts = sorted((r["y"], r["m"]) for r in rows.mapInArrow(run, "y int, m array<double>").collect())  # two rows a task
    sums = {c: sum((np.array(m) for y, m in parts if y == c), np.zeros(1 + d + d * d)) for c in (0, 1)}
    return {c: (m[0], m[1:1 + d], m[1 + d:].reshape(d, d)) for c, m in sums.items()}


def _binned(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """(y, n, sum of standardised features) of each bin of strength that holds rows of a class."""
    d, reach = len(mean), max(1e-6, min(8 * float(np.abs(w).sum()), 40.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * bins, 1 + d))
        for batch in batches:
            y, x = _rows(batch)
            z = np.clip((x - mean) / scale, -8, 8)
            cell = y * bins + np.clip(((z @ w + reach) * (bins / (2 * reach))).astype(np.int64), 0, bins - 1)
            order = np.argsort(cell, kind="stable")
            if len(order):
                starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
                held[cell[order][starts]] += np.add.reduceat(np.column_stack([np.ones(len(z)), z])[order], starts)
        on = np.flatnonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *(pa.array(c) for c in held[on].T.copy())], names=["cell", *(f"z{i}" for i in range(1 + d))])

    parts = rows.mapInArrow(run, "cell int, " + ", ".join(f"z{i} double" for i in range(1 + d)))
    got = parts.groupBy("cell").agg(*(F.sum(f"z{i}") for i in range(1 + d))).collect()  # a row for each class and bin
    return np.array([[r[0] // bins, *r[1:]] for r in sorted(got)])


def fit(rows: DataFrame, cut_at: float = 0.3, l2: float = 1e-3, steps: int = 25, bins: int = 1024) -> BradleyTerry:
    """Bradley-Terry weights over all pairs of a good and a poor row of ``rows`` (y, x), by accelerated steps of the logistic bound."""
    d = len(FEATURES)
    n0, n1 = ((m := _moments(rows, np.zeros(d), np.ones(d)))[c][0] for c in (0, 1))
    n = n0 + n1
    if not n0 or not n1:
        return BradleyTerry(np.zeros(d), np.ones(d), np.zeros(d), constant=float(n1 / n) if n else 0.5)
    mean = (m[0][1] + m[1][1]) / n
    scale = np.maximum(np.sqrt(np.clip(np.diag(m[0][2] + m[1][2]) / n - mean**2, 0, None)), 1e-6)
    z = _moments(rows, mean, scale)
    centre = {c: z[c][1] / z[c][0] for c in (0, 1)}
    apart = centre[1] - centre[0]
    spread = sum(z[c][2] / z[c][0] - np.outer(centre[c], centre[c]) for c in (0, 1)) + np.outer(apart, apart)
    bound = spread / 4 + l2 * np.eye(d)  # the loss is nowhere more curved
    w = before = np.zeros(d)
    for t in range(1, steps + 1):
        v = w + (t - 1) / (t + 2) * (w - before)
        got = _binned(rows, mean, scale, v, bins)
        (good, x1), (poor, x0) = ((p[:, 1], p[:, 2:]) for p in (got[got[:, 0] == 1], got[got[:, 0] == 0]))
        less = 1 / (1 + np.exp(np.clip((x1 @ v / good)[:, None] - x0 @ v / poor, -30, 30)))
        step = np.linalg.solve(bound, ((less @ poor) @ x1 - (good @ less) @ x0) / (n0 * n1) - l2 * v)
        before, w = w, v + step
        if np.abs(step).max() < 1e-4:
            break

    @F.pandas_udf("double")
    def strength(x: pd.Series) -> pd.Series:
        return pd.Series((np.clip((np.stack(x) - mean) / scale, -8, 8) @ w).round(9)) if len(x) else pd.Series([], dtype=float)

    scored = cut(rows.select(F.lit(0).alias("all"), "y", strength("x").alias("s")))
    threshold = exact_quantiles(scored, ["all"], "s", {"q": float(n0 / n)}).first()["q"]
    middle = {r["y"]: r["q"] for r in exact_quantiles(scored, ["y"], "s", {"q": 0.5}).collect()}  # two rows
    return BradleyTerry(mean, scale, w, float(threshold), 4.0 / max(1e-6, middle[1] - middle[0]), cut_at)


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, digest, x) of every row of ``docs``, kept in the shared folder: texts are read once."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("digest"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(3).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], names=["id", "held_out", "digest", "x"])

    return cut(rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("x", T.ArrayType(T.DoubleType()))])))


def train(featured: DataFrame, labels: DataFrame, label: str = "quality", cut_at: float = 0.3) -> BradleyTerry:
    """A model from all learnable rows of ``feature_rows``; of repeated ids the one whose text has the smallest digest counts."""
    known = learnable_labels(labels, label).withColumnRenamed("doc_id", "id")
    rows = featured.join(known, "id").groupBy("id").agg(F.min_by(F.struct("y", "x"), "digest").alias("r"))
    return fit(cut(rows.select("r.y", "r.x")), cut_at)


def score_column(model: BradleyTerry, text: Column) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return score(text.cast("binary"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    featured = feature_rows(docs, id_col, text_col)
    model = train(featured, labels, "quality", cut_at)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x))) if len(x) else pd.Series([], dtype=float)

    scored = featured.select(F.col("id").alias(id_col), "held_out", score("x").alias("score"))
    return scored.select("*", (F.col("score") >= cut_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut_at: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns.

    Null and empty texts are judged by their zero features; a null or repeated id doesn't matter, each row is judged by
    its own text; an empty table gives an empty table.
    """
    model = train(feature_rows(docs), labels, cut_at=cut_at)
    return docs.filter(score_column(model, F.col("text")) >= cut_at)
