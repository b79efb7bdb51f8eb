"""Rows packed into blocks: a row of a block frame holds the columns of some thousand rows as bytes.

Passes over many numbers of many rows read blocks without a Python object a row; sums by group leave a task as a row for
each group and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resampling import group_folds


@dataclass
class Block:
    """Columns of ``n`` rows: ``x``, ``y``, ``folds`` and ``pred`` are (column, row); ``g`` is the place of a row's group in ``grp``."""

    n: int
    grp: pa.Array
    g: np.ndarray
    key: np.ndarray
    folds: np.ndarray
    x: np.ndarray
    y: np.ndarray
    pred: np.ndarray | None = None
    memo: dict = field(default_factory=dict)

    def once(self, key, made):
        """``made()``, kept with the block."""
        if key not in self.memo:
            self.memo[key] = made()
        return self.memo[key]


def read(batch: pa.RecordBatch, kind: type = float) -> Iterator[tuple[int, Block]]:
    """(place, block) of an Arrow batch; ``kind`` is the type of x."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        n = batch.column(names.index("n"))[i].as_py()
        of = lambda name, dtype: np.frombuffer(batch.column(names.index(name))[i].as_buffer(), dtype)  # noqa: B023, E731
        wide = lambda name, dtype: of(name, dtype).reshape(-1, n)  # noqa: B023, E731
        yield i, Block(n, batch.column(names.index("grp"))[i].values, of("g", np.int32), of("key", np.int64), wide("folds", np.int32), wide("x", kind), wide("y", float),
                       wide("pred", float) if "pred" in names else None)


def changed(batch: pa.RecordBatch, name: str, values: list[bytes]) -> pa.RecordBatch:
    """The batch with a binary column replaced or added."""
    column, names = pa.array(values, pa.binary()), batch.schema.names
    columns = [column if n == name else batch.column(i) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns if name in names else [*columns, column], names=names if name in names else [*names, name])


def packed(df: DataFrame, columns: list[str], targets: list[str], group: str, key: str, folds: int, repeats: int, seed: int, fold_column: str | None = None,
           cuts: list[np.ndarray] | None = None, missing: int = 255, most: int = 1 << 15, complete: bool = False) -> DataFrame:
    """Blocks of at most ``most`` rows and a batch: x as doubles or, with ``cuts``, as a byte a column; unknown numbers are NaN.

    ``key`` is a hash of the named column and the seed. ``complete`` leaves out rows that lack a target.
    """
    for r in range(repeats):
        df = df.withColumn("__fold_0", F.col(fold_column).cast("int")) if fold_column else group_folds(df, group, folds, seed + r).withColumnRenamed("fold", f"__fold_{r}")
    number = lambda c, name: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(name)
    rows = df.select(F.col(group).alias("grp"), F.xxhash64(key, F.lit(seed)).alias("key"), *(number(c, f"x{i}") for i, c in enumerate(columns)),
                     *(number(c, f"y{i}") for i, c in enumerate(targets)), *(F.col(f"__fold_{r}").cast("int").alias(f"r{r}") for r in range(repeats)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            flat = lambda c: t.column(c).combine_chunks()
            values = lambda letter, count: np.stack([flat(f"{letter}{i}").to_numpy(zero_copy_only=False) for i in range(count)]) if count else np.zeros((0, len(t)))
            coded = flat("grp").dictionary_encode(null_encoding="encode")
            x, y, fold, on = values("x", len(columns)), values("y", len(targets)), values("r", repeats).astype(np.int32), slice(None)
            if complete:
                on = np.flatnonzero(~np.isnan(y).any(0))
            x, y = x[:, on], y[:, on]
            if cuts is not None:
                x = np.stack([np.where(np.isnan(v), missing, np.searchsorted(c, v)) for v, c in zip(x, cuts, strict=True)]).astype(np.uint8)
            cells = [coded.indices.to_numpy()[on].astype(np.int32), flat("key").to_numpy()[on], fold[:, on], x, y]
            grp = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            return pa.RecordBatch.from_arrays([pa.array([y.shape[1]], pa.int32()), grp, *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)],
                                              names=["n", "grp", "g", "key", "folds", "x", "y"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield block()
        if sum(b.num_rows for b in held):
            yield block()

    kind = df.schema[group].dataType.simpleString()
    blocks = rows.mapInArrow(pack, f"n int, grp array<{kind}>, g binary, key binary, folds binary, x binary, y binary").filter("n > 0")
    return blocks.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)  # a small table is few tasks, but much work a row


def error_sums(blocks: DataFrame, predict, names: dict[str, str], kind: type = float) -> DataFrame:
    """(grp, names, n, sy, syy, see) of the predictions of each block.

    ``predict(block)`` yields (values of the columns ``names``, rows, their y, their predictions); ``names`` are column: type.
    """
    group = blocks.schema["grp"].dataType.elementType.simpleString()
    told = ", ".join(f"`{n}` {t}" for n, t in names.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string() if t == "string" else pa.int32() for t in names.values()]
        for batch in batches:
            for _, b in read(batch, kind):
                for values, on, y, pred in predict(b):
                    add = lambda v=None: np.bincount(b.g[on], v, len(b.grp))  # noqa: B023, E731
                    n = add()
                    some = np.flatnonzero(n)
                    sums = [n[some].astype(np.int64), *(add(v)[some] for v in (y, y * y, (y - pred) ** 2))]
                    yield pa.RecordBatch.from_arrays([b.grp.take(pa.array(some)), *(pa.array([v] * len(some), t) for v, t in zip(values, types, strict=True)), *map(pa.array, sums)],
                                                     names=["grp", *names, "n", "sy", "syy", "see"])

    parts = blocks.mapInArrow(run, f"grp {group}, {told}, n long, sy double, syy double, see double")
    return parts.groupBy("grp", *names).agg(*(F.sum(c).alias(c) for c in ("n", "sy", "syy", "see")))
