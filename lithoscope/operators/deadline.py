"""A deadline for each record of a slow function: a record that overruns costs its deadline and nothing else.

Spark retries or kills whole tasks, never a record. So each task keeps child processes that work on one record each; if a
child does not answer in time, or dies, it is replaced and the record becomes a row that says so. While a record takes long,
the next ones go to another child: records that never end wait for their deadlines side by side, not one after the other.
"""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable, Iterator
from multiprocessing.connection import wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Child:
    """A process that answers one value at a time."""

    def __init__(self, work: Callable):
        self.work, self.process = work, None

    def begin(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=self.serve, args=(theirs,), daemon=True)
        self.process.start()
        theirs.close()

    def serve(self, pipe) -> None:
        while True:
            value = pipe.recv()
            try:
                answer = ("ok", self.work(value))
            except Exception as e:  # the record's own failure, told in its row
                answer = (f"error: {type(e).__name__}: {e}", None)
            pipe.send(answer)

    def send(self, value, seconds: float) -> None:
        """Gives the child a value and notes until when its answer is awaited."""
        if self.process is None:
            self.begin()
        self.until = time.monotonic() + seconds
        try:
            self.pipe.send(value)
        except (EOFError, OSError):
            pass  # it died: receiving tells so

    def answer(self) -> tuple:
        """(status, result) of the value sent; the child must have answered, died or overrun."""
        try:
            if self.pipe.poll(0):
                return self.pipe.recv()
            status = "timeout"
        except (EOFError, OSError):
            status = "died"
        self.end()
        return status, None

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


def answers(children: list[Child], values: list, seconds: float, patience: float = 0.05) -> list[tuple]:
    """(status, result) of each value. One child works at a time; once it takes longer than ``patience``, the next value goes
    to another one, so that records which overrun wait side by side."""
    told: list = [None] * len(values)
    busy: dict[Child, int] = {}
    free, following, latest, impatient = children[::-1], 0, None, 0.0
    while following < len(values) or busy:
        more = following < len(values) and bool(free)
        if more and (latest not in busy or time.monotonic() >= impatient):
            latest = free.pop()
            busy[latest] = following
            latest.send(values[following], seconds)
            following, impatient = following + 1, time.monotonic() + patience
            continue
        wake = min([c.until for c in busy] + ([impatient] if more else []))
        ready = wait([c.pipe for c in busy], max(0.0, wake - time.monotonic()))
        now = time.monotonic()
        for child in [c for c in busy if c.pipe in ready or now >= c.until]:
            told[busy.pop(child)] = child.answer()
            free.insert(len(free) if child.process else 0, child)  # those that live go first
    return told


def with_deadline(df: DataFrame, column: str, work: Callable, kind: str, seconds: float, name: str = "result", status: str = "status", children: int = 8) -> DataFrame:
    """Adds ``work`` of a column as ``name`` (a DDL type ``kind``) and ``status``: ok, timeout, died, or an error's text.

    A value that is not ok has a null result. Null values are given to ``work`` as None. Rows keep their order within a
    partition; existing columns of these names are replaced. A task has up to ``children`` processes, of which all but one
    work on records that already take long.
    """
    kept = [c for c in df.columns if c.lower() not in (name.lower(), status.lower())]
    rows = df.select(*kept, F.col(column).alias("__value"))
    empty = rows.select(*kept).withColumn(name, F.lit(None).cast(kind)).withColumn(status, F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [Child(work) for _ in range(max(1, children))]
        try:
            for frame in frames:
                told = answers(some, [None if v is None or v is pd.NA else v for v in frame["__value"]], seconds)
                yield frame[kept].assign(**{name: pd.Series([r for _, r in told], index=frame.index, dtype=object), status: pd.Series([s for s, _ in told], index=frame.index, dtype=object)})
        finally:
            for child in some:
                child.end()

    return rows.mapInPandas(run, empty.schema)
