"""Records that never end, die or fail become rows; the others are as without a deadline."""

import os
import time

from lithoscope.operators.deadline import with_deadline


def test_each_record_has_its_own_fate(spark):
    def work(v):
        if v == "slow":
            time.sleep(600)
        if v == "dies":
            os._exit(3)
        if v == "fails":
            raise ValueError("no such thing")
        return len(v or "")

    rows = [(i, v) for i, v in enumerate(["a", "slow", "abc", "dies", None, "fails", "", "slow", "abcd"])]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    began = time.time()
    got = {r["id"]: (r["n"], r["status"]) for r in with_deadline(df, "text", work, "int", 2.0, "n").collect()}
    assert got == {0: (1, "ok"), 1: (None, "timeout"), 2: (3, "ok"), 3: (None, "died"), 4: (0, "ok"), 5: (None, "error: ValueError: no such thing"), 6: (0, "ok"), 7: (None, "timeout"), 8: (4, "ok")}
    assert time.time() - began < 60
    again = with_deadline(df.withColumnRenamed("id", "status"), "text", len, "int", 2.0, "text")
    assert again.columns == ["text", "status"] and with_deadline(df.limit(0), "text", len, "int", 1.0).count() == 0


def test_records_that_overrun_wait_side_by_side(spark):
    """Forty records of a task that never end cost a few deadlines, not forty; the others come out in their order."""
    def work(v):
        while v % 10 == 3:
            time.sleep(1)
        return v + 1

    began = time.time()
    got = with_deadline(spark.range(400).coalesce(1), "id", work, "long", 2.0, "n").collect()
    assert time.time() - began < 40
    assert [(r["id"], r["n"], r["status"]) for r in got] == [(i, None if i % 10 == 3 else i + 1, "timeout" if i % 10 == 3 else "ok") for i in range(400)]
