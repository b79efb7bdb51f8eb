"""Exact nearest neighbours by pivots: equal to all pairs, with dense cells, copies and few rows; no Cartesian product."""

import numpy as np
import pytest

from lithoscope.operators.models import nearest, nearest_of_block


def by_hand(q, rows, k):
    out = {}
    for i, v in q:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in rows if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "few", "line"])
def test_equal_to_all_pairs(spark, kind):
    random = np.random.default_rng(4)
    if kind == "clusters":
        v = np.concatenate([random.normal(size=(80, 3)) * 0.05 + 5 * random.normal(size=3) for _ in range(4)])
    elif kind == "copies":  # a third are one vector: ties by id
        v = np.concatenate([np.ones((90, 3)), random.normal(size=(150, 3))])
    elif kind == "few":
        v = random.normal(size=(4, 3))
    else:
        v = np.arange(200.0)[:, None] * [1.0, 0.0, 0.0]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    asked = rows[::7] + [(10_000, [0.5, 0.5, 0.5])]
    frame = lambda r: spark.createDataFrame(r, "id long, v array<double>")
    found = nearest(frame(asked), frame(rows), 5, block=16)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["d2"], r["neighbour"])):
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert got == by_hand(asked, rows, 5)
    if kind == "clusters":
        plan = found._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert nearest(frame(asked), frame(rows[:0]), 5).count() == 0 and nearest(frame(asked[:0]), frame(rows), 5).count() == 0


def test_a_block_of_queries_at_once():
    """Near copies far from the origin, where a product of matrices rounds the distances away, and vectors that are not numbers."""
    random = np.random.default_rng(6)
    v = 1e4 + random.normal(size=(60, 4)) * 1e-4
    v[7] = np.nan
    part = np.arange(60) % 3
    inside = random.random((60, 60)) < 0.7
    got = nearest_of_block(v, np.arange(60), part, inside, v, np.arange(60), part, 5)
    for q in range(60):
        on = np.flatnonzero(inside[q] & (part != part[q]))
        d2 = ((v[on] - v[q]) ** 2).sum(1)
        assert got[got["query"] == q]["neighbour"].tolist() == on[np.lexsort((on, d2))[:5]].tolist()


def test_many_small_tasks_and_a_vector_that_is_no_number(spark):
    """Groups of queries against slices of rows; a row without a distance hid the cell that it was put into."""
    random = np.random.default_rng(8)
    v = np.concatenate([random.normal(size=(250, 3)), random.normal(size=(150, 3)) * 0.01])  # a dense cell: several groups and slices
    rows = [(i, x.tolist(), i % 4) for i, x in enumerate(v)]
    frame = spark.createDataFrame([*rows, (400, [float("nan")] * 3, 9)], "id long, v array<double>, part long")
    found = nearest(frame.filter("id < 400"), frame, 5, block=16)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["d2"], r["neighbour"])):
        got.setdefault(r["query"], []).append(r["neighbour"])
    small = nearest(frame.filter("id < 400"), frame, 5, block=16, asked_rows=32, held_rows=64)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found.collect()))
    for i, x, p in rows:
        assert got[i] == [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(x, w)), j) for j, w, q in rows if q != p)[:5]]
