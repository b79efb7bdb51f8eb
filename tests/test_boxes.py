"""Overlaps of boxes equal those of all pairs: tiny and huge boxes, negative places, touching sides, copies."""

import random

from lithoscope.operators.boxes import overlaps


def test_equal_to_all_pairs(spark):
    draw = random.Random(3)
    rows = []
    for i in range(260):
        x, y, w, h = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice([0.01, 0.5, 3, 40]), draw.choice([0.01, 0.5, 3, 200])
        rows.append((draw.choice(["p", "q"]), i, x, y, x + w, y + h))
    rows += [("p", 1000, -1e6, -1e6, 1e6, 1e6), ("p", 1001, 0.0, 0.0, 2.0, 2.0), ("p", 1002, 2.0, 0.0, 4.0, 2.0), ("p", 1003, 0.0, 0.0, 2.0, 2.0), ("q", 1004, 0.0, 0.0, 4.0, 4.0)]
    rows += [("p", 2000, None, 0.0, 1.0, 1.0), ("p", 2001, 0.0, 0.0, 0.0, 1.0), (None, 2002, 0.0, 0.0, 1.0, 1.0), ("p", None, 0.0, 0.0, 1.0, 1.0), ("p", 2003, float("nan"), 0.0, 1.0, 1.0), ("p", 2004, 0.0, 0.0, float("inf"), 1.0)]
    boxes = spark.createDataFrame(rows, "page string, id long, x0 double, y0 double, x1 double, y1 double")
    got = overlaps(boxes, "page", "id").collect()
    good = [r for r in rows if None not in r and all(abs(v) < 1e300 for v in r[2:]) and r[4] > r[2] and r[5] > r[3]]
    want = {}
    for a in good:
        for b in good:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[0] == b[0] and a[1] < b[1] and w > 0 and h > 0:
                want[a[0], a[1], b[1]] = w * h
    assert len(got) == len(want) and {(r["page"], r["a"], r["b"]): r["area"] for r in got} == want
    area = {(r[0], r[1]): (r[4] - r[2]) * (r[5] - r[3]) for r in good}
    half = {k for k, v in want.items() if v > 0.5 * min(area[k[0], k[1]], area[k[0], k[2]])}
    assert {(r["page"], r["a"], r["b"]) for r in overlaps(boxes, "page", "id", least_share=0.5).collect()} == half


def test_no_side_goes_through_the_driver(spark):
    """Exploded entries are larger than the plan thinks: no side may be broadcast."""
    df = spark.range(200).selectExpr("id % 2 AS page", "id AS k", "double(id % 17) AS x0", "double(id % 13) AS y0", "double(id % 17 + 3) AS x1", "double(id % 13 + 2) AS y1")
    got = overlaps(df, "page", "k")
    rows = got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
