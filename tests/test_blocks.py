"""Blocks of rows: what is packed is read again; grids shuffle packed rows, forests grow alike in tasks and from histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import blocks as K
from lithoscope.operators import boosting as B
from lithoscope.operators import level_trees as L


def table(spark, n=300):
    random = np.random.default_rng(9)
    rows = [(i, None if i % 37 == 0 else f"g{i % 11}", *(None if random.random() < 0.2 else float(v) for v in random.normal(size=3)), float(random.normal()), float(random.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, a double, b double, c double, y double, z double")


def test_sums_of_groups_are_those_of_rows(spark):
    df = table(spark)
    packed = K.packed(df.repartition(3), ["a", "b"], ["y"], "g", "id", 3, 2, 0, most=50)
    assert packed.count() < 12 and packed.agg(F.sum("n")).first()[0] == 300
    held = lambda b: [(("t",), np.flatnonzero(~np.isnan(b.x[0])), b.y[0][~np.isnan(b.x[0])], b.x[0][~np.isnan(b.x[0])])]
    got = {r["grp"]: (r["n"], r["sy"], r["see"]) for r in K.error_sums(packed, held, {"what": "string"}).collect()}
    want = {r["g"]: (r["n"], r["sy"], r["see"]) for r in df.filter("a IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("y") - F.col("a"), 2)).alias("see")).collect()}
    assert got.keys() == want.keys() and None in got and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_fit_of_a_hundred_thousand_rows_is_a_task(spark, monkeypatch):
    """Beyond 100,000 rows the grid grew from histograms, 450 passes and as many shuffles."""
    monkeypatch.setattr(L, "boosted_sums", lambda *a, **k: pytest.fail("grown by levels"))
    df = spark.range(100_001).select("id", (F.col("id") % 50).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") - F.col("b"))
    sums = B.tree_grid(df, ["y"], {"all": ["a", "b"]}, "g", "id", folds=2, repeats=1, trees=3)
    assert sums.agg(F.sum("n")).first()[0] == 100_001


def test_forests_of_tasks_equal_forests_of_histograms(spark):
    """On the same partitions: where splits part rows alike, the rounding of the targets' means decides between them."""
    df = table(spark, 500)
    grown = [{(r["grp"], r["model"], r["target"], r["repeat"]): (r["n"], r["see"]) for r in L.forest_sums(df.repartition(3), ["y", "z"], ["a", "b", "c"], "g", "id", folds=2, repeats=2, trees=5, depth=3, most_jobs=35, max_rows=most, together=2).collect()}
             for most in (0, 10_000)]
    assert grown[0].keys() == grown[1].keys() and all(grown[0][k] == pytest.approx(grown[1][k]) for k in grown[0])


def shuffled_records(spark):
    """Records that all stages so far have written to shuffles."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_sums_of_large_forests_go_by_parts_not_by_blocks(spark):
    """Each of twelve blocks passed on the sums of every node; a table of hundreds of blocks shuffled terabytes."""
    df = spark.range(0, 12_000, 1, 12).select("id", (F.col("id") % 4).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") - F.col("b"))
    before = shuffled_records(spark)
    sums = L.forest_sums(df, ["y"], ["a", "b"], "g", "id", folds=2, trees=10, depth=3, max_rows=6_000)
    assert {r["n"] for r in sums.groupBy("model").agg(F.sum("n").alias("n")).collect()} == {12_000}
    nodes = 2 * 2 * 10 * (1 + 2 + 4)
    assert nodes < shuffled_records(spark) - before < 4 * nodes


def test_few_comparisons_find_the_leaf(spark):
    random = np.random.default_rng(1)
    for _ in range(50):
        tree = L.Tree()
        for _ in range(3):
            some, tree.open = tree.open, []
            for node in some:
                tree.open += tree.split(node, int(random.integers(3)), int(random.integers(255)), bool(random.integers(2)), (random.normal(size=1), random.normal(size=1)))
        codes, want = random.integers(0, 256, (3, 200)).astype(np.uint8), []
        for row in codes.T:
            node = 0
            while tree.feature[node] >= 0:
                own = row[tree.feature[node]]
                node = tree.left[node] + int(not tree.missing_left[node] if own == L.MISSING else own > tree.code[node])
            want.append(node)
        assert (tree.place(codes) == want).all() and (tree.predict(codes) == np.asarray(tree.value)[want]).all()
