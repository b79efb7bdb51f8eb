"""Files, repairs, sinks and the incremental table on hand-made cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lithoscope.operators.matching import ambiguous_ids, ambiguous_names, kept_and_failed, merge_records, ordered, pick_first
from lithoscope.sources import files, sinks
from lithoscope.streaming import incremental

CIF = """data_x
 _space_group_symop_operation_xyz
loop_
_atom_site_label
_atom_site_x
# Ba9 0 0 0
  Ba1 0.1 0.2 0.3
Wat1 0 0 0
Qx9 0 0 0
short 1
loop_
Ba2 0 0 0
at 5 GPa
END
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin-1"))


def test_spectra(spark, tmp_path):
    body = "##NAMES=Quartz\n##ideal chemistry = SiO_2_\n##IDEAL CHEMISTRY=Si=O\n\n300, 2.5\njunk\n100.5, 1e3\n##LATE=1\n1.2.3, 4\n200 ,-1\n##END=\n"
    write(tmp_path / "r/excellent_oriented/Quartz A__r01__Raman__532__..Raman_Data_Processed..txt", body)
    write(tmp_path / "r/fair_unoriented/Quartz__R02.TXT", body)  # no processed data
    write(tmp_path / "r/other/Quartz__R03__x__532__Raman_Data_Processed.txt", body)  # no tier
    write(tmp_path / "r/poor_unoriented/B__Raman_Data_Processed.txt", "\n")
    rows = {r["mineral"]: r for r in files.read_spectra(spark, f"file://{tmp_path}/r").collect()}
    assert set(rows) == {"Quartz A", "B"}
    q = rows["Quartz A"]
    assert (q.ident, q.wavelength, q.mineral_norm, q.quality, q.orientation, q.tier_rank) == ("R01", "532", "quartza", "excellent", "oriented", 1)
    assert [tuple(p) for p in q.points] == [(100.5, 1000.0), (200.0, -1.0), (300.0, 2.5)]
    assert (q.ideal_chemistry, q.measured_chemistry) == ("Si=O", "")
    assert rows["B"].points == [] and rows["B"].ident == "RAMAN_DATA_PROCESSED"


def test_spectrum_order(spark, tmp_path):
    """Quality goes before orientation, orientation before the laser, that before the name."""
    for folder, laser in (("poor_unoriented", 532), ("excellent_oriented", 780), ("fair_unoriented", 532), ("excellent_oriented", 532), ("unrated_oriented", 532)):
        write(tmp_path / f"o/{folder}/Q__R{laser}__Raman__{laser}__Raman_Data_Processed.txt", "1, 2\n")
    rows = files.read_spectra(spark, f"file://{tmp_path}/o").orderBy(*files.spectrum_order()).collect()
    assert [(r.quality, r.orientation, r.wavelength) for r in rows] == [
        ("excellent", "oriented", "532"), ("excellent", "oriented", "780"), ("fair", "unoriented", "532"), ("unrated", "oriented", "532"), ("poor", "unoriented", "532")]


def test_structures(spark, tmp_path):
    write(tmp_path / "c/Forst__0012.cif", CIF)
    write(tmp_path / "c/Forst.cif", "kbarrier\n")
    a, b = files.read_structures(spark, f"file://{tmp_path}/c").orderBy("record").collect()
    assert (a.record, a.is_high_pt, a.n_unknown_labels, b.record, b.is_high_pt) == (12, True, 1, 10**9, False)
    names = spark.createDataFrame([("A__b__7.cif",), ("A.cif",), ("x.y__1.cif",), ("__2.cif",)], "f string").select(files.structure_name(F.col("f"))).collect()
    assert [r[0] for r in names] == ["A__b", "A", "x.y", ""]
    lines = a.repaired.split("\n")
    assert lines[1] == " _symmetry_equiv_pos_as_xyz" and "END" not in lines
    assert lines[5:11] == ["# Ba9 0 0 0", "  Ba 0.1 0.2 0.3", "O 0 0 0", "X 0 0 0", "short 1", "loop_"] and lines[11] == "Ba2 0 0 0"


def test_result_table(spark, tmp_path):
    write(tmp_path / "d.csv", "mineral,snr,ok,n\nq,inf,True,1\nr,NaN,nonsense,2\ns,3.5,0,3\n")
    schema = StructType([StructField("mineral", StringType()), StructField("snr", DoubleType()), StructField("ok", BooleanType()), StructField("n", DoubleType())])
    rows = files.read_table(spark, f"file://{tmp_path}/d.csv", schema, ["mineral"], ["n"], F.col("ok")).collect()
    assert [(r.snr, r.ok, r.n) for r in rows] == [(None, True, 1.0), (None, True, 2.0), (3.5, False, None)]
    with pytest.raises(ValueError):
        files.read_table(spark, "x", schema, ["absent"])


def test_matching(spark):
    df = spark.createDataFrame([("R1", "a"), ("R1", "b"), ("R2", "a"), ("", "c"), ("", "d"), (None, "e"), ("R1", "a")], "ident string, name string")
    bad = ambiguous_ids(df, "ident", "name")
    assert [(r.ident, r.names) for r in bad.collect()] == [("R1", ["a", "b"])]
    assert sorted(tuple(r) for r in ambiguous_names(bad, "ident", "name").collect()) == [("a", "R1: a, b"), ("b", "R1: a, b")]
    cand = spark.createDataFrame([("m", 1, False, "bad"), ("m", 2, True, ""), ("m", 3, True, ""), ("n", 2, False, "late"), ("n", 1, None, "first")], "key string, p int, ok boolean, err string")
    picks = pick_first(cand, "key", F.col("ok"), [F.col("p")], ["p"], F.col("err"))
    got = {r.key: r for r in picks.collect()}
    assert got["m"].picked.p == 2 and got["m"].error is None and got["n"].picked is None and got["n"].error == "first"
    keys = spark.createDataFrame([("m",), ("n",), ("o",), ("m",)], "key string")
    out = {r.key: r.failure for r in kept_and_failed(keys, "key", [("structure", picks)]).collect()}
    assert out["m"] is None and out["n"].detail == "first" and out["o"].detail == "none" and len(out) == 3
    both = picks.select("key", F.struct(F.lit(1).alias("x")).alias("l"), F.struct(F.lit(2).alias("x")).alias("r"))
    with pytest.raises(ValueError):
        merge_records(both, ["l"], ["r"], {})
    assert ordered(merge_records(both, ["l"], ["r"], {"r.x": "y"}), ["y"]).columns == ["y", "key", "x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "why")], "key string, failure string")
    sinks.write_kept_and_failed(df, f"file://{tmp_path}/o", "key")
    assert [r.key for r in sinks.read_part(spark, f"file://{tmp_path}/o", "failed").collect()] == ["b"]
    table = spark.createDataFrame([("f", "t", 1.239), ("f", "u", None)], "feature string, target string, v double")
    assert sinks.wide(table, "feature", "target", "v", ["u", "t", "w"]).collect()[0][:] == ("f", None, 1.239, None)
    assert sinks.markdown(table).splitlines()[2:] == ["| f | t | 1.24 |", "| f | u |  |"]
    with pytest.raises(ValueError):
        sinks.markdown(table, 1)
    sinks.write_manifest(spark, f"file://{tmp_path}/m", {"a": 1}, {"kept": 2})
    assert '"kept": 2' in spark.read.text(f"file://{tmp_path}/m").first()[0]


def test_incremental_equals_batch(spark, tmp_path):
    rows = [("q", 3, "c"), ("q", 1, "b"), ("r", 2, "a"), ("q", 1, "a"), ("s", 9, "z")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "mineral string, tier int, file string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    source = f"file://{tmp_path}/in/*"
    stream = spark.readStream.schema("mineral string, tier int, file string").option("maxFilesPerTrigger", 1).parquet(source)
    order = [F.col("tier"), F.col("file")]
    incremental.keep_best(stream, "mineral", order, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    batch = incremental.best_of(spark.read.parquet(source), "mineral", order)
    last = incremental.version(spark, f"file://{tmp_path}/out", len(rows) - 1)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect())) == [("q", 1, "a"), ("r", 2, "a"), ("s", 9, "z")]
