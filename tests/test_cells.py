"""Structure texts: tokens, loops, operations, cells, orbits, damage."""

import numpy as np
import pytest

from lithoscope.sources import cells

QUARTZ = """data_quartz
# a comment
_cell_length_a 4.913(1)
_cell_length_b 4.913
_cell_length_c 5.405
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 120
loop_
_space_group_symop_operation_xyz
'x,y,z'
'-y,x-y,z+1/3'
'-x+y,-x,z+2/3'
'y,x,-z'
"x-y,-y,-z+2/3"
'-x,-x+y,-z+1/3'
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Si 0.4697 0 0.3333
O1 0.4135 0.2669 0.1191
"""


def test_quartz():
    s = cells.structure(QUARTZ)
    assert s["status"] == "ok" and s["n_operations"] == 6 and s["volume"] == pytest.approx(4.913**2 * 5.405 * np.sqrt(3) / 2)
    assert [sum(x["element"] == e for x in s["sites"]) for e in ("Si", "O")] == [3, 6]  # on the twofold axes, and in general places
    edges = np.array(s["cell"])
    assert np.linalg.norm(edges, axis=1) == pytest.approx([4.913, 4.913, 5.405]) and edges[0] @ edges[1] == pytest.approx(-0.5 * 4.913**2)


def test_tokens_and_loops():
    text = "_a 'it's 1'\n_B \"x y\"\n_c\n;first\n_d loop_\n;\nloop_ _e _f 1 2 'three' 4 # 5 6\n_g ?\ndata_next 7"
    assert cells.columns_of(text) == {"_a": ["it's 1"], "_b": ["x y"], "_c": ["first\n_d loop_"], "_e": ["1", "three"], "_f": ["2", "4"], "_g": ["?"]}
    assert cells.columns_of("") == {} and cells.columns_of("loop_\n_x\n") == {"_x": []}
    assert cells.number("1.25(3)") == 1.25 and cells.number("-.5") == -0.5 and np.isnan(cells.number("?")) and np.isnan(cells.number("1.2.3"))


def test_operations():
    rotation, shift = cells.operation(" -Y, x-y ,1/2+z")
    assert rotation.tolist() == [[0, -1, 0], [1, -1, 0], [0, 0, 1]] and shift.tolist() == [0, 0, 0.5]
    assert cells.operation("0.5*x,2y,z-0.25")[0].diagonal().tolist() == [0.5, 2, 1]
    for bad in ("x,y", "x,y,w", "x,y,", "x,y,z+", "x,,z"):
        with pytest.raises(ValueError):
            cells.operation(bad)


def test_damage_is_told(spark):
    texts = [None, "", "no structure", QUARTZ.replace("_cell_angle_gamma 120", "_cell_angle_gamma 180"), QUARTZ.replace("'-y,x-y,z+1/3'", "'-y,x-y'"), QUARTZ.replace("O1 0.4135 0.2669 0.1191", "O1 0.4135 ? 0.1191"),
             QUARTZ.replace("O1 0.4135 0.2669 0.1191", "O1 0.4135"), QUARTZ.split("loop_\n_atom")[0], QUARTZ.replace("O1", "Qx"), QUARTZ.replace("_cell_angle_alpha 90", "_cell_angle_alpha 20")]
    df = spark.createDataFrame(list(enumerate(texts)), "structure int, text string")
    got = {r["structure"]: r["s"] for r in cells.with_structure(df, "text", "s").collect()}
    assert [got[i]["status"] for i in range(10)] == ["no cell", "no cell", "no cell", "no cell", "operation '-y,x-y'", "site O1", "sites cut off", "no sites", "site Qx", "flat cell"]
    assert len(got[5]["sites"]) == 3 and got[7]["sites"] is None and cells.with_structure(df.limit(0)).count() == 0
    shared = cells.structure(QUARTZ.replace("_z\nSi", "_z\n_atom_site_occupancy\nSi").replace("Si 0.4697 0 0.3333", "Si 0.4697 0 0.3333 .\nGe1 0.4697 0 0.3333 0.25(1)").replace("0.1191", "0.1191 1"))
    assert [x["occupancy"] for x in shared["sites"]] == [1.0] * 3 + [0.25] * 3 + [1.0] * 6
