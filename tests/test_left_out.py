"""Leave one family out: equal to fits one by one, with its limits, pooled figures and the gap to grouped folds."""

import numpy as np
import pandas as pd
import pytest

from lithoscope.operators.models import leave_one_family_out


def test_equal_to_fits_one_by_one(spark):
    random = np.random.default_rng(6)
    n = 260
    p = pd.DataFrame({"id": np.arange(n), "g": random.choice(["a", "b", "c", "few", None], n, p=[0.5, 0.3, 0.14, 0.01, 0.05]), "x": random.normal(size=n), "z": random.normal(size=n), "fold": np.arange(n) % 3})
    p["y"] = 2 * p["x"] - p["z"] + (p["g"] == "b") * 1.0 + 0.3 * random.normal(size=n)
    p.loc[::29, "y"] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "id long, g string, x double, z double, fold int, y double")
    families, pooled = leave_one_family_out(df, {"one": ["x"], "both": ["x", "z"]}, ["y"], "g", "fold")
    got = {(r["set"], r["family"]): (r["n_train"], r["n_test"], r["skill"], r["r2"], r["spearman"]) for r in families.collect()}
    q = p[p["g"].notna() & p["y"].notna()]
    fit = lambda t, h, c: np.column_stack([np.ones(len(h)), h[c]]) @ np.linalg.lstsq(np.column_stack([np.ones(len(t)), t[c]]), t["y"], rcond=None)[0]
    good = [g for g, k in q["g"].value_counts().items() if k >= 5]
    assert {g for _, g in got} == set(good) and "few" not in good
    for name, c in {"one": ["x"], "both": ["x", "z"]}.items():
        sse = base = 0.0
        for g in good:
            t, h = q[q["g"] != g], q[q["g"] == g]
            e, b = ((h["y"] - fit(t, h, c)) ** 2).sum(), ((h["y"] - t["y"].mean()) ** 2).sum()
            sse, base = sse + e, base + b
            rho = pd.Series(fit(t, h, c)).rank().corr(h["y"].reset_index(drop=True).rank())
            assert got[name, g] == pytest.approx((len(t), len(h), 1 - e / b, 1 - e / ((h["y"] - h["y"].mean()) ** 2).sum(), rho))
        u = q[q["g"].isin(good)]
        spread = ((u["y"] - u["y"].mean()) ** 2).sum()
        folds = sum(((h["y"] - fit(q[q["fold"] != f], h, c)) ** 2).sum() for f, h in u.groupby("fold"))
        r = pooled.filter(f"`set` = '{name}'").first()
        assert (r["n"], r["skill_pooled"], r["r2_pooled"], r["r2_grouped_folds"], r["gap"]) == pytest.approx((len(u), 1 - sse / base, 1 - sse / spread, 1 - folds / spread, (sse - folds) / spread))
    with pytest.raises(ValueError, match="families"):
        leave_one_family_out(df, {"one": ["x"]}, ["y"], "g", "fold", most=2)
