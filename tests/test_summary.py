from oracle import SMALL
from pyspark.sql import Row

from lithoscope.operators import stats
from lithoscope.plans.summaries import _told, summary_text


def test_findings_follow_the_tables():
    funnel = [Row(step_no=0, step="All", n=10), Row(step_no=1, step="x", n=7), Row(step_no=2, step="y", n=4)]
    said = _told(funnel, [Row(factor="f", target="t", eta2=0.12345, n=9)], [Row(feature="a", target="b", rho=-0.5, n=8)], [Row(term="a", response="b", tier="M2", beta=1.5, ci_lo=1.0, ci_hi=2.0)])
    assert said.startswith("Of 10 records 4 pass all 2 checks.") and "0.123" in said and "b falls most with a (rho = -0.500, n = 8)" in said and "(1.50, 95 % from 1.00 to 2.00)" in said
    assert _told([], [], [], []) == ""


def test_correlations_are_computed_once(spark, monkeypatch):
    calls, own = [], stats.rank_correlations
    monkeypatch.setattr(stats, "rank_correlations", lambda *a, **k: calls.append(a) or own(*a, **k))
    texts = {r.title: r.text for r in summary_text(spark, SMALL).collect()}
    assert len(calls) == 1 and "l_quantity" in texts["Correlations"] and "rho = " in texts["Findings"]
