import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertlift.operators import decision

from helpers import has_node, plan, rows

PREDS = "alert_id long, airport string, duration_true double, duration_pred double"


def frame(spark, data):
    return spark.createDataFrame(
        [(i, a, t, p) for i, (a, t, p) in enumerate(data)], PREDS
    )


def searched(pred, sigma, p, cap):
    """The minute by search over the probabilities of all 121 minutes."""
    for t in range(121):
        if 0.5 * (1 + math.erf((t - pred) / sigma / math.sqrt(2))) >= p:
            return min(t, cap)
    return min(121, cap)


LEVELS = decision.REPORT_LEVELS


@settings(max_examples=8, deadline=None)
@given(
    preds=st.lists(st.floats(-50, 300, allow_nan=False), min_size=1, max_size=80),
    sigma=st.sampled_from([0.7, 5.3, 15.29, 60.1]),
)
def test_closed_form_equals_the_search(spark, preds, sigma):
    df = spark.createDataFrame([(float(p),) for p in preds], "p double")
    minutes = [
        decision.lift_minute(F.col("p"), F.lit(sigma), level / 100, cap).alias(f"m{level}_{cap}")
        for level in LEVELS
        for cap in (120, 121)
    ]
    for r in df.select("p", *minutes).collect():
        previous = 0
        for level in LEVELS:
            for cap in (120, 121):
                assert r[f"m{level}_{cap}"] == searched(r["p"], sigma, level / 100, cap)
            assert r[f"m{level}_120"] >= previous
            previous = r[f"m{level}_120"]


def test_lift_minute_edges(spark):
    df = spark.createDataFrame([(-80.0,), (500.0,), (1e30,), (None,), (float("nan"),)], "p double")
    for cap in (120, 121):
        got = [r[0] for r in df.select(decision.lift_minute(F.col("p"), F.lit(10.0), 0.95, cap)).collect()]
        assert got == [0, cap, cap, None, None]


def test_sigma(spark):
    df = frame(spark, [("A", 10.0, 8.0), ("A", 10.0, 12.0), ("B", 5.0, 5.0)])
    assert decision.residual_sigma(df).first()[0] == pytest.approx(np.std([2, -2, 0]), abs=1e-9)
    by = dict(rows(decision.residual_sigma(df, ["airport"])))
    # One alert, or none wrong: a spread of zero counts as one minute.
    assert by == {"A": 2.0, "B": 1.0}
    assert decision.residual_sigma(df.drop("duration_true")).first()[0] == 27.0


def reference_panel(data, confidence=0.95):
    """Key figures the slow way, for one scope."""
    true = np.array([t for _, t, _ in data])
    pred = np.array([p for _, _, p in data])
    sigma = round(float(np.std(true - pred)), 9) or 1.0
    minute = np.array([searched(p, sigma, confidence, 120) for p in pred])
    gain = true + 30 - minute
    return {
        "n_alerts": len(data),
        "mae": np.abs(true - pred).mean(),
        "sigma": sigma,
        "mean_gain": gain.mean(),
        "median_gain": np.median(gain),
        "n_earlier": int((gain > 0).sum()),
        "median_before": np.median(true + 30),
        "median_after": np.median(minute),
    }


def sample(n=400):
    rng = np.random.default_rng(11)
    airports = ["A", "A", "A", "B", None]
    return [
        (airports[i % 5], float(t), float(t + e))
        for i, (t, e) in enumerate(zip(rng.gamma(2, 20, n), rng.normal(0, 12, n)))
    ]


def test_panel_with_own_sigma_equals_filtering_first(spark):
    data = sample()
    panel = {
        (r["scope"], r["airport"]): r
        for r in decision.kpi_panel(frame(spark, data), sigma_scope="group").collect()
    }
    assert set(panel) == {("global", None), ("group", "A"), ("group", "B"), ("group", None)}
    for (scope, airport), row in panel.items():
        part = data if scope == "global" else [d for d in data if d[0] == airport]
        for name, value in reference_panel(part).items():
            assert row[name] == pytest.approx(value, rel=1e-9), (scope, airport, name)


def test_panel_with_one_sigma(spark):
    data = sample()
    panel = decision.kpi_panel(frame(spark, data)).collect()
    assert len({r["sigma"] for r in panel}) == 1
    whole = next(r for r in panel if r["scope"] == "global")
    for name, value in reference_panel(data).items():
        assert whole[name] == pytest.approx(value, rel=1e-9)


def test_result_does_not_depend_on_partitioning(spark):
    df = frame(spark, sample())
    one = rows(decision.kpi_panel(df.repartition(1)).select("scope", "airport", "n_earlier", "median_after"), "scope", "airport")
    two = rows(decision.kpi_panel(df.repartition(9)).select("scope", "airport", "n_earlier", "median_after"), "scope", "airport")
    assert one == two


def test_tables_over_levels(spark):
    data = sample(101)
    df = frame(spark, data)
    sigma = decision.residual_sigma(df).first()[0]
    table = dict(rows(decision.confidence_table(df), "pct"))
    for level in LEVELS:
        minutes = [searched(p, sigma, level / 100, 120) for _, _, p in data]
        assert table[level] == int(np.median(minutes))
    curve = decision.policy_curve(df, sigma_scope="global").where("scope = 'global'")
    for _, _, level, minute in curve.collect():
        assert minute == np.median([searched(p, sigma, level / 100, 121) for _, _, p in data])


def test_report_cuts_and_curve_keeps_half_minutes(spark):
    df = spark.createDataFrame([(0, "A", 10.0, 10.0), (1, "A", 21.0, 21.0)], PREDS)
    # No error at all, so sigma is 1 and the minutes are 11.x and 22.x rounded up.
    report = dict(rows(decision.confidence_table(df, [95])))
    curve = decision.policy_curve(df, levels=[95]).where("scope = 'global'").first()
    assert curve["median_minute"] == 17.5 and report[95] == 17


def test_curve_shows_later_than_horizon(spark):
    df = frame(spark, [("A", 300.0, 300.0)])
    assert decision.policy_curve(df, levels=[95]).first()["median_minute"] == 121
    assert decision.confidence_table(df, [95]).first()["median_minute"] == 120


@pytest.mark.parametrize("n", [4, 5])
def test_median_curve_equals_the_matrix(spark, n):
    df = frame(spark, sample()[:n])
    matrix = decision.probability_matrix(df)
    want = dict(rows(matrix.groupBy("minute").agg(F.median("p_over"))))
    got = dict(rows(decision.median_probability_curve(df)))
    assert len(got) == 121
    for t in range(121):
        assert got[t] == pytest.approx(want[t], abs=1e-12)


def test_matrix_rises_with_the_minute(spark):
    df = frame(spark, sample()[:20])
    by_alert = {}
    for r in decision.probability_matrix(df).orderBy("alert_id", "minute").collect():
        by_alert.setdefault(r["alert_id"], []).append(r["p_over"])
        z = (r["minute"] - r["duration_pred"]) / r["sigma"]
        assert r["p_over"] == pytest.approx(NormalDist().cdf(z), abs=1e-12)
    assert all(v == sorted(v) and len(v) == 121 for v in by_alert.values())


def test_verdict(spark):
    kpis = spark.createDataFrame(
        [(2.0, 3.0), (-1.0, 12.0), (0.0, 10.0), (None, 1.0)], "median_gain double, mae double"
    )
    got = rows(decision.gain_verdict(kpis).select("verdict", "mae_below_10"))
    assert got == [("improvement", 1), ("no improvement", 0), ("neutral", 0), (None, 1)]


def test_identities_hold(spark):
    checks = decision.gain_identity(decision.gains(decision.with_sigma(frame(spark, sample())))).first()
    assert checks["before_holds"] == 1 and checks["gain_holds"] == 1


def test_plans_stay_in_generated_code(spark, sf_dir):
    from alertlift.plans.queries import QUERIES

    for name in ("prob_at_minute", "gain_per_alert", "confidence_table", "kpi_by_airport_own_sigma"):
        text = plan(QUERIES[name](spark, sf_dir))
        for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct"):
            assert not has_node(text, node), (name, node)


def test_levels_do_not_copy_the_table(spark):
    text = plan(decision.confidence_table(frame(spark, sample())))
    assert "Join" not in text and "Expand" not in text
