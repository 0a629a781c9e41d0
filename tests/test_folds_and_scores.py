from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlift.operators import evaluate, folds, footprint

from helpers import rows


def test_folds_partition_the_keys(spark):
    df = folds.assign_folds(spark.range(3000).withColumnRenamed("id", "alert_id"))
    counts = Counter(r["fold"] for r in df.collect())
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == 3000
    assert max(counts.values()) - min(counts.values()) < 300


def grouped(spark):
    """One group with a third of the rows, some small ones and NULL."""
    keys = ["hot"] * 100 + [None] * 30 + [f"g{i % 60}" for i in range(170)]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "alert_id long, g string")


def test_a_row_without_key_is_an_error(spark):
    rows = spark.createDataFrame([(1,), (None,)], "alert_id long")
    with pytest.raises(Exception, match="alert_id is NULL"):
        folds.assign_folds(rows).collect()


def test_a_group_never_spans_folds(spark):
    out = folds.assign_group_folds(grouped(spark), "g", 3).collect()
    assert len(out) == 300 and len({r["alert_id"] for r in out}) == 300
    by_group = {}
    for r in out:
        by_group.setdefault(r["g"], set()).add(r["fold"])
    assert all(len(v) == 1 for v in by_group.values())
    assert len(by_group) == 62


def test_groups_are_dealt_round_robin_by_size(spark):
    out = folds.group_folds(grouped(spark), "g", 3).collect()
    ranked = sorted(out, key=lambda r: -r["size"])
    assert [r["size"] for r in ranked][:2] == [100, 30]
    assert [r["fold"] for r in ranked][:2] == [0, 1]
    counts = Counter(r["fold"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_lines_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(2017, 2, 500)
    y = 3 * x + rng.normal(0, 5, 500)
    df = spark.createDataFrame(
        [(i, "A", float(a), float(b), 1.0, i % 3) for i, (a, b) in enumerate(zip(x, y))],
        "alert_id long, airport string, x double, label double, c double, fold int",
    )
    out = folds.oof_lines(df.repartition(5), {"line": "x", "flat": "c"}).collect()
    assert Counter((r["alert_id"], r["model"]) for r in out).most_common(1)[0][1] == 1
    assert len(out) == 1000
    for i in range(3):
        train = np.arange(500) % 3 != i
        slope, base = np.polyfit(x[train], y[train], 1)
        for r in out:
            if r["fold"] == i:
                want = base + slope * x[r["alert_id"]] if r["model"] == "line" else y[train].mean()
                assert r["duration_pred"] == pytest.approx(want, abs=1e-6)


def long_predictions(spark):
    data = [
        (0, "b", 10.0, 12.0), (1, "b", 10.0, 8.0),
        (0, "a", 10.0, 8.0), (1, "a", 10.0, 12.0),
        (0, "c", 10.0, 10.0), (1, "c", 10.0, 20.0),
    ]
    return spark.createDataFrame(data, "alert_id long, model string, duration_true double, duration_pred double")


def test_metrics_and_ranking(spark):
    metrics = evaluate.oof_metrics(long_predictions(spark))
    got = {r["model"]: (r["mae"], r["rmse"]) for r in metrics.collect()}
    assert got["a"] == (2.0, 2.0) and got["c"] == (5.0, pytest.approx(np.sqrt(50)))
    assert [r["model"] for r in evaluate.leaderboard(metrics, ["c", "b", "a"]).collect()] == ["b", "a", "c"]
    # Same error: the model registered first wins.
    assert evaluate.best_model(metrics, ["c", "b", "a"]).first()["model"] == "b"
    assert evaluate.best_model(metrics, ["a", "b", "c"]).first()["model"] == "a"
    best = evaluate.best_predictions(long_predictions(spark), ["c", "b", "a"])
    assert {r["model"] for r in best.collect()} == {"b"}


def test_missing_runtime_is_zero(spark):
    log = spark.createDataFrame([("r", "a", 4.5)], "run_id string, model string, runtime_s double")
    report = evaluate.with_runtime(evaluate.oof_metrics(long_predictions(spark)), log)
    assert dict(rows(report.select("model", "runtime_s"))) == {"a": 4.5, "b": 0.0, "c": 0.0}


def test_airport_comes_by_key_or_not_at_all(spark):
    alerts = spark.createDataFrame([(1, None), (0, "A")], "alert_id long, airport string")
    preds = long_predictions(spark).where("model = 'a'")
    out = evaluate.with_airport(preds, alerts)
    assert dict(rows(out.select("alert_id", "airport"))) == {0: "A", 1: None}
    with pytest.raises(Exception, match="no alert with alert_id 1"):
        evaluate.with_airport(preds, alerts.where("alert_id = 0")).collect()


def test_top_features(spark):
    df = spark.createDataFrame([(f"f{i:02d}", float(i // 2)) for i in range(50)], "feature string, importance double")
    out = evaluate.top_features(df).collect()
    assert len(out) == 20 and [r["feature"] for r in out[:2]] == ["f48", "f49"]


# A published run, seconds in, energy and CO2 out.
RUN = {
    "rf_default": 44.62571500201011,
    "rf_tuned": 466.7354388470121,
    "linear_baseline": 204.07617287599714,
    "mlp_dense": 43.10187528500683,
}
WALL = 776.0580588409794
ENERGY = {
    "rf_default": (0.0005578214375251264, 3.123800050140708e-05),
    "rf_tuned": (0.005834192985587652, 0.00032671480719290846),
    "linear_baseline": (0.0025509521609499643, 0.000142853321013198),
    "mlp_dense": (0.0005387734410625853, 3.0171312699504778e-05),
    "_TOTAL_modeles_somme_temps": (0.009481740025125328, 0.0005309774414070183),
    "_TOTAL_temps_mur_run": (0.009700725735512242, 0.0005432406411886855),
}
SHARES = {
    "rf_default": 5.750306242377967,
    "rf_tuned": 60.14181974272237,
    "linear_baseline": 26.296508431441215,
    "mlp_dense": 5.553949835838088,
}


def run_tables(spark):
    log = spark.createDataFrame(
        [("run", m, s) for m, s in RUN.items()], "run_id string, model string, runtime_s double"
    )
    return log, spark.createDataFrame([("run", WALL)], "run_id string, wall_s double")


def test_footprint_reproduces_a_published_run(spark):
    out = {r["model"]: r for r in footprint.footprint(*run_tables(spark)).collect()}
    assert set(out) == set(ENERGY)
    for model, (kwh, kg) in ENERGY.items():
        assert out[model]["energy_kWh_estimated"] == pytest.approx(kwh, rel=1e-12)
        assert out[model]["kg_CO2eq_estimated"] == pytest.approx(kg, rel=1e-12)
        assert out[model]["power_assumed_W"] == 45.0
        assert out[model]["grid_g_CO2_per_kWh_assumed"] == 56.0


def test_shares_of_a_published_run(spark):
    out = dict(rows(footprint.runtime_share(*run_tables(spark)).select("model", "runtime_share_pct")))
    assert out == pytest.approx(SHARES, rel=1e-12)


def test_share_of_an_empty_run(spark):
    log = spark.createDataFrame([("r", "m", 0.0)], "run_id string, model string, runtime_s double")
    wall = spark.createDataFrame([("r", 0.0)], "run_id string, wall_s double")
    assert footprint.runtime_share(log, wall).first()["runtime_share_pct"] == 0.0
