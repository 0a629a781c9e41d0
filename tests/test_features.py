import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlift.operators import features, storms, trends
from alertlift.plans import queries
from alertlift.sources import schema

from helpers import has_node, plan, rows


def alert_frame(spark):
    data = [
        # airport, minutes, amplitude, rate, lat_delta, lon_delta, lat_std, lon_std, hour, n, type
        ("A", 10.0, 1.0, 0.5, 3.0, 4.0, 0.1, 0.2, 0, 5.0, 0),
        ("A", 20.0, 2.0, None, 0.0, 0.0, 0.3, 0.2, 6, 7.0, 1),
        ("B", 30.0, 3.0, 2.5, 6.0, 8.0, 0.2, None, 12, 9.0, 1),
        (None, 40.0, 100.0, 3.5, 1.0, 0.0, 0.4, 0.1, 18, 1.0, 0),
        ("B", 50.0, None, 9.5, 1.0, 1.0, 0.5, 0.5, 23, 3.0, None),
    ]
    names = (
        "airport string, duration_minutes double, mean_amplitude double, "
        "lightning_per_minute double, lat_delta double, lon_delta double, lat_std double, "
        "lon_std double, start_hour int, n_lightnings double, storm_type int"
    )
    return spark.createDataFrame(data, names)


def test_derived_columns(spark):
    out = features.storm_features(alert_frame(spark)).orderBy("duration_minutes").collect()
    assert out[0]["speed"] == 5.0
    assert out[0]["storm_surface"] == pytest.approx(0.02)
    assert out[2]["storm_surface"] is None
    assert out[1]["hour_sin"] == pytest.approx(1.0)
    assert out[0]["log_n_lightnings"] == pytest.approx(math.log(6))
    # The log is taken before the clip.
    assert out[4]["log_lightning_per_minute"] == pytest.approx(math.log(10.5))


@pytest.mark.parametrize("approx", [False, True])
def test_clip_keeps_missing_and_caps_at_the_quantile(spark, approx):
    out = features.clip_high(alert_frame(spark), approx=approx).orderBy("duration_minutes").collect()
    assert out[4]["mean_amplitude"] is None
    assert out[1]["lightning_per_minute"] is None
    limit = 100.0 if approx else float(np.quantile([1.0, 2.0, 3.0, 100.0], 0.99))
    assert out[3]["mean_amplitude"] == pytest.approx(limit)


def test_z_scores_use_the_population_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    out = features.z_scores(df, ["a", "b"]).orderBy("a").collect()
    values = np.array([1.0, 2.0, 6.0])
    want = (values - values.mean()) / values.std()
    assert [r["z_a"] for r in out] == pytest.approx(list(want))
    assert [r["z_b"] for r in out] == [0.0, 0.0, 0.0]


def test_one_hot_keeps_every_level(spark):
    out = features.one_hot(alert_frame(spark).select("airport", "duration_minutes"), "airport")
    assert out.columns == ["duration_minutes", "airport_A", "airport_B"]
    assert rows(out, "duration_minutes")[3] == (40.0, 0, 0)
    unseen = features.one_hot(alert_frame(spark).select("airport"), "airport", levels=["Z"])
    assert {r[0] for r in unseen.collect()} == {0}


def test_airport_filter(spark):
    assert features.only_airport(alert_frame(spark), "A").count() == 2
    assert features.only_airport(alert_frame(spark)).count() == 5
    assert {r[0] for r in features.airports(alert_frame(spark)).collect()} == {"A", "B", None}


def test_trends_keep_the_missing_airport(spark):
    out = trends.airport_trends(alert_frame(spark))
    got = rows(out.select("airport", "n_alertes", "duration_minutes_mediane", "duration_minutes_moyenne"))
    assert got == [("A", 2, 15.0, 15.0), ("B", 2, 40.0, 40.0), (None, 1, 40.0, 40.0)]
    assert "storm_type_moyenne" not in out.columns
    assert "mean_amplitude_moyenne" in out.columns


def test_storm_mix_drops_missing_and_fills_zero(spark):
    out = trends.storm_type_share(alert_frame(spark), [0, 1])
    assert rows(out, "airport") == [("A", 50.0, 50.0), ("B", 0.0, 100.0)]
    assert trends.present_types(alert_frame(spark)) == [0, 1]


def test_half_shares_round_to_even(spark):
    data = [("A", 0)] * 1 + [("A", 1)] * 799
    df = spark.createDataFrame(data, "airport string, storm_type int")
    row = trends.storm_type_share(df, [0, 1]).first()
    assert row["0"] == 0.12 and row["1"] == 99.88


def test_statistics_are_broadcast_not_multiplied(spark, sf_dir):
    from alertlift.plans import views

    alerts = features.add_speed(views.alerts(spark, sf_dir))
    text = plan(features.z_scores(alerts))
    assert has_node(text, "BroadcastNestedLoopJoin") and not has_node(text, "CartesianProduct")


def test_column_choice(spark):
    df = alert_frame(spark)
    assert schema.target_column(df.columns) == "duration_minutes"
    assert schema.target_column(["duration_minutes", "duration_total_minutes"]) == "duration_total_minutes"
    with pytest.raises(ValueError):
        schema.target_column(["x"])
    assert schema.allowed_features(df) == (["n_lightnings", "mean_amplitude", "start_hour"], ["airport"])
    assert "label" in schema.with_label(df, ["storm_type"]).columns
    assert schema.trend_columns(df)[:2] == ["mean_amplitude", "lightning_per_minute"]
    wide = df.select("duration_minutes", *[F.lit(1.0).alias(f"c{i}") for i in range(20)], F.lit(1).alias("Unnamed: 0"))
    assert schema.trend_columns(wide) == [f"c{i}" for i in range(12)]


def test_cluster_columns_are_found_by_name_and_content(spark):
    df = spark.createDataFrame(
        [(0, "x", 0.5, 1, 3, 0.1), (1, "y", 1.5, 1, 4, 0.2), (2, "x", 2.5, 1, 4, 0.3)],
        "cluster int, kmeans string, cluster_depth double, storm_type int, cluster_id int, "
        "cluster_proba double",
    )
    assert schema.cluster_score_columns(df) == ["cluster_proba"]
    # kmeans and cluster_id have two values each; the first of them wins.
    assert schema.pick_cluster_label(df) == "kmeans"
    assert schema.pick_cluster_label(df.select("storm_type")) is None
    assert schema.pick_cluster_label(spark.range(3)) is None
    numeric, categorical = schema.with_cluster_columns(df)
    assert (numeric, categorical) == (["cluster_proba"], ["kmeans"])
    assert dict(schema.cast_categoricals(df, ["cluster"]).dtypes)["cluster"] == "string"
    gaps = spark.createDataFrame([("A",), (None,)], "airport string")
    assert {r[0] for r in schema.cast_categoricals(gaps, ["airport"]).collect()} == {"A", "nan"}


def test_incomplete_rows_leave_before_clustering(spark):
    df = features.add_speed(alert_frame(spark))
    kept = features.drop_incomplete(df, ["mean_amplitude", "lon_std"])
    assert kept.count() == 3


def blobs(spark, n=600):
    rng = np.random.default_rng(3)
    centres = {0: (-5, 0), 1: (5, 0), 2: (0, 40)}
    data = []
    for i in range(n):
        c = 0 if i % 6 < 3 else (1 if i % 6 < 5 else 2)
        x, y = rng.normal(centres[c], 0.5)
        data.append((i, c, float(x), float(y)))
    return spark.createDataFrame(data, "id int, truth int, x double, y double")


def test_storm_types_are_numbered_by_size_and_nearest(spark):
    df = blobs(spark)
    typed = storms.type_storms(df, restarts=3, columns=["x", "y"])
    out = typed.alerts.select("truth", "storm_type", "pca_1", "pca_2").collect()
    assert all(r["truth"] == r["storm_type"] for r in out)
    again = storms.type_storms(df.repartition(3), restarts=3, columns=["x", "y"])
    assert sorted(r[0] for r in again.alerts.select("storm_type").collect()) == sorted(
        r["storm_type"] for r in out
    )


def test_every_row_is_with_its_nearest_centre(spark, sf_dir):
    from alertlift.plans import views
    from alertlift.sources.staging import stage

    vectors = stage(storms.scaled_vectors(features.add_speed(views.alerts(spark, sf_dir))))
    model = storms.fit_kmeans(vectors, restarts=2)
    order = storms.size_order(model)
    centres = {order[i]: c for i, c in enumerate(model.clusterCenters())}
    assert sorted(order) == [0, 1, 2]
    sizes = [0, 0, 0]
    for r in storms.label_storms(vectors, model, order).select("z", "storm_type").collect():
        z = r["z"].toArray()
        distances = {t: ((z - c) ** 2).sum() for t, c in centres.items()}
        assert distances[r["storm_type"]] <= min(distances.values()) + 1e-9
        sizes[r["storm_type"]] += 1
    assert sizes == sorted(sizes, reverse=True)


def test_projection_equals_numpy(spark, sf_dir):
    from alertlift.plans import views
    from alertlift.sources.staging import stage

    vectors = stage(storms.scaled_vectors(features.add_speed(views.alerts(spark, sf_dir))))
    model = storms.fit_pca(vectors)
    out = storms.project_storms(vectors, model).select("z", "pca_1", "pca_2").collect()
    z = np.array([r["z"].toArray() for r in out])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    _, s, axes = np.linalg.svd(z, full_matrices=False)
    for j in range(2):
        axis = axes[j] * (1 if axes[j][np.argmax(np.abs(axes[j]))] > 0 else -1)
        assert np.allclose(z @ axis, [r[f"pca_{j + 1}"] for r in out], atol=1e-6)
    first, second = np.array([[r["pca_1"], r["pca_2"]] for r in out]).T
    assert abs(np.corrcoef(first, second)[0, 1]) < 1e-6 and first.var() >= second.var()


def test_starts_see_equal_vectors_once_and_sizes_count_alerts(spark):
    rows = [(float(x), float(y)) for x, y, n in ((0, 0, 2), (9, 0, 7), (0, 9, 4), (1, 0, 1), (0, 8, 1)) for _ in range(n)]
    vectors = storms.scaled_vectors(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    model = storms.fit_kmeans(vectors, restarts=2)
    assert sorted(model.alert_counts) == [3, 5, 7] and sum(model.summary.clusterSizes) == 5
    assert model.alert_counts[storms.size_order(model).index(0)] == 7


def test_storm_check_aggregates_and_joins_the_lines_once(spark, sf_dir, monkeypatch):
    read = []
    scaled = storms.scaled_vectors
    monkeypatch.setattr(storms, "scaled_vectors", lambda df, *rest: read.append(plan(df)) or scaled(df, *rest))
    told = queries.storm_types_check(spark, sf_dir).first()
    assert told["n_types"] == 3 and told["n_stray"] == 0
    assert len(read) == 1 and "lineitem" not in read[0] and not has_node(read[0], "HashAggregate")
