import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from alertlift.operators import training as tr
from alertlift.operators.folds import assign_folds, assign_group_folds
from alertlift.plans import queries, views, workflow
from alertlift.plans.queries import training_rows
from alertlift.sources.writer import write_table

from helpers import rows

SMALL = tr.ModelSpec("rf", lambda: tr.forest(numTrees=5, maxDepth=4))


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return training_rows(spark, sf_dir)


def one_per_row(out, table):
    keys = [r[0] for r in out.select("alert_id").collect()]
    assert len(keys) == len(set(keys)) == table.count()


def test_least_squares_out_of_fold_equals_numpy(spark, table):
    numeric = ["n_lightnings", "mean_amplitude", "mean_dist"]
    out = tr.out_of_fold(table, tr.main_models()[0], numeric)
    one_per_row(out, table)
    data = table.select("alert_id", "fold", "label", *numeric).toPandas()
    got = out.toPandas().set_index("alert_id")["duration_pred"]
    for i in range(3):
        train, held = data[data.fold != i], data[data.fold == i]
        design = np.c_[np.ones(len(train)), train[numeric]]
        beta, *_ = np.linalg.lstsq(design, train.label, rcond=None)
        want = np.c_[np.ones(len(held)), held[numeric]] @ beta
        assert np.allclose(got.loc[held.alert_id], want, atol=1e-6)


def test_a_model_never_sees_its_fold(spark, table):
    """Labels of one fold are replaced by nonsense; its predictions stay."""
    numeric = ["n_lightnings", "mean_amplitude"]
    spec = tr.main_models()[0]
    broken = table.withColumn("label", F.when(F.col("fold") == 1, 1e6).otherwise(F.col("label")))
    first = rows(tr.out_of_fold(table, spec, numeric).where("fold = 1").select("alert_id", F.round("duration_pred", 6)), "alert_id")
    second = rows(tr.out_of_fold(broken, spec, numeric).where("fold = 1").select("alert_id", F.round("duration_pred", 6)), "alert_id")
    assert first == second


def test_unseen_and_missing_levels_give_zeros(spark):
    train = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("A", 3.0)], "airport string, x double")
    held = spark.createDataFrame([("Z", 1.0), (None, 1.0), ("B", 1.0), ("A", 1.0)], "airport string, x double")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=tr.encoder(["x"], ["airport"])).fit(train)
    got = [list(r["features"].toArray()) for r in model.transform(held).collect()]
    assert got == [[1, 0, 0], [1, 0, 0], [1, 0, 1], [1, 1, 0]]


def test_nested_search_and_boosting(spark, table):
    grid = {"maxDepth": [2, 4], "minInstancesPerNode": [1, 2]}
    tuned = tr.ModelSpec("t", lambda: tr.forest(numTrees=3), grid=grid, draws=2, inner_folds=2)
    out = tr.out_of_fold(table, tuned, views.NUMERIC, ["airport"])
    one_per_row(out, table)
    for loss in ("squared", "absolute"):
        spec = tr.ModelSpec("g", lambda loss=loss: tr.boosted(maxIter=3, lossType=loss))
        one_per_row(tr.out_of_fold(table, spec, views.NUMERIC), table)


def test_inner_folds_differ_from_outer_folds(spark, table):
    train = table.where("fold <> 0")
    inner = tr.with_inner_folds(train, tr.ModelSpec("x", tr.forest, grid={"maxDepth": [2]}, draws=1))
    pairs = {(r[0], r[1]) for r in inner.select("fold", "inner_fold").distinct().collect()}
    assert pairs == {(f, i) for f in (1, 2) for i in range(3)}


def test_groups_stay_together_in_both_loops(spark, sf_dir):
    rows_ = views.labelled(spark, sf_dir).drop("fold")
    outer = assign_group_folds(rows_, "alert_airport_id")
    spans = outer.groupBy("alert_airport_id").agg(F.count_distinct("fold").alias("n"))
    assert spans.where("n > 1").count() == 0
    spec = tr.ModelSpec("x", tr.forest, grid={"maxDepth": [2]}, draws=1)
    inner = tr.with_inner_folds(outer.where("fold <> 0"), spec, group="alert_airport_id")
    spans = inner.groupBy("alert_airport_id").agg(F.count_distinct("inner_fold").alias("n"))
    assert spans.where("n > 1").count() == 0


def test_grid_draws_are_distinct_and_repeatable():
    draws = tr.draw_grid(tr.FOREST_GRID, 12)
    assert len(draws) == 12 == len({tuple(sorted(d.items(), key=str)) for d in draws})
    assert draws == tr.draw_grid(tr.FOREST_GRID, 12)
    assert len(tr.draw_grid({"maxDepth": [1, 2]}, 10)) == 2


def test_every_published_setting_is_accepted():
    for spec in [*tr.main_models(), *tr.wide_models()]:
        model = spec.make()
        for chosen in tr.draw_grid(spec.grid, 10_000) if spec.grid else [{}]:
            for name, value in chosen.items():
                model._set(**{name: value})


def test_importance(spark, table):
    model = tr.refit(table, SMALL, views.NUMERIC, ["airport"])
    table_ = dict(rows(tr.importance(model, table)))
    assert sum(table_.values()) == pytest.approx(1.0)
    assert len(table_) == len(views.NUMERIC) + 5 and "airport_2-HIGH" in table_
    linear = tr.refit(table, tr.main_models()[0], views.NUMERIC)
    weights = dict(rows(tr.importance(linear, table)))
    assert set(weights) == set(views.NUMERIC) and min(weights.values()) >= 0
    assert max(weights, key=weights.get) in ("n_lightnings", "mean_amplitude")


def test_whole_workflow(spark, sf_dir, tmp_path):
    alerts = views.alerts(spark, sf_dir).drop("storm_type")
    source = write_table(alerts, str(tmp_path / "in"), "csv")
    out = str(tmp_path / "out")
    result = workflow.run(
        spark,
        [str(tmp_path / "missing"), source],
        out,
        specs=[tr.main_models()[0], SMALL],
        exclude=["lightning_per_minute", "log_lightning_per_minute"],
    )
    n = alerts.count()
    assert result.predictions.count() == 2 * n
    report = result.report.collect()
    assert {r["model"] for r in report} == {"rf", "linear_baseline"}
    assert report[0]["model"] == result.best and report[0]["mae_min"] <= report[1]["mae_min"]
    assert all(r["runtime_s"] > 0 for r in report)
    assert PipelineModel.load(f"{out}/run/best_model").stages
    clustered = spark.read.parquet(f"{out}/clustered_alerts")
    assert clustered.count() == n and {"storm_type", "pca_1", "pca_2"} <= set(clustered.columns)
    shares = spark.read.csv(f"{out}/storm_type_share", header=True, inferSchema=True)
    for r in shares.collect():
        assert sum(r[c] for c in shares.columns[1:]) == pytest.approx(100, abs=0.03)
    trends = spark.read.csv(f"{out}/airport_trends", header=True, inferSchema=True)
    assert sum(r["n_alertes"] for r in trends.collect()) == n
    assert spark.read.csv(f"{out}/confidence_table", header=True).count() == 13
    assert spark.read.csv(f"{out}/kpi_sigma_group", header=True).count() == 6
    assert spark.read.csv(f"{out}/footprint", header=True).count() == 4
    assert spark.read.csv(f"{out}/importance", header=True).count() == 20


def test_wide_comparison_takes_clustering_columns(spark, sf_dir, tmp_path):
    alerts = views.alerts(spark, sf_dir).withColumn("cluster_score", F.col("prox_ratio"))
    result = workflow.wide_comparison(alerts, str(tmp_path), [SMALL], k=5)
    assert result.predictions.select("fold").distinct().count() == 5
    assert result.predictions.count() == alerts.count()
    found = {r["feature"] for r in result.importance.collect()}
    assert "cluster_score" in found and "ic_ratio" not in found
    assert {f for f in found if f.startswith("storm_type_")} and {f for f in found if f.startswith("airport_")}


def test_training_sets_are_cut_into_parts_of_bounded_rows(spark, table, monkeypatch):
    monkeypatch.setattr(tr, "PART_ROWS", 100)
    sizes = [r[0] for r in tr.in_parts(table).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == table.count() and max(sizes) <= 120
    one_per_row(tr.out_of_fold(table, SMALL, ["n_lightnings", "mean_dist"]), table)


def test_boosted_trees_are_the_same_without_kept_node_ids(spark, table):
    assert not tr.boosted().getCacheNodeIds()
    short = {"maxIter": 3, "maxDepth": 3}
    own, other = [
        tr.Pipeline(stages=[*tr.encoder(views.NUMERIC, ["airport"]), tr.boosted(**short).setCacheNodeIds(kept)])
        .fit(table).stages[-1].toDebugString.split("\n", 1)[1] for kept in (False, True)
    ]
    assert own == other


def test_a_training_set_is_encoded_once_for_all_models(spark, table, monkeypatch):
    """Equal trees to those of the whole pipeline; every fit reads kept vectors, and nothing stays kept."""
    kept, coded = [], []

    class Watched(tr.RandomForestRegressor):
        def _fit(self, dataset):
            kept.append((dataset.storageLevel.useDisk, dataset.columns, self.getCacheNodeIds()))
            return super()._fit(dataset)

    make = lambda: Watched(featuresCol="features", labelCol="label", numTrees=3, maxDepth=3, seed=7)
    encode = tr.encode
    monkeypatch.setattr(tr, "encode", lambda *a: coded.append(encode(*a)) or coded[-1])
    forest, line = tr.ModelSpec("f", make), tr.main_models()[0]
    with tr.encoded_folds(table, views.NUMERIC, ["airport"]) as sets:
        out = [tr.out_of_fold(table, s, views.NUMERIC, ["airport"], sets=sets) for s in (forest, line)]
        assert len(coded) == 3
        model = tr.fit(forest, sets[0])
    assert kept == [(True, ["label", "features"], False)] * 4
    assert not any(c.rows.storageLevel.useDisk for c in coded)
    for part in out:
        one_per_row(part, table)
    train = table.where("fold <> 0")
    whole = tr.Pipeline(stages=[*tr.encoder(views.NUMERIC, ["airport"]), make()]).fit(train)
    text = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]
    assert text(model) == text(whole)


def test_forests_are_the_same_without_kept_node_ids(spark, table):
    text = lambda m: m.toDebugString.split("\n", 1)[1]
    rows_ = tr.encode(table, views.NUMERIC, ["airport"]).rows
    own, other = [text(tr.forest(numTrees=5, maxDepth=5).setCacheNodeIds(ids).fit(rows_)) for ids in (False, True)]
    rows_.unpersist()
    assert own == other


def test_inner_search_takes_the_setting_of_spark_cross_validation(spark, table):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    grid = {"maxDepth": [1, 2, 4], "minInstancesPerNode": [1, 40]}
    spec = tr.ModelSpec("t", lambda: tr.forest(numTrees=2), grid=grid, draws=4, inner_folds=2)
    train = tr.with_inner_folds(table.where("fold <> 0"), spec)
    settings = tr.draw_grid(grid, 4)
    model = spec.make()
    search = CrossValidator(
        estimator=tr.Pipeline(stages=[*tr.encoder(views.NUMERIC, ["airport"]), model]), numFolds=2, foldCol="inner_fold",
        estimatorParamMaps=[{model.getParam(n): v for n, v in s.items()} for s in settings],
        evaluator=RegressionEvaluator(labelCol="label", metricName="mae"),
    ).fit(train)
    wanted = settings[min(range(4), key=lambda i: search.avgMetrics[i])]
    assert tr.best_setting(spec, train, views.NUMERIC, ["airport"]) == wanted


def test_large_training_sets_are_fitted_one_after_another(spark, table, monkeypatch):
    asked = []
    run = tr._side_by_side
    monkeypatch.setattr(tr, "_side_by_side", lambda spark, f, items, n: asked.append(n) or run(spark, f, items, n))
    monkeypatch.setattr(tr, "FIT_ROWS", 1)
    one_per_row(tr.out_of_fold(table, SMALL, ["n_lightnings", "mean_dist"], parallelism=3), table)
    assert asked[-1] <= 1


def asked_of(monkeypatch, query):
    """The models that a query compares, without fitting them."""
    asked = []
    monkeypatch.setattr(queries, "_oof", lambda spark, sf_dir, *specs: asked.extend(specs))
    query(None, "")
    return asked


def test_boosted_query_fits_all_published_rounds(monkeypatch):
    models = [s.make() for s in asked_of(monkeypatch, queries.oof_gbt)]
    assert [(m.getMaxIter(), m.getMaxDepth(), m.getStepSize()) for m in models] == [(500, 3, 0.05)] * 2
    assert [m.getLossType() for m in models] == ["squared", "absolute"]


def test_tuned_forest_query_searches_the_published_grid(monkeypatch):
    (spec,) = asked_of(monkeypatch, queries.oof_rf_tuned)
    assert (spec.grid, spec.draws, spec.inner_folds, spec.make().getMaxDepth()) == (tr.FOREST_GRID, 12, 3, 30)


def test_searched_forests_are_own_trees_of_the_same_settings(spark, table, monkeypatch):
    setting = {"numTrees": 7, "maxDepth": 30, "minInstancesPerNode": 4, "featureSubsetStrategy": "0.4", "bootstrap": False}
    own = tr.own_forest(tr.forest(), setting, 15)
    assert (own.trees, own.rule.depth, own.rule.least, own.rule.per_split, own.bootstrap) == (7, None, 4, 6, False)
    assert [tr.drawn_features(s, 15) for s in ("all", "sqrt", "log2", "0.6", "onethird", "3")] == [None, 4, 4, 9, 5, 3]
    seen = []
    search = tr.own_trees.search
    monkeypatch.setattr(tr.own_trees, "search", lambda t, settings, *rest: seen.extend(settings) or search(t, settings, *rest))
    monkeypatch.setattr(tr, "fit", None)
    spec = tr.ModelSpec("t", tr.forest, grid={"numTrees": [2, 4], "maxDepth": [3, 30]}, draws=4, inner_folds=2)
    out = tr.out_of_fold(table, spec, views.NUMERIC, ["airport"])
    one_per_row(out, table)
    assert {(f.trees, f.rule.depth) for f in seen} == {(2, 3), (2, None), (4, 3), (4, None)}
    assert out.schema["fold"].dataType == table.schema["fold"].dataType
