"""The registered queries: each reads the test tables and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.functions.scalar import r6, r6_probability
from alertlift.operators import decision, evaluate, features, folds, footprint, storms, trends
from alertlift.operators import training as tr
from alertlift.operators.joins import attach_row
from alertlift.plans import views
from alertlift.plans.benchmark import run_benchmark
from alertlift.sources import schema
from alertlift.sources.reader import load_alerts
from alertlift.sources.staging import scratch_path, stage
from alertlift.sources.writer import write_predictions, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GROUP = "airport"
SCOPE = ["scope", GROUP]


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def rounded(*columns: str) -> list[Column]:
    return [r6(F.col(c)).alias(c) for c in columns]


# Scans and column choice ---------------------------------------------------


@query("scan_alerts")
def scan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts through a headered CSV file and the first-existing-source rule."""
    rows = views.alerts(spark, sf_dir)
    path = write_table(rows, scratch_path(spark, "alerts"), "csv")
    read = load_alerts(spark, [f"{path}-missing", path], rows.schema)
    plain = [c for c in read.columns if c not in views.NUMERIC and c != "start_time"]
    doubles = [c for c in views.NUMERIC if c != "start_hour"]
    return read.select(
        *[c for c in plain if c not in ("duration_minutes", "lightning_per_minute")],
        "start_hour",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        *rounded("duration_minutes", "lightning_per_minute", *doubles),
    )


@query("select_features")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column but the target, which becomes ``label``; columns known
    only after the alert are excluded."""
    chosen = schema.with_label(
        views.alerts(spark, sf_dir), exclude=("start_time", "lightning_per_minute")
    )
    doubles = [c for c in views.NUMERIC if c != "start_hour"]
    return chosen.select(
        "alert_id", GROUP, "alert_airport_id", "start_hour", "storm_type", *rounded(*doubles, "label")
    )


@query("select_allowed_features")
def select_allowed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alerts(spark, sf_dir)
    numeric, categorical = schema.allowed_features(rows)
    values = [r6(F.col(c).cast("double")).alias(c) for c in numeric]
    return rows.select("alert_id", *categorical, *values)


def _with_candidates(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "storm_cluster": (F.col("n_lightnings") % 3).cast("int"),
            "cluster_share": F.col("ic_ratio"),
            "kmeans": F.lit(1),
            "storm_type_score": F.col("prox_ratio"),
        }
    )


@query("cluster_label_candidates")
def cluster_label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column whose name suggests a cluster label."""
    rows = _with_candidates(views.alerts(spark, sf_dir))
    names = schema.cluster_label_names(rows)
    profile = schema.profile_labels(rows, names).first()
    chosen = schema.pick_cluster_label(rows, names, profile)
    found = [
        (c, profile[f"{c}_distinct"], profile[f"{c}_fractional"], int(c == chosen)) for c in names
    ]
    return spark.createDataFrame(
        found, "candidate string, n_distinct long, fractional int, chosen int"
    )


@query("cast_categoricals")
def cast_categoricals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-listed and detected categoricals as text; alerts of hour 0 stand
    for those without an airport."""
    rows = _with_candidates(views.alerts(spark, sf_dir)).withColumn(
        GROUP, F.when(F.col("start_hour") != 0, F.col(GROUP))
    )
    numeric, categorical = schema.with_cluster_columns(rows)
    cast = schema.cast_categoricals(rows, categorical)
    return cast.select(
        "alert_id", *categorical, *[r6(F.col(c).cast("double")).alias(c) for c in numeric]
    )


# Features --------------------------------------------------------------------


@query("feat_speed")
def feat_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_speed(views.alerts(spark, sf_dir)).select("alert_id", *rounded("speed"))


@query("feat_surface")
def feat_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_surface(views.alerts(spark, sf_dir))
    return rows.select("alert_id", *rounded("storm_surface"))


@query("feat_cyclic_hour")
def feat_cyclic_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_cyclic_hour(views.alerts(spark, sf_dir))
    return rows.select("alert_id", *rounded("hour_sin", "hour_cos"))


@query("feat_log1p")
def feat_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_logs(features.add_surface(views.alerts(spark, sf_dir)))
    return rows.select("alert_id", *rounded(*[f"log_{c}" for c in features.LOG_COLUMNS]))


@query("clip_p99")
def clip_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(views.alerts(spark, sf_dir).select("alert_id", *features.CLIP_COLUMNS))
    return features.clip_high(rows).select("alert_id", *rounded(*features.CLIP_COLUMNS))


def _with_gaps(rows: DataFrame) -> DataFrame:
    """A spread of zero stands for a missing one."""
    return rows.withColumns(
        {c: F.nullif(F.col(c), F.lit(0.0)) for c in ("lat_std", "lon_std")}
    )


@query("drop_null_features")
def drop_null_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.drop_incomplete(features.add_speed(_with_gaps(views.alerts(spark, sf_dir))))
    return rows.select("alert_id", *rounded(*schema.STORM_FEATURES))


@query("filter_airport")
def filter_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.only_airport(views.alerts(spark, sf_dir), "2-HIGH")
    return rows.select("alert_id", GROUP, *rounded("duration_minutes"))


@query("distinct_airports")
def distinct_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.airports(views.alerts(spark, sf_dir))


@query("zscore_features")
def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.z_scores(features.add_speed(views.alerts(spark, sf_dir)))
    return rows.select("alert_id", *rounded(*[f"z_{c}" for c in schema.STORM_FEATURES]))


@query("one_hot_airport")
def one_hot_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot(views.alerts(spark, sf_dir).select("alert_id", GROUP), GROUP)


# Trends ----------------------------------------------------------------------


@query("airport_trends")
def airport_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(views.alerts(spark, sf_dir).drop("start_time"))
    table = trends.airport_trends(rows)
    return table.select(GROUP, "n_alertes", *rounded(*table.columns[2:]))


@query("storm_type_share")
def storm_type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = trends.storm_type_share(views.alerts(spark, sf_dir), [0, 1, 2, 3], digits=None)
    return shares.select(GROUP, *[r6(F.col(str(t))).alias(f"type_{t}") for t in range(4)])


@query("cluster_profile")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storms.cluster_profile(features.add_speed(views.alerts(spark, sf_dir)))
    return rows.select("storm_type", *rounded(*[f"z_{c}" for c in schema.STORM_FEATURES]))


# Folds and evaluation -----------------------------------------------------------


@query("kfold_assign")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.assign_folds(views.alerts(spark, sf_dir)).select("alert_id", "fold")


@query("group_kfold_assign")
def group_kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alerts(spark, sf_dir).select("alert_id", "alert_airport_id")
    return folds.assign_group_folds(rows, "alert_airport_id")


@query("oof_linear_1d")
def oof_linear_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    return rows.select(
        "alert_id", GROUP, "model", "fold", *rounded("duration_true", "duration_pred")
    )


@query("residuals")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision.add_residuals(views.line_predictions(spark, sf_dir))
    return rows.select("alert_id", *rounded("residual", "abs_residual"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.oof_metrics(views.predictions(spark, sf_dir))


@query("oof_metrics")
def oof_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("model", *rounded("mae", "rmse"))


@query("leaderboard")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = evaluate.leaderboard(_metrics(spark, sf_dir), list(views.LINES))
    return board.select("model", "model_order", *rounded("mae", "rmse"))


@query("best_model")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = evaluate.best_model(_metrics(spark, sf_dir), list(views.LINES))
    return best.select("model", *rounded("mae", "rmse"))


@query("best_predictions")
def best_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the predictions table on disk, one folder per model."""
    path = write_predictions(views.predictions(spark, sf_dir), scratch_path(spark, "predictions"))
    best = evaluate.best_predictions(spark.read.parquet(path), list(views.LINES))
    return best.select("alert_id", "model", *rounded("duration_true", "duration_pred"))


@query("benchmark_with_runtime")
def benchmark_with_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.with_runtime_by_run(_metrics(spark, sf_dir), views.run_log(spark, sf_dir))
    return report.select("run_id", "model", *rounded("mae_min", "rmse_min", "runtime_s"))


@query("preds_with_airport")
def preds_with_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = views.line_predictions(spark, sf_dir).drop(GROUP)
    rows = evaluate.with_airport(preds, views.alerts(spark, sf_dir))
    return rows.select("alert_id", GROUP, *rounded("duration_true", "duration_pred"))


# Decision ------------------------------------------------------------------------


def _line_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.gains(decision.with_sigma(views.line_predictions(spark, sf_dir)))


@query("residual_sigma")
def residual_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.residual_sigma(views.predictions(spark, sf_dir), ["model"]).select(
        "model", *rounded("sigma")
    )


@query("prob_at_minute")
def prob_at_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision.probability_matrix(views.line_predictions(spark, sf_dir))
    return rows.select("alert_id", "minute", r6_probability(F.col("p_over")).alias("p_over"))


@query("lift_minute")
def lift_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_gains(spark, sf_dir).select("alert_id", "lift_minute")


@query("fixed_rule_time")
def fixed_rule_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = decision.fixed_rule_minute(F.col("duration_minutes"))
    return views.alerts(spark, sf_dir).select("alert_id", r6(minute).alias("fixed_rule_minute"))


@query("gain_per_alert")
def gain_per_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_gains(spark, sf_dir).select("alert_id", "earlier", *rounded("gain"))


@query("gain_identity")
def gain_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = decision.gain_identity(_line_gains(spark, sf_dir))
    means = ["mean_true", "mean_before", "mean_after", "mean_gain"]
    return checks.select("before_holds", "gain_holds", *rounded(*means))


def _kpis(spark: SparkSession, sf_dir: str, sigma_scope: str) -> DataFrame:
    return decision.kpi_panel(
        views.line_predictions(spark, sf_dir), sigma_scope=sigma_scope
    )


KPI_FIGURES = [
    "mae",
    "sigma",
    "mean_gain",
    "pct_earlier",
    "mean_before",
    "mean_after",
    "median_before",
    "median_after",
    "median_gain",
]


@query("kpi_by_airport")
def kpi_by_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _kpis(spark, sf_dir, "global")
    return panel.select(*SCOPE, "n_alerts", "n_earlier", *rounded(*KPI_FIGURES))


@query("kpi_by_airport_own_sigma")
def kpi_by_airport_own_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _kpis(spark, sf_dir, "group")
    return panel.select(*SCOPE, "n_alerts", "n_earlier", *rounded(*KPI_FIGURES))


@query("gain_verdict")
def gain_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = decision.gain_verdict(_kpis(spark, sf_dir, "global"))
    return verdicts.select(*SCOPE, "verdict", "mae_below_10", *rounded("median_gain"))


@query("confidence_table")
def confidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.confidence_table(views.line_predictions(spark, sf_dir))


@query("policy_curve")
def policy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = decision.policy_curve(views.line_predictions(spark, sf_dir))
    return curve.select(*SCOPE, "pct", *rounded("median_minute"))


@query("median_prob_curve")
def median_prob_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = decision.median_probability_curve(views.line_predictions(spark, sf_dir))
    return curve.select("minute", *rounded("median_p_over"))


# Footprint ---------------------------------------------------------------------------


@query("runtime_share")
def runtime_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = footprint.runtime_share(views.run_log(spark, sf_dir), views.wall_clock(spark, sf_dir))
    return rows.select("run_id", "model", *rounded("runtime_s", "runtime_share_pct"))


@query("footprint")
def footprint_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = footprint.footprint(views.run_log(spark, sf_dir), views.wall_clock(spark, sf_dir))
    grams = (F.col("kg_CO2eq_estimated") * 1000).alias("g_CO2eq_estimated")
    return rows.select("*", grams).select(
        "run_id",
        "model",
        *rounded(
            "runtime_s",
            "power_assumed_W",
            "energy_kWh_estimated",
            "g_CO2eq_estimated",
            "grid_g_CO2_per_kWh_assumed",
        ),
    )


# Distributed training --------------------------------------------------------------


@query("storm_types")
def storm_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = storms.type_storms(features.storm_features(stage(views.alerts(spark, sf_dir))))
    return typed.alerts.select("alert_id", GROUP, "storm_type", *rounded(*schema.STORM_FEATURES))


@query("storm_pca")
def storm_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(storms.scaled_vectors(features.add_speed(views.alerts(spark, sf_dir))))
    rows = storms.project_storms(vectors, storms.fit_pca(vectors))
    return rows.select("alert_id", *rounded("pca_1", "pca_2"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, fold and raw features, staged because every fit reads them."""
    return stage(
        views.labelled(spark, sf_dir).select("alert_id", GROUP, "fold", "label", *views.NUMERIC)
    )


def _oof(spark: SparkSession, sf_dir: str, *specs: tr.ModelSpec) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    if len(specs) == 1:
        parts = [tr.out_of_fold(rows, specs[0], views.NUMERIC, [GROUP], parallelism=3)]
    else:
        with tr.encoded_folds(rows, views.NUMERIC, [GROUP]) as sets:
            parts = [tr.out_of_fold(rows, s, views.NUMERIC, [GROUP], parallelism=3, sets=sets) for s in specs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        "alert_id", GROUP, "model", "fold", *rounded("duration_true", "duration_pred")
    )


@query("oof_linear")
def oof_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oof(spark, sf_dir, tr.main_models()[0])


def small_forest() -> tr.ModelSpec:
    return tr.ModelSpec("rf_default", lambda: tr.forest(numTrees=20, maxDepth=6))


@query("oof_rf")
def oof_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oof(spark, sf_dir, small_forest())


@query("oof_rf_tuned")
def oof_rf_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published nested search: twelve settings of ``FOREST_GRID``, three inner folds."""
    (spec,) = (m for m in tr.main_models() if m.name == "rf_tuned")
    return _oof(spark, sf_dir, spec)


@query("oof_gbt")
def oof_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees with squared and with absolute loss, all rounds of the published default."""
    return _oof(
        spark,
        sf_dir,
        tr.ModelSpec("gbr_default", tr.boosted),
        tr.ModelSpec("gbr_absolute", lambda: tr.boosted(lossType="absolute")),
    )


@query("top_features")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    model = tr.refit(rows, small_forest(), views.NUMERIC, [GROUP])
    table = evaluate.top_features(tr.importance(model, rows))
    return table.select("feature", *rounded("importance"))


@query("model_benchmark")
def model_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models compared, with the report columns of a full run."""
    rows = training_rows(spark, sf_dir)
    specs = [tr.main_models()[0], small_forest()]
    result = run_benchmark(rows, specs, views.NUMERIC, [GROUP], scratch_path(spark, "benchmark"))
    return result.report.select("model", *rounded("mae_min", "rmse_min", "runtime_s"))


# Checks of trained results -----------------------------------------------------------


@query("oof_coverage")
def oof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert is predicted once by each model, in its own fold."""
    rows = _oof(spark, sf_dir, tr.main_models()[0], small_forest())
    return rows.groupBy("model", "fold").agg(
        F.count("*").alias("n"),
        F.count_distinct("alert_id").alias("n_keys"),
        F.count("duration_pred").alias("n_predicted"),
        r6(F.sum("duration_true")).alias("sum_true"),
    )


@query("storm_types_check")
def storm_types_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All complete alerts have a type, types are numbered by size, and no
    alert is nearer to another type's centre."""
    rows = features.add_speed(views.alerts(spark, sf_dir)).select("alert_id", *schema.STORM_FEATURES)
    # Staged, as their statistics and their scores would each aggregate and join all lines, side by side.
    vectors = stage(storms.scaled_vectors(stage(rows)))
    model = storms.fit_kmeans(vectors)
    order = storms.size_order(model)
    typed = storms.label_storms(vectors, model, order)
    z = vector_to_array(F.col("z"))
    gaps = {
        order[i]: sum(((z[j] - float(v)) ** 2 for j, v in enumerate(centre)), F.lit(0.0))
        for i, centre in enumerate(model.clusterCenters())
    }
    own = F.element_at(F.array(*[gaps[t] for t in sorted(gaps)]), F.col("storm_type") + 1)
    stray = F.sum((own > F.least(*gaps.values()) + 1e-9).cast("int"))
    sizes = typed.groupBy("storm_type").agg(F.count("*").alias("n"), stray.alias("stray"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("storm_type", "n"))), lambda p: p["n"])
    return sizes.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_types"),
        F.sum("stray").alias("n_stray"),
        (in_order == F.reverse(F.array_sort(in_order))).cast("int").alias("by_size"),
    )


@query("storm_pca_check")
def storm_pca_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are centred and uncorrelated; the first spreads more."""
    rows = storm_pca(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("n"),
        r6(F.abs(F.avg("pca_1"))).alias("mean_1"),
        r6(F.abs(F.avg("pca_2"))).alias("mean_2"),
        (F.abs(F.corr("pca_1", "pca_2")) < 1e-5).cast("int").alias("uncorrelated"),
        (F.var_pop("pca_1") >= F.var_pop("pca_2")).cast("int").alias("ordered"),
    )


@query("importance_check")
def importance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded column has an importance; together they make 1."""
    rows = training_rows(spark, sf_dir)
    table = tr.importance(tr.refit(rows, small_forest(), views.NUMERIC, [GROUP]), rows)
    total = table.agg(r6(F.sum("importance")).alias("total"))
    return attach_row(table.select("feature"), total)
