"""Queries of trained models with their published settings, and SQL for what must hold for their results."""

from __future__ import annotations

import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.functions.scalar import r6
from alertlift.operators import (
    binning, boosting, cardinality, evaluate, features, forest, group_balance, growth, kmeans_batch, least_squares, levels, storms,
)
from alertlift.plans import views
from alertlift.plans.oracles import ALERTS, FOLDED, PRIORITIES, SPEEDY, add
from alertlift.plans.oracles import r6 as sql_r6
from alertlift.plans.queries import GROUP, query, rounded
from alertlift.sources import schema
from alertlift.sources.reader import load_alerts
from alertlift.sources.staging import keep_staged, scratch_path, shuffles_dropped, stage, staged_scope
from alertlift.sources.writer import write_table

# Results that a check reads again, per application, query and input.
_kept: dict[tuple[str, str, str], DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str, name: str, result: DataFrame) -> DataFrame:
    kept = _kept[spark.sparkContext.applicationId, name, sf_dir] = keep_staged(result)
    return kept


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The staged result of an earlier query of this application, as long as its files are there."""
    found = _kept.get((spark.sparkContext.applicationId, name, sf_dir))
    if found is None:
        return None
    files = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in found.inputFiles()]
    conf = spark._jsc.hadoopConfiguration()
    return found if all(f.getFileSystem(conf).exists(f) for f in files) else None


def encoded(spark: SparkSession, sf_dir: str) -> binning.Encoded:
    rows = views.labelled(spark, sf_dir).select("alert_id", GROUP, "fold", "label", *views.NUMERIC)
    return binning.encode(rows, views.NUMERIC, [GROUP])


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("alert_id", GROUP, "model", "fold", *rounded("duration_true", "duration_pred"))


#: The published forest: 120 trees, no limit of depth, all features at each split.
FULL_FOREST = forest.Forest()


def _full_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and importances over the forests of all folds, staged."""
    with staged_scope(spark), shuffles_dropped(spark):
        table = encoded(spark, sf_dir)
        fits = [forest.Fit(FULL_FOREST, held) for held in range(table.k)]
        grown = forest.fit_forests(table, fits)
        scored = forest.published(table, forest.predicted(table, grown, fits), "rf_full")
        gains = forest.importances(table, grown).groupBy("feature").agg(F.avg("importance").alias("importance"))
        return keep(spark, sf_dir, "forest", scored), keep(spark, sf_dir, "gains", gains)


@query("oof_forest_full")
def oof_forest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published forest out of fold."""
    return _told(_full_forest(spark, sf_dir)[0])


@query("top_features_full")
def top_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 features that gain most in the published forest, mean over its three fits."""
    gains = kept(spark, sf_dir, "gains")
    gains = _full_forest(spark, sf_dir)[1] if gains is None else gains
    return gains.orderBy(F.desc("importance"), "feature").limit(20).select("feature", *rounded("importance"))


def _check(rows: DataFrame) -> DataFrame:
    """Per model and fold: every alert once, and a smaller error than the mean of the other folds has."""
    own = rows.groupBy("model", "fold").agg(F.count("*").alias("c"), F.sum("duration_true").alias("s"))
    whole = own.groupBy("model").agg(F.sum("c").alias("all_c"), F.sum("s").alias("all_s"))
    mean = own.join(whole, "model").select("model", "fold", ((F.col("all_s") - F.col("s")) / (F.col("all_c") - F.col("c"))).alias("mean"))
    error = lambda c: F.avg(F.abs(F.col("duration_true") - F.col(c)))
    return rows.join(F.broadcast(mean), ["model", "fold"]).groupBy("model", "fold").agg(
        F.count("*").alias("n"), F.count_distinct("alert_id").alias("n_keys"), F.count("duration_pred").alias("n_predicted"),
        r6(F.sum("duration_true")).alias("sum_true"), (error("duration_pred") < 0.5 * error("mean")).cast("int").alias("halves_error"),
    )


def _add_check(name: str, *models: str) -> None:
    listed = ", ".join(f"('{m}')" for m in models)
    add(
        name,
        f"""select model, fold, count(*) as n, count(*) as n_keys, count(*) as n_predicted,
  {sql_r6("sum(duration_minutes)", "sum_true")}, 1 as halves_error
from folded cross join (values {listed}) as m(model) group by model, fold""",
        ALERTS,
        FOLDED,
    )


@query("forest_full_check")
def forest_full_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the result of ``oof_forest_full``: coverage, and half the error of the mean at most."""
    rows = kept(spark, sf_dir, "forest")
    return _check(_full_forest(spark, sf_dir)[0] if rows is None else rows)


_add_check("forest_full_check", "rf_full")

#: The published searches name 120 to 300 rounds of penalised squared and 400 to 900 of absolute error; these are the least.
BOOSTED = {
    "gbt_penalised": boosting.Boosting(120, 0.08, 6, penalty=1.0, least=3, rows=0.8, columns=0.8),
    "gbt_absolute": boosting.Boosting(400, 0.08, 4, penalty=3.0, absolute=True),
}


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    with staged_scope(spark), shuffles_dropped(spark):
        return keep(spark, sf_dir, "boosted", boosting.out_of_fold(encoded(spark, sf_dir), BOOSTED))


@query("oof_boosted")
def oof_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting with a penalty on leaves and features drawn per tree, and boosting of absolute error with exact leaf medians."""
    return _told(_boosted(spark, sf_dir))


@query("boosted_check")
def boosted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir, "boosted")
    return _check(_boosted(spark, sf_dir) if rows is None else rows)


_add_check("boosted_check", *BOOSTED)

#: The published search: numbers of trees, settings drawn for each outer fold's inner folds.
SEARCH_COUNTS, SEARCH_DRAWS, INNER = (120, 200, 300), 12, 3


def search_settings(seed: int = 42) -> list[forest.Forest]:
    """Distinct settings, drawn from the published space."""
    p = len(views.NUMERIC) + len(PRIORITIES)
    space = [
        forest.Forest(n, growth.Rule(depth, least, per_split=max(1, per_split), whole=whole), bootstrap)
        for n in SEARCH_COUNTS for depth in (None, 10, 15, 25, 35) for whole in (2, 5, 10) for least in (1, 2, 4)
        for per_split in (int(p**0.5), p.bit_length() - 1, int(0.4 * p), int(0.6 * p), int(0.8 * p)) for bootstrap in (True, False)
    ]
    return random.Random(seed).sample(list(dict.fromkeys(space)), SEARCH_DRAWS)


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    with staged_scope(spark), shuffles_dropped(spark):
        scored, report = forest.search(encoded(spark, sf_dir), search_settings(), INNER, "rf_search")
        return keep(spark, sf_dir, "search", scored), keep(spark, sf_dir, "search_report", report)


@query("oof_forest_search")
def oof_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published nested search: one encoded table for all folds, one fit for all numbers of trees of a setting."""
    return _told(_search(spark, sf_dir)[0])


@query("forest_search_check")
def forest_search_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold: errors of all settings are there, one setting is chosen, none is better, and its forest halves the error of
    the mean."""
    scored, report = kept(spark, sf_dir, "search"), kept(spark, sf_dir, "search_report")
    if scored is None or report is None:
        scored, report = _search(spark, sf_dir)
    told = report.groupBy("fold").agg(
        F.count("*").alias("n_settings"), F.sum("chosen").alias("n_chosen"),
        (F.min(F.when(F.col("chosen") == 1, F.col("mae"))) <= F.min("mae") + 1e-9).cast("int").alias("best_chosen"),
    )
    return told.join(_check(scored).select("fold", "n", "n_keys", "halves_error"), "fold")


add(
    "forest_search_check",
    f"""select fold, cast({SEARCH_DRAWS} as bigint) as n_settings, cast(1 as bigint) as n_chosen, 1 as best_chosen,
  count(*) as n, count(*) as n_keys, 1 as halves_error from folded group by fold""",
    ALERTS,
    FOLDED,
)


@query("oof_linear_all")
def oof_linear_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on all columns out of fold, from one matrix of products per fold."""
    rows = least_squares.out_of_fold(views.labelled(spark, sf_dir), views.NUMERIC, [GROUP])
    at3 = lambda c: F.round(c, 3).alias(c)
    return rows.select("alert_id", GROUP, "model", "fold", at3("duration_true"), at3("duration_pred"))


@query("linear_coefficients")
def linear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, by_fold = least_squares.fold_coefficients(views.labelled(spark, sf_dir), views.NUMERIC, [GROUP])
    told = [(fold, name, b) for fold, values in sorted(by_fold.items()) for name, b in zip(names, values, strict=True)]
    table = spark.createDataFrame(told, "fold int, term string, coefficient double")
    return table.select("fold", "term", *rounded("coefficient"))


TERMS = [("intercept", "1.0"), *[(c, f"cast({c} as double)") for c in views.NUMERIC]]
TERMS += [(f"{GROUP}_{level}", f"cast(airport = '{level}' as int)::double") for level in PRIORITIES]


def _sql_sweep() -> list[str]:
    """Products per fold, their sums over the other folds, and one step of elimination per term."""
    p = len(TERMS)
    columns = [f"{sql} as c{i}" for i, (_, sql) in enumerate(TERMS)] + [f"duration_minutes as c{p}"]
    pairs = [(i, j) for i in range(p + 1) for j in range(p + 1)]
    steps = [
        f"design as (select alert_id, airport, fold, duration_minutes, {', '.join(columns)} from folded)",
        f"wide as materialized (select fold, {', '.join(f'sum(c{i} * c{j}) as m_{i}_{j}' for i, j in pairs if i <= j)} from design group by fold)",
        "products as materialized (" + " union all ".join(
            f"select fold, {i} as i, {j} as j, m_{min(i, j)}_{max(i, j)} as v from wide" for i, j in pairs
        ) + ")",
        "s0 as materialized (select h.fold, p.i, p.j, sum(p.v) as v from held_out h join products p on p.fold <> h.fold group by h.fold, p.i, p.j)",
    ]
    for k in range(p):
        steps.append(
            f"""s{k + 1} as materialized (select a.fold, a.i, a.j,
  case when q.v <= {least_squares.DEPENDENT} * d.v then a.v when a.i = {k} then a.v / q.v else a.v - r.v * c.v / q.v end as v
  from s{k} a join s{k} q on q.fold = a.fold and q.i = {k} and q.j = {k} join s0 d on d.fold = a.fold and d.i = {k} and d.j = {k}
  join s{k} r on r.fold = a.fold and r.i = a.i and r.j = {k} join s{k} c on c.fold = a.fold and c.i = {k} and c.j = a.j)"""
        )
    dependent = " union all ".join(
        f"select q.fold, {k} as i, q.v <= {least_squares.DEPENDENT} * d.v as dependent from s{k} q join s0 d using (fold, i, j) where q.i = {k} and q.j = {k}"
        for k in range(p)
    )
    steps.append(f"dependence as materialized ({dependent})")
    steps.append(
        f"""b as materialized (select s.fold, s.i, case when d.dependent then 0 else s.v end as v
  from s{p} s join dependence d on d.fold = s.fold and d.i = s.i where s.j = {p})"""
    )
    return steps


_NAMED = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(TERMS))
add(
    "linear_coefficients",
    f"select b.fold, t.term, {sql_r6('b.v', 'coefficient')} from b join (values {_NAMED}) as t(i, term) on t.i = b.i",
    ALERTS,
    FOLDED,
    *_sql_sweep(),
)
add(
    "oof_linear_all",
    f"""select alert_id, airport, 'linear_all' as model, d.fold, round(duration_minutes, 3) as duration_true,
  round({" + ".join(f"c{i} * b{i}" for i in range(len(TERMS)))}, 3) as duration_pred
from design d join (select fold, {", ".join(f"max(case when i = {i} then v end) as b{i}" for i in range(len(TERMS)))} from b group by fold) w
  on w.fold = d.fold""",
    ALERTS,
    FOLDED,
    *_sql_sweep(),
)


#: Models in the order in which they are compared; the first of equally good ones is the best.
COMPARED = ("linear_all", "rf_full", "rf_search", *BOOSTED)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of all five models, those of this application's earlier queries read again."""
    own = [least_squares.out_of_fold(views.labelled(spark, sf_dir), views.NUMERIC, [GROUP])]
    for name, run in (("forest", lambda *a: _full_forest(*a)[0]), ("search", lambda *a: _search(*a)[0]), ("boosted", _boosted)):
        found = kept(spark, sf_dir, name)
        own.append(run(spark, sf_dir) if found is None else found)
    columns = ["alert_id", "model", "fold", "duration_true", "duration_pred"]
    rows = own[0].select(*columns)
    for more in own[1:]:
        rows = rows.unionByName(more.select(*columns))
    return rows


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the five models, what the mean of the other folds would reach, and the best model."""
    rows = stage(_compared(spark, sf_dir))
    metrics = evaluate.oof_metrics(rows).join(rows.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("alert_id").alias("n_keys")), "model")
    metrics = stage(metrics)
    best = evaluate.best_model(metrics, COMPARED).select(F.col("model").alias("best_model"))
    halves = _check(rows).groupBy("model").agg(F.count("*").alias("n_folds"), F.min("halves_error").alias("halves_error"))
    told = metrics.join(halves, "model").crossJoin(F.broadcast(best))
    return keep(spark, sf_dir, "benchmark", told.withColumn("best", (F.col("model") == F.col("best_model")).cast("int")).drop("best_model"))


@query("published_benchmark")
def published_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on all columns, the full forest, the searched forest and both boostings, compared out of fold."""
    rows = _benchmark(spark, sf_dir)
    below = (F.col("mae") < 10).cast("int").alias("below_10")
    return rows.select("model", "n", *rounded("mae", "rmse"), below, "best", evaluate.model_order(COMPARED).cast("int").alias("place"))


@query("published_benchmark_check")
def published_benchmark_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for ``published_benchmark``: all alerts in all folds for each model, one best model, none better, and the
    error of least squares, which SQL works out itself."""
    rows = kept(spark, sf_dir, "benchmark")
    rows = _benchmark(spark, sf_dir) if rows is None else rows
    least = rows.agg(F.min("mae").alias("least"), F.sum("best").alias("n_best"))
    linear = F.col("model") == "linear_all"
    return rows.crossJoin(F.broadcast(least)).select(
        "model", "n", "n_keys", "n_folds", "n_best", ((F.col("best") == 0) | (F.col("mae") == F.col("least"))).cast("int").alias("none_better"),
        F.when(linear, 1).otherwise(F.col("halves_error")).alias("halves_error"),
        *[F.when(linear, F.round(c, 3)).alias(f"linear_{c}") for c in ("mae", "rmse")],
    )


_PREDICTED = " + ".join(f"c{i} * b{i}" for i in range(len(TERMS)))
_WIDE = ", ".join(f"max(case when i = {i} then v end) as b{i}" for i in range(len(TERMS)))
add(
    "published_benchmark_check",
    f"""select model, n, n as n_keys, cast(3 as bigint) as n_folds, cast(1 as bigint) as n_best, 1 as none_better, 1 as halves_error,
  case when model = 'linear_all' then round(mae, 3) end as linear_mae, case when model = 'linear_all' then round(rmse, 3) end as linear_rmse
from (select count(*) as n, avg(abs(r)) as mae, sqrt(avg(r * r)) as rmse
  from (select duration_minutes - ({_PREDICTED}) as r from design d join (select fold, {_WIDE} from b group by fold) w on w.fold = d.fold))
cross join (values {", ".join(f"('{m}')" for m in COMPARED)}) as m(model)""",
    ALERTS,
    FOLDED,
    *_sql_sweep(),
)


@query("balanced_group_folds")
def balanced_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by greedy filling: the largest one to the lightest fold."""
    rows = views.alerts(spark, sf_dir).select("alert_id", "alert_airport_id")
    return group_balance.assign_balanced_group_folds(rows, "alert_airport_id")


add(
    "balanced_group_folds",
    """select alert_id, a.alert_airport_id, cast(f.fold as int) as fold from alerts_v a
join ranked r on r.alert_airport_id = a.alert_airport_id
join bounds f on f.n = r.n and r.place >= f.begins and r.place < f.ends""",
    f"recursive {ALERTS.strip()}",
    "sizes as materialized (select alert_airport_id, count(*) as n from alerts_v group by alert_airport_id)",
    """ranked as materialized (select *, row_number() over (partition by n order by
  substr(md5(cast(alert_airport_id as varchar)), 1, 4), alert_airport_id) - 1 as place,
  row_number() over (order by n desc, substr(md5(cast(alert_airport_id as varchar)), 1, 4), alert_airport_id) as step from sizes)""",
    """walk as (select cast(0 as bigint) as step, cast(0 as bigint) as n, cast(-1 as int) as fold,
    cast(0 as bigint) as a, cast(0 as bigint) as b, cast(0 as bigint) as c
  union all
  select r.step, r.n, case when a <= b and a <= c then 0 when b <= c then 1 else 2 end,
    case when a <= b and a <= c then a + r.n else a end,
    case when not (a <= b and a <= c) and b <= c then b + r.n else b end,
    case when not (a <= b and a <= c) and not b <= c then c + r.n else c end
  from walk w join ranked r on r.step = w.step + 1)""",
    "given as (select n, fold, count(*) as c from walk where fold >= 0 group by n, fold)",
    """bounds as (select n, fold, sum(c) over (partition by n order by fold) - c as begins,
  sum(c) over (partition by n order by fold) as ends from given)""",
)


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One clustering: alerts with vector, type and principal scores, the centres, and the costs of all starts."""
    vectors = stage(storms.scaled_vectors(stage(features.add_speed(views.alerts(spark, sf_dir)))))
    found = kmeans_batch.fit_starts(vectors)
    typed = vectors.withColumn("z_array", vector_to_array(F.col("z")))
    typed = typed.withColumn("storm_type", found.label(F.col("z_array")))
    scored = storms.project_storms(typed, storms.fit_pca(vectors)).drop("z")
    centres = spark.createDataFrame([(i, n, c.tolist()) for i, (n, c) in enumerate(zip(found.sizes, found.centres, strict=True))], "storm_type int, n long, centre array<double>")
    costs = spark.createDataFrame([(i, c, int(i == found.best)) for i, c in enumerate(found.costs)], "start int, cost double, best int")
    return tuple(keep(spark, sf_dir, f"clusters_{i}", t) for i, t in enumerate((scored, centres, costs)))


def _kept_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    found = tuple(kept(spark, sf_dir, f"clusters_{i}") for i in range(3))
    return _clusters(spark, sf_dir) if any(t is None for t in found) else found


@query("storm_clusters")
def storm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and principal scores of every complete alert, from ten starts moved together."""
    rows = _clusters(spark, sf_dir)[0]
    return rows.select("alert_id", GROUP, "storm_type", *rounded("pca_1", "pca_2"))


@query("storm_cluster_profile")
def storm_cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and mean z-scores of the types found."""
    rows = _kept_clusters(spark, sf_dir)[0]
    means = [r6(F.avg(F.col("z_array")[i])).alias(f"z_{c}") for i, c in enumerate(schema.STORM_FEATURES)]
    return rows.groupBy("storm_type").agg(F.count("*").alias("n"), *means)


@query("storm_clusters_check")
def storm_clusters_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for ``storm_clusters``: no alert is nearer to another type's centre, types are numbered by size, the
    start that was taken is the cheapest of ten, and scores are centred and uncorrelated."""
    rows, centres, costs = _kept_clusters(spark, sf_dir)
    apart = F.aggregate(F.zip_with("z_array", "centre", lambda x, c: (x - c) ** 2), F.lit(0.0), lambda a, v: a + v)
    each = rows.crossJoin(F.broadcast(centres.select(F.col("storm_type").alias("t"), "centre"))).select(
        "alert_id", "storm_type", "pca_1", "pca_2", "t", apart.alias("apart")
    )
    own = each.groupBy("alert_id", "storm_type", "pca_1", "pca_2").agg(
        F.max(F.when(F.col("t") == F.col("storm_type"), F.col("apart"))).alias("own"), F.min("apart").alias("least")
    )
    alerts = own.agg(
        F.count("*").alias("n"), F.count_distinct("storm_type").alias("n_types"),
        F.sum((F.col("own") > F.col("least") + 1e-9).cast("long")).alias("n_stray"),
        ((F.abs(F.avg("pca_1")) < 1e-6) & (F.abs(F.avg("pca_2")) < 1e-6) & (F.abs(F.corr("pca_1", "pca_2")) < 1e-6)).cast("int").alias("scores_ok"),
    )
    sizes = rows.groupBy("storm_type").agg(F.count("*").alias("c")).join(centres, "storm_type")
    ranked = sizes.agg((F.sum((F.col("c") != F.col("n")).cast("int")) == 0).alias("same"), F.array_sort(F.collect_list(F.struct("storm_type", "c"))).alias("by"))
    falling = F.col("same") & (F.transform("by", lambda s: s["c"]) == F.sort_array(F.transform("by", lambda s: s["c"]), asc=False))
    starts = costs.agg(F.count("*").alias("n_starts"), (F.min(F.when(F.col("best") == 1, F.col("cost"))) <= F.min("cost") * (1 + 1e-8)).cast("int").alias("cheapest"))
    return alerts.crossJoin(ranked.select(falling.cast("int").alias("by_size"))).crossJoin(starts)


add(
    "storm_clusters_check",
    """select count(*) as n, cast(3 as bigint) as n_types, cast(0 as bigint) as n_stray, 1 as scores_ok, 1 as by_size,
  cast(10 as bigint) as n_starts, 1 as cheapest from speedy""",
    ALERTS,
    SPEEDY,
)


@query("clustered_table")
def clustered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustered table written as CSV with a header and read back by column name: its features, and whether type and
    scores are those that were found."""
    rows = _kept_clusters(spark, sf_dir)[0]
    path = write_table(rows.drop("z_array"), scratch_path(spark, "clustered_alerts"), "csv")
    found = ["storm_type", "pca_1", "pca_2"]
    back = load_alerts(spark, path, rows.drop("z_array").schema)
    first = rows.select("alert_id", F.struct(*found).alias("found"))
    same = (F.struct(*found) == F.col("found")).cast("int").alias("same_clusters")
    return back.join(first, "alert_id", "left").select("alert_id", GROUP, *rounded(*schema.STORM_FEATURES), same)


add(
    "clustered_table",
    "select alert_id, airport, " + ", ".join(sql_r6(c, c) for c in schema.STORM_FEATURES) + ", 1 as same_clusters from speedy",
    ALERTS,
    SPEEDY,
)


@query("label_race")
def label_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster label among six columns, of which exact counting sees only those that can win."""
    rows = views.alerts(spark, sf_dir).withColumns(
        {
            "storm_cluster": (F.col("n_lightnings") % 3).cast("int"), "cluster_share": F.col("ic_ratio"), "kmeans": F.lit(1),
            "cluster_id": F.col("alert_id"), "cluster_hour": F.col("start_hour"),
        }
    )
    names = schema.cluster_label_names(rows)
    standings = cardinality.race(rows, names)
    best = cardinality.winner(standings)
    told = [(s.column, s.n_distinct, int(s.fractional), int(s.constant), int(s.column == best)) for s in standings]
    return spark.createDataFrame(told, "candidate string, n_distinct long, fractional int, constant int, chosen int")


add(
    "label_race",
    """select * from (
  select 'storm_type' as candidate, cast(null as bigint) as n_distinct, 0 as fractional, 0 as constant, 0 as chosen
  union all select 'storm_cluster', count(distinct cast(n_lightnings as bigint) % 3), 0, 0, 1 from alerts_v
  union all select 'cluster_share', null, 1, 0, 0 union all select 'kmeans', null, 0, 1, 0
  union all select 'cluster_id', null, 0, 0, 0 union all select 'cluster_hour', null, 0, 0, 0)""",
    ALERTS,
)


@query("level_dictionary")
def level_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the levels of a column with many, by falling frequency."""
    return levels.dictionary(views.alerts(spark, sf_dir), "alert_airport_id")


@query("levels_of_fold")
def levels_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot that one-hot encoding by the rows outside fold 0 fills for each alert (none for levels seen there only)."""
    rows = views.labelled(spark, sf_dir).select("alert_id", "fold", "alert_airport_id")
    train = levels.fold_dictionaries(rows, ["alert_airport_id"], 0)["alert_airport_id"]
    slots = train.agg(F.count("*").cast("int").alias("n_slots"))
    coded = levels.indexed(rows, train, "alert_airport_id", "slot").crossJoin(F.broadcast(slots))
    return coded.select("alert_id", F.coalesce("slot", F.lit(-1)).alias("slot"), "n_slots")


_LEVELS = """levels as (select level, n, row_number() over (order by n desc, substr(md5(level), 1, 4), level) - 1 as id
  from (select cast(alert_airport_id as varchar) as level, count(*) as n from {0} group by 1))"""
add("level_dictionary", "select level, n, id from levels", ALERTS, _LEVELS.format("alerts_v"))
add(
    "levels_of_fold",
    """select alert_id, coalesce(id, -1) as slot, cast((select count(*) from levels) as int) as n_slots
from folded left join levels on level = cast(alert_airport_id as varchar)""",
    ALERTS,
    FOLDED,
    _LEVELS.format("(select * from folded where fold <> 0) as train"),
)
