"""Training and out-of-fold scoring with MLlib.

Every prediction published is out of fold: scaler, encoder, model and the
search over parameters see the training part only.

Searches over forests grow this package's own trees (``forest``): settings that
differ by their number of trees are one fit, and no tree takes a job per level.

A training set is encoded once: its vectors are kept on the executors' disks
in parts of bounded size, and every pass of every fit on it reads those.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlift.operators import binning, growth
from alertlift.operators import forest as own_trees
from alertlift.operators.folds import FOLDS, SEED, assign_folds, assign_group_folds
from alertlift.sources.staging import keep_staged, shuffles_dropped, staged_scope

FEATURES = "features"
RAW = "__raw"
LABEL = "label"
TREE_MEMORY_MB = 512
DEPTH_LIMIT = 30
ENCODED = "__h_"
# Rows of a training set per task: fits of trees keep some 250 to 650 bytes a row, and read a part whole in every pass.
PART_ROWS = 262_144
# Rows that fits side by side keep in memory together; larger training sets are fitted one after another.
FIT_ROWS = 32_000_000
# Forests of deeper trees keep the node ids of all rows, which takes more memory than the rows themselves.
SHALLOW = 8

Grid = Mapping[str, Sequence[object]]


def encoder(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list[Estimator]:
    """Stages from raw columns to the ``features`` vector.

    Each text column becomes one 0/1 slot per level.  The slot kept for
    missing and unseen values is the one that is dropped, so those rows get
    zeros and no real level is lost.
    """
    stages: list = []
    if categorical:
        indexed = [f"__i_{c}" for c in categorical]
        encoded = [f"{ENCODED}{c}" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
    else:
        encoded = []
    stages.append(VectorAssembler(inputCols=[*numeric, *encoded], outputCol=FEATURES))
    return stages


@dataclass
class ModelSpec:
    """One entry of the benchmark.

    With a ``grid`` the parameters are searched anew inside every fold:
    ``draws`` distinct combinations, scored by mean absolute error.
    """

    name: str
    make: Callable[[], Estimator]
    scale: bool = False
    grid: Grid | None = None
    draws: int = 0
    inner_folds: int = 3


def _linear() -> Estimator:
    return LinearRegression(
        featuresCol=FEATURES, labelCol=LABEL, regParam=0.0, solver="auto", standardization=True
    )


def forest(**params: object) -> Estimator:
    """Random forest with the defaults this package compares against: all
    features at each split and depth limited by the library only."""
    chosen = {
        "numTrees": 120,
        "maxDepth": DEPTH_LIMIT,
        "featureSubsetStrategy": "all",
        "maxBins": 128,
        "maxMemoryInMB": TREE_MEMORY_MB,
        **params,
    }
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=LABEL,
        seed=SEED,
        **chosen,
    )


def boosted(**params: object) -> Estimator:
    """Gradient-boosted trees; ``lossType="absolute"`` follows the median.

    Trees are shallow, so a row is led to its node anew in every pass: kept
    node ids would be one more table, written and zipped level by level.
    """
    chosen = {
        "maxIter": 500,
        "stepSize": 0.05,
        "maxDepth": 3,
        "maxBins": 128,
        "maxMemoryInMB": TREE_MEMORY_MB,
        **params,
    }
    return GBTRegressor(
        featuresCol=FEATURES,
        labelCol=LABEL,
        seed=SEED,
        cacheNodeIds=False,
        **chosen,
    )


# Published search spaces, in MLlib's parameter names.  Settings
# without a counterpart there are left out; a depth beyond the limit means
# "unlimited".
FOREST_GRID: Grid = {
    "numTrees": [120, 200, 300],
    "maxDepth": [30, 10, 15, 25],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "0.4", "0.6", "0.8"],
    "bootstrap": [True, False],
}
BOOSTED_GRID: Grid = {
    "maxIter": [120, 200, 300],
    "maxDepth": [4, 6, 8],
    "stepSize": [0.03, 0.05, 0.08],
    "minInstancesPerNode": [1, 3, 5],
    "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "all"],
}
ABSOLUTE_GRID: Grid = {
    "maxIter": [400, 600, 900],
    "maxDepth": [4, 6, 8, 10],
    "stepSize": [0.03, 0.05, 0.08],
    "subsamplingRate": [0.8, 1.0],
    "maxBins": [128, 254],
}
WIDE_FOREST_GRID: Grid = {
    "numTrees": [200, 300, 400, 600],
    "maxDepth": [30, 5, 8, 12, 20],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "0.5"],
}
CLASSIC_BOOSTED_GRID: Grid = {
    "maxIter": [300, 500, 700],
    "maxDepth": [3, 4, 5],
    "stepSize": [0.03, 0.05, 0.08],
    "minInstancesPerNode": [2, 4, 6],
}
WIDE_BOOSTED_GRID: Grid = {
    "maxIter": [200, 400, 600, 800],
    "maxDepth": [3, 4, 5, 6, 8],
    "stepSize": [0.02, 0.05, 0.1],
    "minInstancesPerNode": [1, 3, 5],
    "subsamplingRate": [0.7, 0.8, 1.0],
    "featureSubsetStrategy": ["0.7", "0.8", "all"],
}


def main_models() -> list[ModelSpec]:
    """The main benchmark in order of registration (three outer folds)."""
    return [
        ModelSpec("linear_baseline", _linear, scale=True),
        ModelSpec("rf_default", forest),
        ModelSpec("rf_tuned", forest, grid=FOREST_GRID, draws=12),
        ModelSpec("gbt_squared_tuned", boosted, grid=BOOSTED_GRID, draws=6),
        ModelSpec(
            "gbt_absolute_tuned",
            lambda: boosted(lossType="absolute"),
            grid=ABSOLUTE_GRID,
            draws=6,
        ),
    ]


def wide_models() -> list[ModelSpec]:
    """The older, wider comparison (five outer folds)."""
    return [
        ModelSpec("rf_default", lambda: forest(numTrees=300), scale=True),
        ModelSpec("gbr_default", boosted, scale=True),
        ModelSpec("gbt_squared_default", lambda: boosted(maxDepth=6), scale=True),
        ModelSpec("rf_tuned", forest, True, WIDE_FOREST_GRID, 20, 5),
        ModelSpec("gbr_tuned", boosted, True, CLASSIC_BOOSTED_GRID, 15, 5),
        ModelSpec("gbt_squared_tuned", boosted, True, WIDE_BOOSTED_GRID, 25, 5),
    ]


def draw_grid(grid: Grid, draws: int, seed: int = SEED) -> list[dict[str, object]]:
    """Distinct combinations of a grid, drawn with a seed."""
    names = list(grid)
    full = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(full, min(draws, len(full)))


def with_inner_folds(
    df: DataFrame, spec: ModelSpec, key: str = "alert_id", group: str | None = None
) -> DataFrame:
    """Inner fold column of a training part.

    Its seed differs from the outer one: with the same seed an inner fold would
    be an outer fold, and one of them would be empty.
    """
    if group is None:
        return assign_folds(df, key, spec.inner_folds, SEED + 1, "inner_fold")
    return assign_group_folds(df, group, spec.inner_folds, "inner_fold")


def in_parts(train: DataFrame) -> DataFrame:
    """A training set in parts of about ``PART_ROWS`` at most; file splits hold a fixed number of bytes, and far more rows
    the better these compress."""
    parts = -(-train.count() // PART_ROWS)
    return train.repartition(parts) if parts > train.rdd.getNumPartitions() else train


@dataclass
class Coded:
    """A training set as vectors, with the fitted stages that made them."""

    stages: list[Transformer]
    rows: DataFrame
    size: int

    def release(self) -> None:
        self.rows.unpersist()


def encode(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Coded:
    """Fit the encoder and keep the vectors in the parts of ``train``, so that no later pass shuffles or encodes."""
    coder = Pipeline(stages=encoder(numeric, categorical)).fit(train)
    rows = coder.transform(train).select(LABEL, FEATURES).persist(StorageLevel.DISK_ONLY)
    return Coded(coder.stages, rows, rows.count())


@contextmanager
def encoded_folds(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = FOLDS
) -> Iterator[list[Coded]]:
    """The training set outside each fold, for all models that are fitted on it; released on leaving."""
    table = in_parts(df).persist(StorageLevel.DISK_ONLY)
    sets: dict[int, Coded] = {}

    def one(i: int) -> None:
        sets[i] = encode(table.where(F.col("fold") != i), numeric, categorical)

    try:
        try:
            _side_by_side(df.sparkSession, one, range(k), k)
        finally:
            table.unpersist()
        yield [sets[i] for i in range(k)]
    finally:
        for coded in sets.values():
            coded.release()


def _side_by_side(spark: SparkSession, run: Callable, items: Sequence[int], at_once: int) -> list:
    pool = ThreadPool(max(1, min(at_once, len(items))))
    try:
        return pool.map(inheritable_thread_target(spark)(run), items)
    finally:
        pool.close()


def fit(spec: ModelSpec, coded: Coded, setting: Mapping[str, object] | None = None) -> PipelineModel:
    """One model on an encoded training set, from raw columns to the prediction."""
    stages, rows = coded.stages, coded.rows
    if spec.scale:
        rows = rows.withColumnRenamed(FEATURES, RAW)
        scaler = StandardScaler(inputCol=RAW, outputCol=FEATURES, withMean=True, withStd=True).fit(rows)
        *first, assembler = stages
        stages = [*first, assembler.copy({assembler.outputCol: RAW}), scaler]
        rows = scaler.transform(rows)
    model = spec.make()
    model._set(**(setting or {}))
    if isinstance(model, RandomForestRegressor):
        model.setCacheNodeIds(model.getMaxDepth() > SHALLOW)
    return PipelineModel(stages=[*stages, model.fit(rows)])


def best_setting(
    spec: ModelSpec, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), inner: str = "inner_fold"
) -> dict[str, object]:
    """The drawn setting of least mean absolute error over the inner folds; the first one on a tie."""
    settings = draw_grid(spec.grid, spec.draws)
    score = RegressionEvaluator(labelCol=LABEL, metricName="mae")
    errors = [0.0] * len(settings)
    train = in_parts(train).persist(StorageLevel.DISK_ONLY)
    try:
        for j in range(spec.inner_folds):
            coded = encode(train.where(F.col(inner) != j), numeric, categorical)
            held = PipelineModel(coded.stages).transform(train.where(F.col(inner) == j))
            held = held.select(LABEL, FEATURES).persist(StorageLevel.DISK_ONLY)
            try:
                for n, setting in enumerate(settings):
                    *_, scaler, model = fit(spec, coded, setting).stages
                    rows = scaler.transform(held.withColumnRenamed(FEATURES, RAW)) if spec.scale else held
                    errors[n] += score.evaluate(model.transform(rows)) / spec.inner_folds
            finally:
                coded.release()
                held.unpersist()
    finally:
        train.unpersist()
    return settings[errors.index(min(errors))]


OWN = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "bootstrap"}


def drawn_features(strategy: str, p: int) -> int | None:
    """Features drawn per split as the library counts them; None: all."""
    named = {"all": p, "sqrt": math.ceil(p**0.5), "log2": max(1, math.ceil(math.log2(p))), "onethird": math.ceil(p / 3), "auto": math.ceil(p / 3)}
    if strategy in named:
        count = named[strategy]
    else:
        count = int(strategy) if strategy.isdigit() else math.ceil(float(strategy) * p)
    return None if count >= p else max(1, count)


def own_forest(model: RandomForestRegressor, setting: Mapping[str, object], p: int) -> own_trees.Forest:
    """The forest of an estimator under a setting, on ``p`` encoded columns; the library's greatest depth is no limit here."""
    model = model.copy({model.getParam(name): value for name, value in setting.items()})
    depth = model.getMaxDepth()
    rule = growth.Rule(
        None if depth >= DEPTH_LIMIT else depth, model.getMinInstancesPerNode(), per_split=drawn_features(model.getFeatureSubsetStrategy(), p)
    )
    return own_trees.Forest(model.getNumTrees(), rule, model.getBootstrap(), model.getSeed())


def searched_forest(
    df: DataFrame, spec: ModelSpec, numeric: Sequence[str], categorical: Sequence[str], k: int, key: str, keep: Sequence[str]
) -> DataFrame:
    """``out_of_fold`` of a forest whose setting is searched: all drawn settings, all inner and outer folds, own trees."""
    with staged_scope(df.sparkSession), shuffles_dropped(df.sparkSession):
        table = binning.encode(df, numeric, categorical, k, spec.inner_folds, key, keep)
        settings = [own_forest(spec.make(), s, len(table.names)) for s in draw_grid(spec.grid, spec.draws)]
        scored, _ = own_trees.search(table, list(dict.fromkeys(settings)), spec.inner_folds, spec.name)
        return keep_staged(scored.withColumn("fold", F.col("fold").cast(df.schema["fold"].dataType)))


def out_of_fold(
    df: DataFrame,
    spec: ModelSpec,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    k: int = FOLDS,
    key: str = "alert_id",
    group: str | None = None,
    keep: Sequence[str] = ("alert_id", "airport"),
    parallelism: int = 2,
    sets: Sequence[Coded] | None = None,
) -> DataFrame:
    """Prediction of every row by a model that never saw its fold.

    ``df`` carries ``label`` and ``fold`` and should be a staged table: it is
    read with the fold condition pushed to the scan.  ``sets`` are its
    ``encoded_folds``, if other models are fitted on them as well.  The fits
    run side by side on the cluster, as many as ``FIT_ROWS`` allows.
    """
    if spec.grid is not None and set(spec.grid) <= OWN and group is None and isinstance(spec.make(), RandomForestRegressor):
        return searched_forest(df, spec, numeric, categorical, k, key, keep)
    if sets is None:
        with encoded_folds(df, numeric, categorical, k) as own:
            return out_of_fold(df, spec, numeric, categorical, k, key, group, keep, parallelism, own)

    def one(i: int) -> DataFrame:
        setting = None
        if spec.grid is not None:
            train = with_inner_folds(df.where(F.col("fold") != i), spec, key, group)
            setting = best_setting(spec, train, numeric, categorical)
        return fit(spec, sets[i], setting).transform(df.where(F.col("fold") == i))

    at_once = FIT_ROWS // max(1, *[s.size for s in sets])
    parts = _side_by_side(df.sparkSession, one, range(k), min(parallelism, at_once))
    columns = [
        *keep,
        F.lit(spec.name).alias("model"),
        "fold",
        F.col(LABEL).alias("duration_true"),
        F.col("prediction").alias("duration_pred"),
    ]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def refit(
    df: DataFrame,
    spec: ModelSpec,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    key: str = "alert_id",
    group: str | None = None,
) -> PipelineModel:
    """Fit on all rows, for interpretation only."""
    setting = None
    if spec.grid is not None:
        setting = best_setting(spec, with_inner_folds(df, spec, key, group), numeric, categorical)
    coded = encode(in_parts(df), numeric, categorical)
    try:
        return fit(spec, coded, setting)
    finally:
        coded.release()


def importance(model: PipelineModel, df: DataFrame) -> DataFrame | None:
    """``(feature, importance)``: tree importances, or absolute coefficients
    of scaled features.  None if the model has neither or the sizes differ."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = [float(v) for v in last.featureImportances.toArray()]
    elif hasattr(last, "coefficients"):
        values = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        return None
    names = slot_names(model, df)
    if len(names) != len(values):
        return None
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]
    )
    return df.sparkSession.createDataFrame(list(zip(names, values)), schema)


def slot_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Feature names of a fitted pipeline, from the assembler's output schema
    (a scaler behind it forgets them)."""
    rows = df
    for part in model.stages[:-1]:
        rows = part.transform(rows)
        if isinstance(part, VectorAssembler):
            kinds = rows.schema[part.getOutputCol()].metadata["ml_attr"]["attrs"]
            slots = sorted((a for kind in kinds.values() for a in kind), key=lambda a: a["idx"])
            return [a["name"].removeprefix(ENCODED) for a in slots]
    raise ValueError("pipeline without an assembler")


@dataclass
class RunLog:
    """Seconds per model of one benchmark run."""

    run_id: str
    started: float = field(default_factory=time.perf_counter)
    seconds: dict[str, float] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.run_id, m, s) for m, s in self.seconds.items()]
        return spark.createDataFrame(rows, "run_id string, model string, runtime_s double")

    def wall(self, spark: SparkSession) -> DataFrame:
        rows = [(self.run_id, time.perf_counter() - self.started)]
        return spark.createDataFrame(rows, "run_id string, wall_s double")
