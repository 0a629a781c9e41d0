"""Storm types: k-means and a two-dimensional projection of z-scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.operators.features import drop_incomplete, z_scores
from alertlift.sources.schema import STORM_FEATURES
from alertlift.sources.staging import stage

# Number of types, seed and restarts.
TYPES = 3
SEED = 42
RESTARTS = 10
MAX_ITERATIONS = 300
CENTRE_SHIFT = 1e-4
PARALLEL_STARTS = 5


@dataclass
class StormTypes:
    """Labelled alerts with the fitted models.

    ``order[i]`` is the storm type given to centre ``i``: types are numbered
    by size, largest first, so that a rerun names them alike.
    """

    alerts: DataFrame
    kmeans: KMeansModel
    pca: PCAModel
    order: list[int]


def scaled_vectors(
    df: DataFrame, columns: Sequence[str] = STORM_FEATURES, name: str = "z"
) -> DataFrame:
    """Rows with all features present, plus the vector of their z-scores."""
    scored = z_scores(drop_incomplete(df, columns), columns, "__z_")
    inputs = [f"__z_{c}" for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol=name).transform(scored).drop(*inputs)


def fit_kmeans(
    vectors: DataFrame,
    k: int = TYPES,
    seed: int = SEED,
    restarts: int = RESTARTS,
    parallelism: int = PARALLEL_STARTS,
    name: str = "z",
) -> KMeansModel:
    """Best of several starts by training cost; the lowest seed wins a tie.

    The starts run side by side over one shared copy of the vectors, which
    spills to disk where memory is short.  Equal vectors are in it once, with
    their number as weight.  The block solver takes a block of rows at a time,
    so reading that copy in every iteration stays cheap.
    """

    def run(offset: int) -> KMeansModel:
        return KMeans(
            featuresCol=name,
            predictionCol="centre",
            k=k,
            seed=seed + offset,
            initMode="k-means||",
            maxIter=MAX_ITERATIONS,
            tol=CENTRE_SHIFT,
            solver="block",
            weightCol="__weight",
        ).fit(shared)

    # Staged, so that the copy has partitions by its size and not those of the shuffle.
    counted = stage(vectors.groupBy(vector_to_array(F.col(name)).alias("x")).agg(F.count("*").cast("double").alias("__weight")))
    shared = counted.select(array_to_vector(F.col("x")).alias(name), "__weight").persist(StorageLevel.MEMORY_AND_DISK)
    pool = ThreadPool(max(1, min(parallelism, restarts)))
    try:
        models = pool.map(inheritable_thread_target(vectors.sparkSession)(run), range(restarts))
        best = min(models, key=lambda m: m.summary.trainingCost)
        # The summary counts distinct vectors; sizes are numbers of alerts.
        sizes = dict(best.transform(shared).groupBy("centre").agg(F.sum("__weight")).collect())
    finally:
        pool.close()
        shared.unpersist()
    best.alert_counts = [int(sizes.get(i, 0)) for i in range(k)]
    return best


def size_order(model: KMeansModel) -> list[int]:
    """Storm type per centre, by the number of alerts; for a model of ``fit_kmeans``."""
    sizes = model.alert_counts
    ranked = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    return [ranked.index(i) for i in range(len(sizes))]


def label_storms(vectors: DataFrame, model: KMeansModel, order: Sequence[int]) -> DataFrame:
    types = F.array(*[F.lit(t) for t in order])
    labelled = model.transform(vectors)
    return labelled.withColumn("storm_type", F.element_at(types, F.col("centre") + 1)).drop(
        "centre"
    )


def fit_pca(vectors: DataFrame, name: str = "z") -> PCAModel:
    return PCA(k=2, inputCol=name, outputCol="__scores").fit(vectors)


def loadings(model: PCAModel) -> list[list[float]]:
    """Loadings per component with a fixed sign: the largest one is positive."""
    fixed = []
    for j in range(2):
        column = [float(v) for v in model.pc.toArray()[:, j]]
        flip = -1.0 if max(column, key=abs) < 0 else 1.0
        fixed.append([flip * v for v in column])
    return fixed


def project_storms(vectors: DataFrame, model: PCAModel, name: str = "z") -> DataFrame:
    """``pca_1`` and ``pca_2``; the z-scores are centred already, which the
    library's transform would not do."""
    values = vector_to_array(F.col(name))
    scores = {}
    for j, column in enumerate(loadings(model), start=1):
        terms = [values[i] * F.lit(w) for i, w in enumerate(column)]
        scores[f"pca_{j}"] = sum(terms[1:], terms[0])
    return vectors.withColumns(scores)


def type_storms(
    df: DataFrame,
    k: int = TYPES,
    seed: int = SEED,
    restarts: int = RESTARTS,
    parallelism: int = PARALLEL_STARTS,
    columns: Sequence[str] = STORM_FEATURES,
) -> StormTypes:
    """Cluster and project all alerts that have the seven features."""
    vectors = stage(scaled_vectors(df, columns))
    kmeans = fit_kmeans(vectors, k, seed, restarts, parallelism)
    pca = fit_pca(vectors)
    order = size_order(kmeans)
    alerts = project_storms(label_storms(vectors, kmeans, order), pca).drop("z")
    return StormTypes(alerts, kmeans, pca, order)


def cluster_profile(df: DataFrame, columns: Sequence[str] = STORM_FEATURES) -> DataFrame:
    """Mean z-score of each feature per storm type."""
    scored = z_scores(drop_incomplete(df, columns), columns)
    return scored.groupBy("storm_type").agg(*[F.avg(f"z_{c}").alias(f"z_{c}") for c in columns])
