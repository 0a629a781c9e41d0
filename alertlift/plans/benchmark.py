"""Model benchmark: score every model out of fold, publish the best one."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.operators import evaluate, footprint
from alertlift.operators import training as tr
from alertlift.operators.folds import FOLDS
from alertlift.sources.staging import stage
from alertlift.sources.writer import write_table


@dataclass
class Benchmark:
    """Tables of one run; ``importance`` is None for a model without any."""

    predictions: DataFrame
    report: DataFrame
    best: str
    best_predictions: DataFrame
    importance: DataFrame | None
    runtime_share: DataFrame
    footprint: DataFrame


def run_benchmark(
    rows: DataFrame,
    specs: Sequence[tr.ModelSpec],
    numeric: Sequence[str],
    categorical: Sequence[str],
    out: str,
    k: int = FOLDS,
    key: str = "alert_id",
    group: str | None = None,
    keep: Sequence[str] = ("alert_id", "airport"),
    run_id: str = "run",
    parallelism: int = FOLDS,
) -> Benchmark:
    """Run ``specs`` in order on a staged table with ``label`` and ``fold``.

    Predictions go below ``run_id`` to one folder per model, so a repeated run
    of one model replaces its own part only and reading the winner skips the
    others.  Each model bears an equal part of the encoding that all share.
    """
    spark = rows.sparkSession
    log = tr.RunLog(run_id)
    folder = f"{out}/{run_id}/predictions"
    start = time.perf_counter()
    with tr.encoded_folds(rows, numeric, categorical, k) as sets:
        shared = (time.perf_counter() - start) / len(specs)
        for spec in specs:
            start = time.perf_counter()
            scored = tr.out_of_fold(
                rows, spec, numeric, categorical, k, key, group, keep, parallelism, sets
            )
            write_table(scored.drop("model"), f"{folder}/model={spec.name}")
            log.seconds[spec.name] = shared + time.perf_counter() - start

    names = [s.name for s in specs]
    # Exactly the models of this run, whatever an earlier one left behind.
    mine = [f"{folder}/model={name}" for name in names]
    predictions = spark.read.option("basePath", folder).parquet(*mine)
    metrics = stage(evaluate.oof_metrics(predictions))
    best = evaluate.best_model(metrics, names).first()["model"]
    timed = evaluate.with_runtime(metrics, log.table(spark))
    report = timed.withColumn("below_10", F.col("mae_min") < 10).orderBy(
        "mae_min", evaluate.model_order(names)
    )

    winner = next(s for s in specs if s.name == best)
    model = tr.refit(rows, winner, numeric, categorical, key, group)
    model.write().overwrite().save(f"{out}/{run_id}/best_model")
    importance = tr.importance(model, rows)

    seconds, wall = log.table(spark), log.wall(spark)
    return Benchmark(
        predictions=predictions,
        report=report,
        best=best,
        best_predictions=evaluate.predictions_of(predictions, best),
        importance=None if importance is None else evaluate.top_features(importance),
        runtime_share=footprint.runtime_share(seconds, wall),
        footprint=footprint.footprint(seconds, wall),
    )
