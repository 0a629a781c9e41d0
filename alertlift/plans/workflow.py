"""The whole job: type storms, compare models, report trends, decide minutes.

    python -m alertlift.plans.workflow INPUT OUTPUT [--k 3] [--clustered]

Each stage takes and returns DataFrames; tables under OUTPUT are the boundary
where a fitted model or a label is reused.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlift.operators import decision, features, storms, trends
from alertlift.operators import training as tr
from alertlift.operators.folds import FOLDS, assign_folds, assign_group_folds
from alertlift.plans.benchmark import Benchmark, run_benchmark
from alertlift.sources import schema
from alertlift.sources.reader import load_alerts
from alertlift.sources.staging import keep_staged, stage, staged_scope
from alertlift.sources.writer import write_table

# Known only once the alert is over, or keys: never features unless asked for.
NEVER_FEATURES = ("alert_id", "alert_airport_id", "end_time", "last_cloud_ground_time")


def cluster_stage(alerts: DataFrame, out: str, k: int = storms.TYPES) -> DataFrame:
    """Features, storm types and projection, written as the clustered table."""
    typed = storms.type_storms(features.storm_features(stage(alerts)), k=k)
    path = write_table(typed.alerts, f"{out}/clustered_alerts")
    return alerts.sparkSession.read.schema(typed.alerts.schema).parquet(path)


def model_columns(
    alerts: DataFrame, exclude: Sequence[str] = ()
) -> tuple[list[str], list[str]]:
    """All numeric and text features but the target, keys and ``exclude``;
    timestamps are neither."""
    target = schema.target_column(alerts.columns)
    skip = {target, *NEVER_FEATURES, *exclude}
    numeric, text = [], []
    for f in alerts.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            text.append(f.name)
    return numeric, text


def model_stage(
    alerts: DataFrame,
    out: str,
    specs: Sequence[tr.ModelSpec] | None = None,
    exclude: Sequence[str] = (),
    group: str | None = None,
    k: int = FOLDS,
    key: str = "alert_id",
) -> Benchmark:
    """Benchmark on the alerts; plain folds, or folds that keep ``group``
    together."""
    numeric, text = model_columns(alerts, exclude)
    target = schema.target_column(alerts.columns)
    columns = dict.fromkeys([key, "airport", *([group] if group else []), *numeric, *text])
    rows = alerts.select(
        *[c for c in columns if c in alerts.columns], F.col(target).cast("double").alias("label")
    )
    folded = assign_group_folds(rows, group, k) if group else assign_folds(rows, key, k)
    result = run_benchmark(
        stage(folded), specs or tr.main_models(), numeric, text, out, k, key, group
    )
    write_table(result.report, f"{out}/benchmark", "csv")
    write_table(result.best_predictions, f"{out}/best_predictions")
    write_table(result.runtime_share, f"{out}/runtime_share", "csv")
    write_table(result.footprint, f"{out}/footprint", "csv")
    if result.importance is not None:
        write_table(result.importance, f"{out}/importance", "csv")
    return result


def wide_comparison(
    alerts: DataFrame,
    out: str,
    specs: Sequence[tr.ModelSpec] | None = None,
    k: int = 5,
    key: str = "alert_id",
) -> Benchmark:
    """The older comparison: allow-listed features plus detected clustering
    columns, five folds, more models.  Its predictions are out of fold, too."""
    numeric, categorical = schema.with_cluster_columns(alerts)
    target = schema.target_column(alerts.columns)
    label = F.col(target).cast("double").alias("label")
    columns = dict.fromkeys([key, "airport", *numeric, *categorical])
    rows = schema.cast_categoricals(alerts.select(*columns, label), categorical)
    folded = stage(assign_folds(rows, key, k))
    result = run_benchmark(
        folded, specs or tr.wide_models(), numeric, categorical, out, k, key, run_id="wide"
    )
    write_table(result.report, f"{out}/comparison", "csv")
    write_table(result.best_predictions, f"{out}/best_predictions")
    return result


def trend_stage(alerts: DataFrame, out: str) -> None:
    write_table(trends.airport_trends(alerts), f"{out}/airport_trends", "csv")
    if "storm_type" in alerts.columns:
        shares = trends.storm_type_share(alerts, trends.present_types(alerts))
        write_table(shares, f"{out}/storm_type_share", "csv")


def decision_stage(
    preds: DataFrame, out: str, confidence: float = decision.DEFAULT_CONFIDENCE
) -> None:
    """Confidence table, policy curve, key figures with verdict, gain checks."""
    write_table(decision.confidence_table(preds), f"{out}/confidence_table", "csv")
    write_table(decision.policy_curve(preds), f"{out}/policy_curve", "csv")
    for scope in ("global", "group"):
        kpis = decision.kpi_panel(preds, confidence=confidence, sigma_scope=scope)
        write_table(decision.gain_verdict(kpis), f"{out}/kpi_sigma_{scope}", "csv")
    rows = decision.gains(decision.with_sigma(preds), confidence)
    check = decision.gain_identity(rows).first()
    if not (check["before_holds"] and check["gain_holds"]):
        raise ValueError(f"gain table is inconsistent: {check}")


def run(
    spark: SparkSession,
    source: str | Sequence[str],
    out: str,
    fmt: str = "csv",
    k: int = storms.TYPES,
    clustered: bool = False,
    specs: Sequence[tr.ModelSpec] | None = None,
    exclude: Sequence[str] = (),
    group: str | None = None,
    confidence: float = decision.DEFAULT_CONFIDENCE,
) -> Benchmark:
    """All stages; ``clustered=True`` takes the storm types from the input."""
    alerts = load_alerts(spark, source, fmt=fmt)
    if "alert_id" not in alerts.columns:
        raise ValueError("alerts need a key column alert_id")
    with staged_scope(spark):
        typed = stage(alerts) if clustered else cluster_stage(alerts, out, k)
        result = model_stage(typed, out, specs, exclude, group)
        trend_stage(typed, out)
        decision_stage(result.best_predictions, out, confidence)
        # The report outlives the scope; all other tables of the run are files below ``out``.
        return replace(result, report=keep_staged(result.report))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("source", nargs="+", help="input, or fallbacks in order")
    parser.add_argument("out")
    parser.add_argument("--format", default="csv")
    parser.add_argument("--k", type=int, default=storms.TYPES)
    parser.add_argument("--clustered", action="store_true")
    parser.add_argument("--exclude", nargs="*", default=[])
    parser.add_argument("--group")
    parser.add_argument("--confidence", type=float, default=decision.DEFAULT_CONFIDENCE)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("alertlift").getOrCreate()
    result = run(
        spark,
        args.source,
        args.out,
        args.format,
        args.k,
        args.clustered,
        exclude=args.exclude,
        group=args.group,
        confidence=args.confidence,
    )
    result.report.show(truncate=False)


if __name__ == "__main__":
    main()
