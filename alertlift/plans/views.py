"""Alert-shaped views over the star-schema test tables.

One order with its lines plays one alert.  Quantities are whole numbers and
spreads are max - min, so every column is the same whatever the order of
summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.operators.folds import assign_folds, oof_lines
from alertlift.sources.staging import stage

# Model name -> its one feature.
LINES = {
    "ols_n_lightnings": "n_lightnings",
    "ols_mean_amplitude": "mean_amplitude",
    "ols_mean_dist": "mean_dist",
}
NUMERIC = (
    "n_lightnings",
    "ic_ratio",
    "prox_ratio",
    "mean_amplitude",
    "mean_dist",
    "lat_std",
    "lon_std",
    "lat_delta",
    "lon_delta",
    "start_hour",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are aggregated per order before the join: map-side combining
    shrinks the large side first, and the join reuses its partitioning."""
    flag = lambda c, v: F.sum(F.when(F.col(c) == v, 1).otherwise(0)).cast("double")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.count("*").cast("double").alias("lines"),
            flag("l_returnflag", "R").alias("returned"),
            flag("l_linestatus", "F").alias("finished"),
            F.avg("l_quantity").alias("mean_amplitude"),
            F.avg(F.col("l_linenumber").cast("double")).alias("mean_dist"),
            F.max("l_discount").alias("max_discount"),
            F.min("l_discount").alias("min_discount"),
            F.max("l_tax").alias("max_tax"),
            F.min("l_tax").alias("min_tax"),
        )
    )
    duration = F.col("quantity") / 4
    return lines.join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_orderpriority").alias("airport"),
        F.col("o_custkey").alias("alert_airport_id"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderkey") % 24).cast("int").alias("start_hour"),
        duration.alias("duration_minutes"),
        F.col("lines").alias("n_lightnings"),
        (F.col("lines") / duration).alias("lightning_per_minute"),
        (F.col("returned") / F.col("lines")).alias("ic_ratio"),
        (F.col("finished") / F.col("lines")).alias("prox_ratio"),
        "mean_amplitude",
        "mean_dist",
        ((F.col("max_discount") - F.col("min_discount")) / 2).alias("lat_std"),
        ((F.col("max_tax") - F.col("min_tax")) / 2).alias("lon_std"),
        (F.col("max_discount") - F.col("max_tax")).alias("lat_delta"),
        (F.col("min_discount") - F.col("min_tax")).alias("lon_delta"),
        (F.col("lines") % 4).cast("int").alias("storm_type"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order status; two models carry names of ``LINES``."""
    model = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "ols_n_lightnings")
        .when(F.col("o_orderpriority") == "2-HIGH", "ols_mean_amplitude")
        .otherwise(F.col("o_orderpriority"))
    )
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("run_id"), model.alias("model"))
        .agg((F.count("*") / 4.0).alias("runtime_s"))
    )


def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("run_id"))
        .agg((F.count("*") / 4.0 + 17.5).alias("wall_s"))
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with ``label`` and the outer ``fold``."""
    rows = alerts(spark, sf_dir).withColumn("label", F.col("duration_minutes"))
    return assign_folds(rows)


def predictions(spark: SparkSession, sf_dir: str, models: dict[str, str] = LINES) -> DataFrame:
    """Out-of-fold predictions of the one-feature lines, long by model.

    The few columns needed are staged once; fit, prediction and every later
    pass over the result read that table.
    """
    rows = labelled(spark, sf_dir).select(
        "alert_id", "airport", "fold", "label", *models.values()
    )
    return oof_lines(stage(rows), models)


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the first line only."""
    return predictions(spark, sf_dir, {"ols_n_lightnings": "n_lightnings"})
