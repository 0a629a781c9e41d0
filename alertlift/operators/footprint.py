"""Compute footprint from a run log ``(run_id, model, runtime_s)`` and a wall
clock table ``(run_id, wall_s)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Assumed power, grid intensity and names of the total rows.
POWER_W = 45.0
GRID_G_PER_KWH = 56.0
SUM_ROW = "_TOTAL_modeles_somme_temps"
WALL_ROW = "_TOTAL_temps_mur_run"
JOULES_PER_KWH = 3_600_000.0


def runtime_share(run_log: DataFrame, wall: DataFrame) -> DataFrame:
    """Share of the wall time per model; shares need not add up to 100."""
    share = F.lit(100.0) * F.col("runtime_s") / F.greatest(F.col("wall_s"), F.lit(1e-9))
    return run_log.join(wall, "run_id").select(
        "run_id", "model", "runtime_s", share.alias("runtime_share_pct")
    )


def _energy(seconds: Column) -> Column:
    return F.lit(POWER_W) * seconds / F.lit(JOULES_PER_KWH)


def _estimate(rows: DataFrame, seconds: str) -> DataFrame:
    kwh = F.col("kwh")
    return rows.withColumn("kwh", _energy(F.col(seconds))).select(
        "run_id",
        "model",
        F.col(seconds).alias("runtime_s"),
        F.lit(POWER_W).alias("power_assumed_W"),
        kwh.alias("energy_kWh_estimated"),
        (kwh * F.lit(GRID_G_PER_KWH) / F.lit(1000.0)).alias("kg_CO2eq_estimated"),
        F.lit(GRID_G_PER_KWH).alias("grid_g_CO2_per_kWh_assumed"),
    )


def footprint(run_log: DataFrame, wall: DataFrame) -> DataFrame:
    """Energy and CO2 per model, plus the sum over models and the wall time
    of each run."""
    sums = run_log.groupingSets(
        [["run_id", "model"], ["run_id"]], "run_id", "model"
    ).agg(F.sum("runtime_s").alias("runtime_s"), F.grouping("model").alias("total"))
    named = sums.withColumn(
        "model", F.when(F.col("total") == 1, F.lit(SUM_ROW)).otherwise(F.col("model"))
    )
    clock = wall.withColumn("model", F.lit(WALL_ROW))
    return _estimate(named, "runtime_s").unionByName(_estimate(clock, "wall_s"))
