"""From a predicted duration to the minute at which an alert may be lifted.

Input is a predictions table with ``duration_true`` and ``duration_pred``.
The error is taken as normal with spread sigma, so an alert is over by minute
t with probability ``normal_cdf((t - pred) / sigma)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlift.functions.normal import normal_cdf, z_score_of
from alertlift.functions.scalar import settle
from alertlift.operators.joins import attach, join_null_safe, with_scopes
from alertlift.operators.quantiles import exact_quantiles

# Horizon, fixed rule, fallback spread and confidence levels.
LAST_MINUTE = 120
FIXED_RULE_MINUTES = 30
SIGMA_WITHOUT_TRUTH = 27.0
REPORT_LEVELS = (70, 75, 80, 85, 88, 90, 92, 94, 95, 96, 97, 98, 99)
POLICY_LEVELS = (70, 75, 80, 85, 90, 95, 99)
DEFAULT_CONFIDENCE = 0.95


def add_residuals(preds: DataFrame) -> DataFrame:
    gap = F.col("duration_true").cast("double") - F.col("duration_pred").cast("double")
    return preds.withColumns({"residual": gap, "abs_residual": F.abs(gap)})


def _sigma(residual: Column) -> Column:
    """Population spread; a spread of zero counts as one minute."""
    spread = settle(F.stddev_pop(residual))
    return F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0))


def residual_sigma(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sigma per group; a constant when the true durations are unknown."""
    if "duration_true" not in preds.columns:
        return preds.groupBy(*by).agg(F.max(F.lit(SIGMA_WITHOUT_TRUTH)).alias("sigma"))
    rows = add_residuals(preds)
    return rows.groupBy(*by).agg(_sigma(F.col("residual")).alias("sigma"))


def with_sigma(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sigma on every row: of the whole table, or of its group.

    Evaluated once, here: the passes that follow see a constant or a small
    broadcast table and do not aggregate the residuals again.
    """
    stats = residual_sigma(preds, by)
    if by:
        return attach(preds, stats, by)
    return preds.withColumn("sigma", F.lit(stats.first()["sigma"]))


def lift_minute(
    pred: Column, sigma: Column, confidence: float, cap: int = LAST_MINUTE
) -> Column:
    """First whole minute in 0..120 at which the alert is over with the given
    confidence; ``cap`` stands for "later than that" (120, or 121 to tell it
    apart).

    The search over 121 probabilities has a closed form, because the normal
    distribution rises with t: ceil(pred + sigma * z).
    """
    exact = pred + sigma * F.lit(z_score_of(confidence))
    # Bounded before the cast, so that no prediction overflows it.
    minute = F.ceil(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), exact)))
    return F.when(exact.isNotNull() & ~F.isnan(exact), minute).cast("int")


def fixed_rule_minute(true_duration: Column) -> Column:
    """The rule in force: lift 30 minutes after the last flash."""
    return true_duration + F.lit(float(FIXED_RULE_MINUTES))


def gains(
    preds: DataFrame,
    confidence: float = DEFAULT_CONFIDENCE,
    cap: int = LAST_MINUTE,
) -> DataFrame:
    """Minutes won per alert; ``preds`` carries ``sigma``."""
    lifted = lift_minute(F.col("duration_pred"), F.col("sigma"), confidence, cap)
    return (
        preds.withColumns(
            {
                "lift_minute": lifted,
                "fixed_rule_minute": fixed_rule_minute(F.col("duration_true")),
            }
        )
        .withColumn("gain", F.col("fixed_rule_minute") - F.col("lift_minute"))
        .withColumn("earlier", (F.col("gain") > 0).cast("int"))
    )


def scoped_sigma(preds: DataFrame, group: str, sigma_scope: str) -> DataFrame:
    """Each row for its group and for the whole table, with the scope's sigma.

    The whole table's sigma is a constant and a group's is joined before rows
    are doubled, so no join sees the scope that holds half of them.
    """
    if sigma_scope == "global":
        return with_scopes(with_sigma(preds), group)
    if sigma_scope != "group":
        raise ValueError("sigma_scope is 'global' or 'group'")
    overall = F.lit(residual_sigma(preds).first()["sigma"])
    rows = with_scopes(with_sigma(preds, [group]), group)
    return rows.withColumn("sigma", F.when(F.col("scope") == "global", overall).otherwise(F.col("sigma")))


def scoped_gains(
    preds: DataFrame,
    group: str = "airport",
    confidence: float = DEFAULT_CONFIDENCE,
    sigma_scope: str = "global",
) -> DataFrame:
    """Gains for every group and the whole table at once.

    ``sigma_scope="global"`` uses one spread for all; ``"group"`` gives each
    scope its own, as if the table had been filtered first.
    """
    narrow = preds.select(group, "duration_true", "duration_pred")
    return gains(scoped_sigma(narrow, group, sigma_scope), confidence)


def kpi_panel(
    preds: DataFrame,
    group: str = "airport",
    confidence: float = DEFAULT_CONFIDENCE,
    sigma_scope: str = "global",
) -> DataFrame:
    """Key figures per group and overall, told apart by ``scope``.

    The lifted minute takes 122 values at most, so its median needs no more
    than that many counters; durations and gains are continuous and go through
    ``exact_quantiles``.
    """
    keys = ["scope", group]
    rows = add_residuals(scoped_gains(preds, group, confidence, sigma_scope))
    figures = rows.groupBy(*keys).agg(
        F.count("*").alias("n_alerts"),
        F.avg("abs_residual").alias("mae"),
        F.max("sigma").alias("sigma"),
        F.avg("gain").alias("mean_gain"),
        F.sum("earlier").alias("n_earlier"),
        (F.lit(100.0) * F.sum("earlier") / F.count("*")).alias("pct_earlier"),
        F.avg("fixed_rule_minute").alias("mean_before"),
        F.avg("lift_minute").alias("mean_after"),
        F.median("lift_minute").alias("median_after"),
    )
    medians = exact_quantiles(
        rows, {"median_before": ("fixed_rule_minute", 0.5), "median_gain": ("gain", 0.5)}, keys
    )
    return join_null_safe(figures, medians, keys, "left")


def gain_verdict(kpis: DataFrame) -> DataFrame:
    """Verdict by the sign of the median gain, and the ten-minute goal."""
    verdict = (
        F.when(F.col("median_gain") > 0, "improvement")
        .when(F.col("median_gain") < 0, "no improvement")
        .when(F.col("median_gain") == 0, "neutral")
    )
    return kpis.withColumns(
        {"verdict": verdict, "mae_below_10": (F.col("mae") < 10).cast("int")}
    )


def _median_minutes(
    rows: DataFrame, levels: Sequence[int], cap: int, by: Sequence[str]
) -> DataFrame:
    """Median lift minute per level, long by level.

    One pass with one aggregate per level instead of a copy of the table per
    level; each keeps 122 counters at most.
    """
    pred, sigma = F.col("duration_pred"), F.col("sigma")
    wide = rows.groupBy(*by).agg(
        *[F.median(lift_minute(pred, sigma, p / 100, cap)).alias(f"m{p}") for p in levels]
    )
    pairs = F.array(
        *[F.struct(F.lit(p).alias("pct"), F.col(f"m{p}").alias("minute")) for p in levels]
    )
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, "p.pct", "p.minute")


def confidence_table(preds: DataFrame, levels: Sequence[int] = REPORT_LEVELS) -> DataFrame:
    """Median minute per confidence level, cut to whole minutes."""
    table = _median_minutes(with_sigma(preds), levels, LAST_MINUTE, [])
    return table.select("pct", F.col("minute").cast("int").alias("median_minute"))


def policy_curve(
    preds: DataFrame,
    group: str = "airport",
    levels: Sequence[int] = POLICY_LEVELS,
    sigma_scope: str = "group",
) -> DataFrame:
    """Median minute per level, group and overall; not capped at the horizon
    (121 means later) and not cut to whole minutes."""
    narrow = preds.select(group, "duration_true", "duration_pred")
    rows = scoped_sigma(narrow, group, sigma_scope)
    return _median_minutes(rows, levels, LAST_MINUTE + 1, ["scope", group]).select(
        "scope", group, "pct", F.col("minute").alias("median_minute")
    )


def over_by(minute: Column) -> Column:
    """Probability that the alert is over by ``minute``."""
    return normal_cdf((minute - F.col("duration_pred")) / F.col("sigma"))


def probability_matrix(preds: DataFrame) -> DataFrame:
    """Alert by minute, long; only for those who ask for all 121 values."""
    minutes = F.explode(F.sequence(F.lit(0), F.lit(LAST_MINUTE)))
    return (
        with_sigma(preds)
        .withColumn("minute", minutes)
        .withColumn("p_over", over_by(F.col("minute").cast("double")))
    )


def median_probability_curve(preds: DataFrame) -> DataFrame:
    """Per minute 0..120, the median over alerts of the probability to be over.

    That probability falls as the prediction rises, so the middle
    probabilities belong to the middle predictions for every minute: two order
    statistics replace 121 medians.
    """
    middle = exact_quantiles(preds, {"pred": ("duration_pred", 0.5)}, neighbours=True)
    sigma = F.lit(residual_sigma(preds).first()["sigma"])
    rows = middle.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(LAST_MINUTE))))
    t = F.col("minute").cast("double")
    at_lower = normal_cdf((t - F.col("pred_low")) / sigma)
    at_upper = normal_cdf((t - F.col("pred_high")) / sigma)
    return rows.select("minute", ((at_lower + at_upper) / 2).alias("median_p_over"))


def gain_identity(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Two identities of the gain table: mean before is mean true duration
    plus 30, mean gain is mean before minus mean after."""
    means = rows.agg(
        F.avg("duration_true").alias("mean_true"),
        F.avg("fixed_rule_minute").alias("mean_before"),
        F.avg("lift_minute").alias("mean_after"),
        F.avg("gain").alias("mean_gain"),
    )
    before = F.abs(F.col("mean_before") - F.col("mean_true") - FIXED_RULE_MINUTES)
    gain = F.abs(F.col("mean_gain") - (F.col("mean_before") - F.col("mean_after")))
    return means.withColumns(
        {
            "before_holds": (before < tolerance).cast("int"),
            "gain_holds": (gain < tolerance).cast("int"),
        }
    )
