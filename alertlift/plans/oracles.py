"""DuckDB SQL for the registered queries.

Written the plain way on purpose: the lift minute is searched over the
probabilities of all 121 minutes, medians are taken directly and training
parts are joined, so the SQL checks the shortcuts of the Spark jobs.
"""

from __future__ import annotations

from functools import reduce

from alertlift.functions import normal
from alertlift.plans.views import LINES

ORACLES: dict[str, str] = {}

ALERTS = """
alerts_v as (
  select o_orderkey as alert_id, o_orderpriority as airport, o_custkey as alert_airport_id,
    min(o_orderdate) as start_time, cast(o_orderkey % 24 as int) as start_hour,
    sum(l_quantity)/4 as duration_minutes,
    cast(count(*) as double) as n_lightnings,
    cast(count(*) as double)/(sum(l_quantity)/4) as lightning_per_minute,
    cast(sum(case when l_returnflag='R' then 1 else 0 end) as double)/count(*) as ic_ratio,
    cast(sum(case when l_linestatus='F' then 1 else 0 end) as double)/count(*) as prox_ratio,
    avg(l_quantity) as mean_amplitude, avg(cast(l_linenumber as double)) as mean_dist,
    (max(l_discount)-min(l_discount))/2 as lat_std, (max(l_tax)-min(l_tax))/2 as lon_std,
    max(l_discount)-max(l_tax) as lat_delta, min(l_discount)-min(l_tax) as lon_delta,
    cast(count(*) % 4 as int) as storm_type
  from lineitem join orders on l_orderkey = o_orderkey
  group by o_orderkey, o_orderpriority, o_custkey
)"""

FOLDED = """
folded as (
  select *, cast(('0x' || substr(md5('42:' || cast(alert_id as varchar)), 1, 8))::bigint % 3
    as int) as fold
  from alerts_v
),
held_out as (select distinct fold from folded)"""


def _line(model: str, feature: str) -> str:
    return f"""
  select f.alert_id, f.airport, '{model}' as model, f.fold, f.duration_minutes as duration_true,
    round(l.base + l.slope * f.{feature}, 9) as duration_pred
  from folded f join (
    select h.fold, regr_slope(t.duration_minutes, t.{feature}) as slope,
      regr_intercept(t.duration_minutes, t.{feature}) as base
    from held_out h join folded t on t.fold <> h.fold group by h.fold
  ) l on f.fold = l.fold"""


ALL_PREDS = "preds as (" + "\n  union all".join(_line(m, x) for m, x in LINES.items()) + ")"
PREDS = "preds as (" + _line("ols_n_lightnings", "n_lightnings") + ")"

SIGMA = "coalesce(nullif(round(stddev_pop(duration_true - duration_pred), 9), 0), 1)"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    return reduce(lambda acc, c: f"({acc})*{x}+{c!r}::double", coefficients[1:], f"{coefficients[0]!r}::double")


def cdf(x: str) -> str:
    """The same published approximation as ``functions.normal``."""
    a = f"abs({x})"
    bell = f"exp(-{a}*{a}/2.0::double)"
    near = f"{bell}*({_horner(normal.NUMERATOR, a)})/({_horner(normal.DENOMINATOR, a)})"
    tail = f"({a}+0.65::double)"
    for step in (4, 3, 2, 1):
        tail = f"({a}+{step}.0::double/{tail})"
    upper = (
        f"(case when {a} > 37 then 0.0::double when {a} < {normal.SWITCH!r}::double then {near} "
        f"else {bell}/{tail}/{normal.SQRT_TWO_PI!r}::double end)"
    )
    return f"(case when {x} > 0 then 1.0::double - {upper} else {upper} end)"


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 as {name or expression}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def add(name: str, body: str, *ctes: str) -> None:
    head = "with " + ",".join(ctes) if ctes else ""
    ORACLES[name] = f"{head}\n{body}".strip()


DOUBLES = (
    "n_lightnings",
    "ic_ratio",
    "prox_ratio",
    "mean_amplitude",
    "mean_dist",
    "lat_std",
    "lon_std",
    "lat_delta",
    "lon_delta",
)
STORM = ("ic_ratio", "mean_amplitude", "speed", "lat_std", "lon_std", "mean_dist", "prox_ratio")

# Scans and column choice

add(
    "scan_alerts",
    f"""select alert_id, airport, alert_airport_id, storm_type, start_hour,
  strftime(start_time, '%Y-%m-%d %H:%M:%S') as start_time,
  {r6s("duration_minutes", "lightning_per_minute", *DOUBLES)} from alerts_v""",
    ALERTS,
)
add(
    "select_features",
    f"""select alert_id, airport, alert_airport_id, start_hour, storm_type,
  {r6s(*DOUBLES)}, {r6("duration_minutes", "label")} from alerts_v""",
    ALERTS,
)
add(
    "select_allowed_features",
    f"""select alert_id, airport, cast(start_hour as double) as start_hour,
  {r6s("n_lightnings", "mean_dist", "mean_amplitude")} from alerts_v""",
    ALERTS,
)
add(
    "cluster_label_candidates",
    """select * from (
  select 'storm_type' as candidate, count(distinct storm_type) as n_distinct, 0 as fractional,
    0 as chosen from alerts_v
  union all
  select 'storm_cluster', count(distinct cast(n_lightnings as bigint) % 3), 0, 1 from alerts_v
  union all
  select 'cluster_share', count(distinct ic_ratio),
    max(case when ic_ratio <> floor(ic_ratio) then 1 else 0 end), 0 from alerts_v
  union all
  select 'kmeans', 1, 0, 0
  union all
  select 'storm_type_score', count(distinct prox_ratio),
    max(case when prox_ratio <> floor(prox_ratio) then 1 else 0 end), 0 from alerts_v)""",
    ALERTS,
)
add(
    "cast_categoricals",
    f"""select alert_id, case when start_hour <> 0 then airport else 'nan' end as airport,
  cast(cast(n_lightnings as bigint) % 3 as varchar) as storm_cluster,
  {r6s("n_lightnings", "mean_dist", "mean_amplitude")}, {r6("prox_ratio", "storm_type_score")},
  cast(start_hour as double) as start_hour
from alerts_v""",
    ALERTS,
)

# Features

add(
    "feat_speed",
    f"select alert_id, {r6('sqrt(lat_delta*lat_delta + lon_delta*lon_delta)', 'speed')} from alerts_v",
    ALERTS,
)
add(
    "feat_surface",
    f"select alert_id, {r6('lat_std*lon_std', 'storm_surface')} from alerts_v",
    ALERTS,
)
add(
    "feat_cyclic_hour",
    f"""select alert_id, {r6("sin(2*pi()*start_hour/24)", "hour_sin")},
  {r6("cos(2*pi()*start_hour/24)", "hour_cos")} from alerts_v""",
    ALERTS,
)
add(
    "feat_log1p",
    f"""select alert_id, {r6("ln(1+n_lightnings)", "log_n_lightnings")},
  {r6("ln(1+lightning_per_minute)", "log_lightning_per_minute")},
  {r6("ln(1+lat_std*lon_std)", "log_storm_surface")} from alerts_v""",
    ALERTS,
)
add(
    "clip_p99",
    f"""select alert_id,
  {r6("case when mean_amplitude is null then null else least(mean_amplitude, a) end", "mean_amplitude")},
  {r6("case when lightning_per_minute is null then null else least(lightning_per_minute, b) end", "lightning_per_minute")}
from alerts_v cross join (select quantile_cont(mean_amplitude, 0.99) as a,
  quantile_cont(lightning_per_minute, 0.99) as b from alerts_v)""",
    ALERTS,
)
add(
    "drop_null_features",
    f"""select alert_id, {r6s(*STORM)} from (
  select alert_id, ic_ratio, mean_amplitude, sqrt(lat_delta*lat_delta + lon_delta*lon_delta) as speed,
    lat_std, lon_std, mean_dist, prox_ratio from alerts_v where lat_std <> 0 and lon_std <> 0)""",
    ALERTS,
)
add(
    "filter_airport",
    f"""select alert_id, airport, {r6("duration_minutes")} from alerts_v where airport = '2-HIGH'""",
    ALERTS,
)
add("distinct_airports", "select distinct airport from alerts_v", ALERTS)

SPEEDY = """
speedy as (
  select *, sqrt(lat_delta*lat_delta + lon_delta*lon_delta) as speed from alerts_v
)"""
SCORED = (
    "scored as (select alert_id, storm_type, "
    + ", ".join(
        f"({c} - (select avg({c}) from speedy)) / (select stddev_pop({c}) from speedy) as z_{c}"
        for c in STORM
    )
    + " from speedy)"
)
add(
    "zscore_features",
    "select alert_id, " + r6s(*[f"z_{c}" for c in STORM]) + " from scored",
    ALERTS,
    SPEEDY,
    SCORED,
)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
add(
    "one_hot_airport",
    "select alert_id, "
    + ", ".join(f"""case when airport = '{p}' then 1 else 0 end as "airport_{p}" """ for p in PRIORITIES)
    + "from alerts_v",
    ALERTS,
)

# Trends

add(
    "airport_trends",
    f"""select airport, count(*) as n_alertes,
  {r6("median(duration_minutes)", "duration_minutes_mediane")},
  {r6("avg(duration_minutes)", "duration_minutes_moyenne")},
  {", ".join(r6(f"avg({c})", f"{c}_moyenne") for c in ("start_hour", "n_lightnings", "lightning_per_minute", *DOUBLES[1:]))}
from alerts_v group by airport order by n_alertes desc, airport""",
    ALERTS,
)
add(
    "storm_type_share",
    "select airport, "
    + ", ".join(
        r6(f"100.0::double * sum(case when storm_type = {t} then 1 else 0 end) / count(*)", f"type_{t}")
        for t in range(4)
    )
    + " from alerts_v where airport is not null and storm_type is not null group by airport",
    ALERTS,
)
add(
    "cluster_profile",
    "select storm_type, "
    + ", ".join(r6(f"avg(z_{c})", f"z_{c}") for c in STORM)
    + " from scored group by storm_type",
    ALERTS,
    SPEEDY,
    SCORED,
)

# Folds and evaluation

add("kfold_assign", "select alert_id, fold from folded", ALERTS, FOLDED)
add(
    "group_kfold_assign",
    """select alert_id, a.alert_airport_id, g.fold from alerts_v a join (
  select alert_airport_id, cast((row_number() over (order by n desc,
    substr(md5(cast(alert_airport_id as varchar)), 1, 4), alert_airport_id) - 1) % 3 as int) as fold
  from (select alert_airport_id, count(*) as n from alerts_v group by alert_airport_id)
) g on a.alert_airport_id = g.alert_airport_id""",
    ALERTS,
)
add(
    "oof_linear_1d",
    f"select alert_id, airport, model, fold, {r6s('duration_true', 'duration_pred')} from preds",
    ALERTS,
    FOLDED,
    ALL_PREDS,
)
add(
    "residuals",
    f"""select alert_id, {r6("duration_true - duration_pred", "residual")},
  {r6("abs(duration_true - duration_pred)", "abs_residual")} from preds""",
    ALERTS,
    FOLDED,
    PREDS,
)
SCORES = """
scores as (
  select model, avg(abs(duration_true - duration_pred)) as mae,
    sqrt(avg((duration_true - duration_pred) * (duration_true - duration_pred))) as rmse
  from preds group by model
)"""
ORDER = "case model " + " ".join(f"when '{m}' then {i}" for i, m in enumerate(LINES, 1)) + " end"
add("oof_metrics", f"select model, {r6s('mae', 'rmse')} from scores", ALERTS, FOLDED, ALL_PREDS, SCORES)
add(
    "leaderboard",
    f"""select model, cast({ORDER} as bigint) as model_order, {r6s("mae", "rmse")}
from scores order by scores.mae, model_order""",
    ALERTS,
    FOLDED,
    ALL_PREDS,
    SCORES,
)
BEST = f"best as (select * from scores order by mae, {ORDER} limit 1)"
add("best_model", f"select model, {r6s('mae', 'rmse')} from best", ALERTS, FOLDED, ALL_PREDS, SCORES, BEST)
add(
    "best_predictions",
    f"""select alert_id, model, {r6s("duration_true", "duration_pred")} from preds
where model = (select model from best)""",
    ALERTS,
    FOLDED,
    ALL_PREDS,
    SCORES,
    BEST,
)

RUN_LOG = """
run_log as (
  select o_orderstatus as run_id, case o_orderpriority when '1-URGENT' then 'ols_n_lightnings'
    when '2-HIGH' then 'ols_mean_amplitude' else o_orderpriority end as model,
    cast(count(*) as double) / 4 as runtime_s
  from orders group by all
),
wall as (
  select o_orderstatus as run_id, cast(count(*) as double) / 4 + 17.5 as wall_s from orders group by 1
)"""
add(
    "benchmark_with_runtime",
    f"""select d.run_id, s.model, {r6("mae", "mae_min")}, {r6("rmse", "rmse_min")},
  {r6("coalesce(runtime_s, 0)", "runtime_s")}
from (select distinct run_id from run_log) d cross join scores s
left join run_log r on d.run_id = r.run_id and s.model = r.model""",
    ALERTS,
    FOLDED,
    ALL_PREDS,
    SCORES,
    RUN_LOG,
)
add(
    "preds_with_airport",
    f"""select p.alert_id, a.airport, {r6("p.duration_true", "duration_true")},
  {r6("p.duration_pred", "duration_pred")}
from preds p left join alerts_v a on p.alert_id = a.alert_id""",
    ALERTS,
    FOLDED,
    PREDS,
)

# Decision

SPREAD = f"""
spread as (select *, (select {SIGMA} from preds) as sigma from preds)"""
SCOPED = """
scoped as (
  select 'group' as scope, alert_id, airport, duration_true, duration_pred, sigma from spread
  union all
  select 'global', alert_id, null, duration_true, duration_pred, sigma from spread
)"""
OWN_SCOPED = f"""
both_scopes as (
  select 'group' as scope, alert_id, airport, duration_true, duration_pred from preds
  union all
  select 'global', alert_id, null, duration_true, duration_pred from preds
),
scoped as (
  select b.*, s.sigma from both_scopes b join (
    select scope, airport, {SIGMA} as sigma from both_scopes group by scope, airport
  ) s on b.scope = s.scope and b.airport is not distinct from s.airport
)"""


def probabilities(source: str) -> str:
    return f"""
arguments as (
  select s.*, minute, (cast(minute as double) - duration_pred) / sigma as x
  from {source} s cross join (select unnest(range(0, 121)) as minute)
),
probs as (select *, {cdf("x")} as p_over from arguments)"""


def searched(keys: str) -> str:
    """First minute with enough probability, 121 if there is none."""
    return f"""
lifted as (
  select {keys}, any_value(duration_true) as duration_true, any_value(duration_pred) as duration_pred,
    any_value(sigma) as sigma, any_value(duration_true) + 30 as fixed_rule_minute,
    least(120, coalesce(min(minute) filter (where p_over >= 0.95), 121)) as lift_minute
  from probs group by {keys}
)"""


add(
    "residual_sigma",
    f"select model, {r6(SIGMA, 'sigma')} from preds group by model",
    ALERTS,
    FOLDED,
    ALL_PREDS,
)
add(
    "prob_at_minute",
    f"select alert_id, cast(minute as int) as minute, {r6('p_over')} from probs",
    ALERTS,
    FOLDED,
    PREDS,
    SPREAD,
    probabilities("spread"),
)
LIFT = (ALERTS, FOLDED, PREDS, SPREAD, probabilities("spread"), searched("alert_id"))
add("lift_minute", "select alert_id, cast(lift_minute as int) as lift_minute from lifted", *LIFT)
add(
    "fixed_rule_time",
    f"select alert_id, {r6('duration_minutes + 30', 'fixed_rule_minute')} from alerts_v",
    ALERTS,
)
add(
    "gain_per_alert",
    f"""select alert_id, case when fixed_rule_minute - lift_minute > 0 then 1 else 0 end as earlier,
  {r6("fixed_rule_minute - lift_minute", "gain")} from lifted""",
    *LIFT,
)
add(
    "gain_identity",
    f"""select case when abs(avg(fixed_rule_minute) - avg(duration_true) - 30) < 1e-6 then 1 else 0 end
    as before_holds,
  case when abs(avg(fixed_rule_minute - lift_minute) - (avg(fixed_rule_minute) - avg(lift_minute)))
    < 1e-6 then 1 else 0 end as gain_holds,
  {r6("avg(duration_true)", "mean_true")}, {r6("avg(fixed_rule_minute)", "mean_before")},
  {r6("avg(lift_minute)", "mean_after")}, {r6("avg(fixed_rule_minute - lift_minute)", "mean_gain")}
from lifted""",
    *LIFT,
)
PANEL = """
panel as (
  select scope, airport, count(*) as n_alerts,
    cast(sum(case when fixed_rule_minute > lift_minute then 1 else 0 end) as bigint) as n_earlier,
    avg(abs(duration_true - duration_pred)) as mae, max(sigma) as sigma,
    avg(fixed_rule_minute - lift_minute) as mean_gain,
    100.0::double * sum(case when fixed_rule_minute > lift_minute then 1 else 0 end) / count(*)
      as pct_earlier,
    avg(fixed_rule_minute) as mean_before, avg(lift_minute) as mean_after,
    median(fixed_rule_minute) as median_before, median(cast(lift_minute as double)) as median_after,
    median(fixed_rule_minute - lift_minute) as median_gain
  from lifted group by scope, airport
)"""
KPI_FIGURES = (
    "mae",
    "sigma",
    "mean_gain",
    "pct_earlier",
    "mean_before",
    "mean_after",
    "median_before",
    "median_after",
    "median_gain",
)
KPI = f"select scope, airport, n_alerts, n_earlier, {r6s(*KPI_FIGURES)} from panel"
SCOPE_KEYS = "scope, airport, alert_id"
WHOLE = (ALERTS, FOLDED, PREDS, SPREAD, SCOPED, probabilities("scoped"), searched(SCOPE_KEYS), PANEL)
OWN = (ALERTS, FOLDED, PREDS, OWN_SCOPED, probabilities("scoped"), searched(SCOPE_KEYS), PANEL)
add("kpi_by_airport", KPI, *WHOLE)
add("kpi_by_airport_own_sigma", KPI, *OWN)
add(
    "gain_verdict",
    f"""select scope, airport, case when median_gain > 0 then 'improvement'
    when median_gain < 0 then 'no improvement' else 'neutral' end as verdict,
  case when mae < 10 then 1 else 0 end as mae_below_10, {r6("median_gain")} from panel""",
    *WHOLE,
)


def minutes_at(levels: str, keys: str, cap: int) -> str:
    """Lift minute per alert and level, searched like above."""
    return f"""
at_level as (
  select {keys}, pct,
    least({cap}, coalesce(min(minute) filter (where p_over >= pct / 100.0::double), 121)) as lift_minute
  from probs cross join (values {levels}) as levels(pct) group by {keys}, pct
)"""


REPORT = "(70),(75),(80),(85),(88),(90),(92),(94),(95),(96),(97),(98),(99)"
POLICY = "(70),(75),(80),(85),(90),(95),(99)"
add(
    "confidence_table",
    """select pct, cast(trunc(median(cast(lift_minute as double))) as int) as median_minute
from at_level group by pct""",
    ALERTS,
    FOLDED,
    PREDS,
    SPREAD,
    probabilities("spread"),
    minutes_at(REPORT, "alert_id", 120),
)
add(
    "policy_curve",
    f"""select scope, airport, pct, {r6("median(cast(lift_minute as double))", "median_minute")}
from at_level group by scope, airport, pct""",
    ALERTS,
    FOLDED,
    PREDS,
    OWN_SCOPED,
    probabilities("scoped"),
    minutes_at(POLICY, SCOPE_KEYS, 121),
)
add(
    "median_prob_curve",
    f"""select cast(minute as int) as minute, {r6("median(p_over)", "median_p_over")}
from probs group by minute""",
    ALERTS,
    FOLDED,
    PREDS,
    SPREAD,
    probabilities("spread"),
)

# Footprint

add(
    "runtime_share",
    f"""select l.run_id, l.model, {r6("runtime_s")},
  {r6("100.0::double * runtime_s / greatest(wall_s, 1e-9::double)", "runtime_share_pct")}
from run_log l join wall w on l.run_id = w.run_id""",
    RUN_LOG,
)
add(
    "footprint",
    f"""select run_id, model, {r6("runtime_s")}, 45.0::double as "power_assumed_W",
  {r6("45.0::double * runtime_s / 3600000", '"energy_kWh_estimated"')},
  {r6("45.0::double * runtime_s / 3600000 * 56", '"g_CO2eq_estimated"')},
  56.0::double as "grid_g_CO2_per_kWh_assumed"
from (
  select run_id, model, runtime_s from run_log
  union all
  select run_id, '_TOTAL_modeles_somme_temps', sum(runtime_s) from run_log group by run_id
  union all
  select run_id, '_TOTAL_temps_mur_run', wall_s from wall
)""",
    RUN_LOG,
)

# Checks of trained results

add(
    "oof_coverage",
    f"""select model, fold, count(*) as n, count(*) as n_keys, count(*) as n_predicted,
  {r6("sum(duration_minutes)", "sum_true")}
from folded cross join (values ('linear_baseline'), ('rf_default')) as m(model) group by model, fold""",
    ALERTS,
    FOLDED,
)
add(
    "storm_types_check",
    """select count(*) as n, cast(3 as bigint) as n_types, cast(0 as bigint) as n_stray,
  1 as by_size from speedy""",
    ALERTS,
    SPEEDY,
)
add(
    "storm_pca_check",
    """select count(*) as n, 0.0::double as mean_1, 0.0::double as mean_2, 1 as uncorrelated,
  1 as ordered from speedy""",
    ALERTS,
    SPEEDY,
)
add(
    "importance_check",
    """select feature, 1.0::double as total from (
  select distinct 'airport_' || airport as feature from alerts_v
  union all
  select unnest(['n_lightnings', 'ic_ratio', 'prox_ratio', 'mean_amplitude', 'mean_dist',
    'lat_std', 'lon_std', 'lat_delta', 'lon_delta', 'start_hour']) as feature)""",
    ALERTS,
)
