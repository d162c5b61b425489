"""Formula costs, sensitivities, planning demand and objective parts over the test tables, and what lies outside the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away
from ..operators import costs as c
from ..sources.tables import table
from . import evidence, forecast, reporting
from .utilisation import r

LEVELS = {
    "demand_growth": (-0.01, 0.0, 0.02), "implementation_cost": (0.8, 1.0, 1.3), "transition_cost": (0.9, 1.0, 1.25), "operational_mitigation_cost": (0.7, 1.0, 1.4), "benefit_ramp": (0.6, 1.0, 1.2), "discount_rate": (0.02, 0.035, 0.06),
    "cost_escalation": (0.0, 0.02, 0.04), "forecast_demand_basis": (0.95, 1.0, 1.1), "simulation_risk_adjustment": (0.0, 0.0, 0.1), "building_release_timing": (0.0, 1.0, 2.0),
}
HORIZON, RAMP = 10, 3
WEIGHTS = {"service_relocation_cost": (1.0, 250.0), "disruption_penalty": (0.5, 0.2), "unmet_demand_penalty": (2.0, 1.0), "retained_recurring_cost": (1.0, 0.1), "accessibility_warning_penalty": (1.0, 0.0)}


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Nations as cases: suppliers in debt are released, the others stay; their balances are the money."""
    debt = F.col("s_acctbal") < 0
    money = lambda x: F.sum(x.cast("decimal(18,2)")).cast("double")
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("case_id")).agg(
        F.count(F.when(debt, 1)).alias("released"), F.count(F.when(~debt, 1)).alias("retained"), F.count(F.when(F.col("s_suppkey") % 3 == 0, 1)).alias("moves"),
        money(F.when(debt, -F.col("s_acctbal")).otherwise(0.0)).alias("released_cost"), money(F.greatest("s_acctbal", F.lit(0.0))).alias("balance"),
    )


def transition_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Eight costs of each case, each by its own formula, contingency on what comes before it."""
    released, retained, moves, cost = (F.col(x) for x in ("released", "retained", "moves", "released_cost"))
    components = [
        c.Component("lease_exit_cost", "max(exit cost, released cost * 0.5)", F.when(released > 0, F.greatest(released * 400.0, cost * 0.5)).otherwise(0.0)),
        c.Component("relocation_cost", "moves * 300 + released * 150", moves * 300.0 + released * 150.0),
        c.Component("refurbishment_cost", "retained * 120 * 0.25 + released * 80", retained * 30.0 + released * 80.0),
        c.Component("technology_enablement_cost", "max(500, moves * 40) if any", F.when(moves > 0, F.greatest(F.lit(500.0), moves * 40.0)).otherwise(0.0)),
        c.Component("transition_staffing_cost", "moves * 90 + released * 60", moves * 90.0 + released * 60.0, 2),
        c.Component("change_management_cost", "750 where anything changes", F.when(released + moves > 0, 750.0).otherwise(0.0)),
        c.Component("temporary_dual_running_cost", "released cost * 0.08", cost * 0.08, 2),
        c.Component("contingency_cost", "components before * 0.1", None, 1, 0.1),
    ]
    return c.formula_costs(_cases(spark, d), ["case_id"], components)


def sensitivity_all(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d).select("case_id", round_half_away(F.col("balance") / 10, 2).alias("saving"), round_half_away(F.col("balance") * 0.3, 2).alias("transition"), round_half_away(F.col("released_cost") * 0.1, 2).alias("mitigation"))
    return c.flow_sensitivity(cases, ["case_id"], "saving", "transition", "mitigation", LEVELS, HORIZON, RAMP)


def parameter_ranks(spark: SparkSession, d: str) -> DataFrame:
    return c.ranked_parameters(sensitivity_all(spark, d))


def planning_demand(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of order counts with their 80 % bound where one was back-tested; the home of a priority is the status most of its orders have."""
    rows = reporting.final_forecasts(spark, d)
    points = rows.select("series_id", "h", "forecast")
    bounds = rows.where("upper > forecast").select("series_id", "h", "upper")
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    homes = counts.groupBy("series_id").agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("home"))
    return c.planning_demand(points, bounds, homes, "series_id", ["series_id", "h"], "forecast", "upper", "home")


def objective_parts(spark: SparkSession, d: str) -> DataFrame:
    """What the regional allocation costs, by component."""
    rows = evidence.regional_allocation(spark, d)
    moved = F.col("s_suppkey").isNotNull() & (F.col("source_nation") != F.col("target_nation"))
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("component"), x.cast("double").alias("quantity")) for k, x in (
        ("service_relocation_cost", F.when(moved, 1.0).otherwise(0.0)), ("disruption_penalty", F.when(moved, F.col("amount")).otherwise(0.0)), ("unmet_demand_penalty", F.col("unmet")), ("retained_recurring_cost", F.col("amount")))])))
    return c.objective_parts(each, WEIGHTS)


QUERIES = {f.__name__: f for f in (transition_formulas, sensitivity_all, parameter_ranks, planning_demand, objective_parts)}

_CASES = """SELECT s_nationkey AS case_id, count(*) FILTER (WHERE s_acctbal < 0) AS released, count(*) FILTER (WHERE s_acctbal >= 0) AS retained, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS moves,
  sum((CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE 0.0 END)::DECIMAL(18,2))::DOUBLE AS released_cost, sum(greatest(s_acctbal, 0.0)::DECIMAL(18,2))::DOUBLE AS balance FROM supplier GROUP BY 1"""
_FORMULAS = [
    ("change_management_cost", "750 where anything changes", "CASE WHEN released + moves > 0 THEN 750.0 ELSE 0.0 END", 1), ("lease_exit_cost", "max(exit cost, released cost * 0.5)", "CASE WHEN released > 0 THEN greatest(released * 400.0::DOUBLE, released_cost * 0.5::DOUBLE) ELSE 0.0 END", 1),
    ("refurbishment_cost", "retained * 120 * 0.25 + released * 80", "retained * 30.0 + released * 80.0", 1), ("relocation_cost", "moves * 300 + released * 150", "moves * 300.0 + released * 150.0", 1), ("technology_enablement_cost", "max(500, moves * 40) if any", "CASE WHEN moves > 0 THEN greatest(500.0, moves * 40.0) ELSE 0.0 END", 1),
    ("temporary_dual_running_cost", "released cost * 0.08", "released_cost * 0.08::DOUBLE", 2), ("transition_staffing_cost", "moves * 90 + released * 60", "moves * 90.0 + released * 60.0", 2),
]
_CHANGE = r("(CASE WHEN released + moves > 0 THEN 750.0::DOUBLE ELSE 0.0::DOUBLE END * 0.1::DOUBLE)")
_CF = f"SELECT case_id, {r('(balance / 10)', 2)} AS saving, {r('(balance * 0.3::DOUBLE)', 2)} AS transition, {r('(released_cost * 0.1::DOUBLE)', 2)} AS mitigation FROM ({_CASES})"


def _npv(p: dict[str, str]) -> str:
    ramp = f"least(1.0::DOUBLE, (CASE WHEN y <= {p['building_release_timing']} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (y - {p['building_release_timing']})::DOUBLE / {RAMP}) END) * {p['benefit_ramp']})"
    gain = f"saving * {p['forecast_demand_basis']} * pow(1 + {p['cost_escalation']}, y - 1) * pow(1 + {p['demand_growth']}, y - 1) * {ramp} * (1 - {p['simulation_risk_adjustment']})"
    paid = f"(mitigation * {p['operational_mitigation_cost']} + CASE WHEN y = 1 THEN transition * {p['transition_cost']} * {p['implementation_cost']} ELSE 0.0::DOUBLE END)"
    return r(f"list_reduce(range(1, {HORIZON + 1}), lambda acc, y: acc + ({gain} - {paid}) / pow(1 + {p['discount_rate']}, y), 0.0::DOUBLE)", 2)


def _sensitivity() -> str:
    base = {k: f"{v}::DOUBLE" for k, v in c.BASE.items()}
    rows = []
    for k, levels in LEVELS.items():
        for name, x in zip(("low", "base", "high"), levels):
            rows.append(f"SELECT case_id, '{k}' AS parameter, '{name}' AS level, {float(x)}::DOUBLE AS value, {_npv(base | {k: f'({float(x)}::DOUBLE)'})} AS npv, {_npv(base)} AS base FROM f")
    return f"WITH f AS ({_CF}) SELECT case_id, parameter, level, value, npv, {r('(npv - base)', 2)} AS change FROM ({' UNION ALL '.join(rows)})"


_REGIONAL = evidence.ORACLE_SQL["regional_allocation"]
_MOVED = "s_suppkey IS NOT NULL AND source_nation <> target_nation"
_TERMS = {"service_relocation_cost": f"count(*) FILTER (WHERE {_MOVED})", "disruption_penalty": f"sum(amount) FILTER (WHERE {_MOVED})", "unmet_demand_penalty": "sum(unmet)", "retained_recurring_cost": "sum(amount)", "accessibility_warning_penalty": "sum(0)"}
ORACLE_SQL = {
    "transition_formulas": " UNION ALL ".join(f"SELECT case_id, '{n}' AS component, {r(f'({a})::DOUBLE')} AS amount, '{t}' AS formula, {y} AS year FROM ({_CASES})" for n, t, a, y in _FORMULAS) + f" UNION ALL SELECT case_id, 'contingency_cost', {_CHANGE}, 'components before * 0.1', 1 FROM ({_CASES})",
    "sensitivity_all": _sensitivity(),
    "parameter_ranks": f"SELECT parameter, impact, row_number() OVER (ORDER BY impact DESC, parameter)::INTEGER AS rank FROM (SELECT parameter, max(abs(change)) AS impact FROM ({_sensitivity()}) GROUP BY 1)",
    "planning_demand": f"SELECT series_id, h, {r('forecast')} AS point_demand, {r('greatest(forecast, upper)')} AS planning_demand, CASE WHEN upper > forecast THEN 'upper_bound' ELSE 'point' END AS basis, coalesce(home, 'UNKNOWN') AS home FROM ({reporting.ORACLE_SQL['final_forecasts']}) LEFT JOIN (SELECT o_orderpriority, o_orderstatus AS home FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus DESC) = 1) ON series_id = o_orderpriority",
    "objective_parts": f"SELECT component, quantity, value, {r('(CASE WHEN sum(value) OVER () <> 0 THEN value / sum(value) OVER () ELSE 0.0 END)')} AS share FROM (SELECT component, quantity, {r('(weight * coefficient * quantity)')} AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS component, {w}::DOUBLE AS weight, {x}::DOUBLE AS coefficient, coalesce({_TERMS[k]}, 0)::DOUBLE AS quantity FROM ({_REGIONAL})" for k, (w, x) in WEIGHTS.items()) + "))",
    "series_outside": "SELECT o_orderpriority AS series_id, strftime(o_orderdate, '%Y-%m') AS period, count(*)::DOUBLE AS value FROM orders WHERE o_orderdate IS NULL OR date_trunc('month', o_orderdate) > (SELECT greatest(date_trunc('month', min(o_orderdate)), CASE WHEN last_day(max(o_orderdate)) = max(o_orderdate)::DATE THEN date_trunc('month', max(o_orderdate)) ELSE date_trunc('month', max(o_orderdate)) - INTERVAL 1 MONTH END) FROM orders) GROUP BY 1, 2",
    "final_forecasts_all": f"""SELECT f.series_id, f.model, h, forecast, level, {r('greatest(0.0, forecast - width)')} AS low, {r('(forecast + width)')} AS high FROM (SELECT * FROM ({forecast._ALL}) UNION ALL SELECT * FROM ({forecast._seasonal(forecast._Y, 'series_id')})) f
  JOIN ({forecast.ORACLE_SQL['model_selection_all']}) c ON f.series_id = c.series_id AND f.model = c.model LEFT JOIN ({forecast.ORACLE_SQL['intervals_all']}) w ON w.series_id = f.series_id AND w.model = f.model""",
}
