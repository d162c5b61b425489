"""Cash flows over the test tables: a nation is a case, its suppliers' balances the saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away
from ..operators import finance as f
from ..sources.tables import table
from .utilisation import r

HORIZON, RATE, ESCALATION, DELAY, RAMP = 10, 0.035, 0.02, 1, 3
PARAMETERS = {"rate": (0.02, 0.035, 0.06), "escalation": (0.0, 0.02, 0.04), "saving_scale": (0.8, 1.0, 1.2), "transition_scale": (0.9, 1.0, 1.3)}


def cases(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("case_id")).agg(round_half_away(F.sum(F.greatest("s_acctbal", F.lit(0.0))) / 10, 2).alias("saving"), F.count(F.lit(1)).alias("units"))
    return out.withColumn("transition", round_half_away(F.col("units") * 1000.0 + F.col("saving") * 0.5, 2)).drop("units")


def cashflow(spark: SparkSession, d: str) -> DataFrame:
    return f.cash_flows(cases(spark, d), HORIZON, F.col("saving"), F.col("transition"), F.lit(RATE), F.lit(ESCALATION), F.lit(DELAY), F.lit(RAMP)).drop("saving", "transition")


def cumulative_cashflow(spark: SparkSession, d: str) -> DataFrame:
    return f.cumulative(cashflow(spark, d), ["case_id"]).select("case_id", "year", "cumulative", "cumulative_discounted")


def npv(spark: SparkSession, d: str) -> DataFrame:
    return f.net_present_value(cashflow(spark, d), ["case_id"])


def break_even(spark: SparkSession, d: str) -> DataFrame:
    return f.break_even(cases(spark, d), F.col("transition"), F.col("saving"), F.lit(RATE), F.lit(HORIZON)).drop("saving", "transition")


def _npv_of(p: dict[str, Column]) -> Column:
    return F.col("saving") * p["saving_scale"] * (1 + p["escalation"]) * f.annuity(p["rate"], F.lit(HORIZON)) - F.col("transition") * p["transition_scale"]


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return f.sensitivity(cases(spark, d), PARAMETERS, _npv_of).drop("saving", "transition")


def tornado(spark: SparkSession, d: str) -> DataFrame:
    return f.tornado(sensitivity(spark, d), ["case_id"])


def transition_cost(spark: SparkSession, d: str) -> DataFrame:
    parts = {"change_management": 0.1, "contingency_cost": 0.0, "equipment_move": 0.25, "lease_exit": 0.4, "assessment": 0.05}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("component"), round_half_away(F.col("transition") * v, 2).alias("amount")) for k, v in parts.items()]))
    rows = cases(spark, d).select("case_id", each.alias("c")).select("case_id", "c.component", "c.amount")
    return f.running_contingency(rows, ["case_id"], 0.15)


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    return years.join(years.agg(F.max("year").alias("year")), "year")


QUERIES = {x.__name__: x for x in (cashflow, cumulative_cashflow, npv, break_even, sensitivity, tornado, transition_cost, latest_snapshot)}

_CASES = f"SELECT case_id, saving, {r('(units * 1000.0::DOUBLE + saving * 0.5::DOUBLE)', 2)} AS transition FROM (SELECT s_nationkey AS case_id, {r('(sum(greatest(s_acctbal, 0.0)) / 10)', 2)} AS saving, count(*) AS units FROM supplier GROUP BY 1)"
_FLOW = f"""SELECT case_id, year, benefit, cost, factor, net, {r('(net * factor)', 2)} AS discounted FROM (SELECT *, {r('(benefit - cost)', 2)} AS net FROM (
  SELECT case_id, year, {r(f'(saving * pow(1 + {ESCALATION}::DOUBLE, year - 1) * CASE WHEN year <= {DELAY} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (year - {DELAY})::DOUBLE / {RAMP}) END)', 2)} AS benefit,
    {r('(CASE WHEN year = 1 THEN transition ELSE 0.0::DOUBLE END)', 2)} AS cost, {r(f'(1.0::DOUBLE / pow(1.0::DOUBLE + {RATE}::DOUBLE, year))', 6)} AS factor FROM ({_CASES}), (SELECT unnest(range(1, {HORIZON + 1}))::INTEGER AS year)))"""
_CUM = f"SELECT *, {r('sum(net) OVER w', 2)} AS cumulative, {r('sum(discounted) OVER w', 2)} AS cumulative_discounted FROM ({_FLOW}) WINDOW w AS (PARTITION BY case_id ORDER BY year ROWS UNBOUNDED PRECEDING)"
_ANN = lambda rate: f"((1 - pow(1 + {rate}, -{HORIZON})) / {rate})"


def _sens() -> str:
    out = []
    for k, levels in PARAMETERS.items():
        for name, x in zip(("low", "base", "high"), levels):
            p = {q: f"{v[1]}::DOUBLE" for q, v in PARAMETERS.items()} | {k: f"{float(x)}::DOUBLE"}
            value = f"(saving * {p['saving_scale']} * (1 + {p['escalation']}) * {_ANN(p['rate'])} - transition * {p['transition_scale']})"
            out.append(f"SELECT case_id, '{k}' AS parameter, '{name}' AS level, {float(x)}::DOUBLE AS value, {r(value, 2)} AS npv FROM ({_CASES})")
    return " UNION ALL ".join(out)


_PARTS = {"change_management": 0.1, "contingency_cost": 0.0, "equipment_move": 0.25, "lease_exit": 0.4, "assessment": 0.05}
_COMPONENTS = " UNION ALL ".join(f"SELECT case_id, '{k}' AS component, {r(f'(transition * {v}::DOUBLE)', 2)} AS amount FROM ({_CASES})" for k, v in _PARTS.items())
ORACLE_SQL = {
    "cashflow": _FLOW,
    "cumulative_cashflow": f"SELECT case_id, year, cumulative, cumulative_discounted FROM ({_CUM})",
    "npv": f"""SELECT case_id, {r('sum(discounted)', 2)} AS npv, min(year) FILTER (WHERE cumulative >= 0) AS payback_year, min(year) FILTER (WHERE cumulative_discounted >= 0) AS discounted_payback_year,
      {', '.join(f"{r(f'sum(CASE WHEN year <= {k} THEN net ELSE 0.0 END)', 2)} AS net_{k}y" for k in (1, 3, 5))} FROM ({_CUM}) GROUP BY 1""",
    "break_even": f"SELECT case_id, {r(f'(transition / {HORIZON})', 2)} AS needed_nominal, {r(f'(transition / {_ANN(f'{RATE}::DOUBLE')})', 2)} AS needed_discounted, {r(f'greatest(0.0, transition / {_ANN(f'{RATE}::DOUBLE')} - saving)', 2)} AS gap FROM ({_CASES})",
    "sensitivity": _sens(),
    "tornado": f"SELECT case_id, parameter, impact, row_number() OVER (PARTITION BY case_id ORDER BY impact DESC, parameter)::INTEGER AS rank FROM (SELECT a.case_id, a.parameter, {r('max(abs(a.npv - b.npv))', 2)} AS impact FROM ({_sens()}) a JOIN ({_sens()}) b ON a.case_id = b.case_id AND a.parameter = b.parameter AND b.level = 'base' GROUP BY 1, 2)",
    "transition_cost": f"SELECT case_id, component, {r('(CASE WHEN component = $$contingency_cost$$ THEN coalesce(sum(amount) OVER (PARTITION BY case_id ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) * 0.15::DOUBLE ELSE amount END)', 2)} AS amount FROM ({_COMPONENTS})",
    "latest_snapshot": "SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, count(*) AS orders FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1, 2",
}
