"""Discounted cash flow, payback, sensitivity and break-even.  Closed forms over small grids, fully relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import benefit_ramp, discount_factor, round_half_away


def cash_flows(cases: DataFrame, horizon: int, saving: Column, transition: Column, rate: Column, escalation: Column, delay: Column, ramp: Column) -> DataFrame:
    """A row for each case and year: benefits grow and ramp up, the transition is paid in year 1."""
    keys = cases.columns
    named = cases.withColumns({"_s": saving, "_t": transition, "_r": rate, "_e": escalation, "_d": delay, "_m": ramp})
    years = named.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    benefit = F.col("_s") * F.pow(1 + F.col("_e"), F.col("year") - 1) * benefit_ramp(F.col("year"), F.col("_d"), F.col("_m"))
    out = years.withColumns({"benefit": round_half_away(benefit, 2), "cost": round_half_away(F.when(F.col("year") == 1, F.col("_t")).otherwise(0.0), 2), "factor": round_half_away(discount_factor(F.col("_r"), F.col("year")), 6)})
    out = out.withColumn("net", round_half_away(F.col("benefit") - F.col("cost"), 2)).withColumn("discounted", round_half_away(F.col("net") * F.col("factor"), 2))
    return out.select(*keys, "year", "benefit", "cost", "factor", "net", "discounted")


def cumulative(flows: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return flows.withColumns({"cumulative": round_half_away(F.sum("net").over(w), 2), "cumulative_discounted": round_half_away(F.sum("discounted").over(w), 2)})


def net_present_value(flows: DataFrame, by: list[str], prefixes: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """NPV, payback years (null where never reached), and sums of the first years."""
    run = cumulative(flows, by)
    first = lambda c: F.min(F.when(F.col(c) >= 0, F.col("year")))
    return run.groupBy(*by).agg(
        round_half_away(F.sum("discounted"), 2).alias("npv"), first("cumulative").alias("payback_year"), first("cumulative_discounted").alias("discounted_payback_year"),
        *[round_half_away(F.sum(F.when(F.col("year") <= k, F.col("net")).otherwise(0.0)), 2).alias(f"net_{k}y") for k in prefixes],
    )


def annuity(rate: Column, years: Column) -> Column:
    """Present value of 1 a year."""
    return F.when(rate == 0, years.cast("double")).otherwise((1 - F.pow(1 + rate, -years)) / rate)


def break_even(cases: DataFrame, cost: Column, saving: Column, rate: Column, years: Column) -> DataFrame:
    """The yearly saving that pays the cost back, nominal and discounted, and what is missing."""
    need = F.when(years > 0, cost / annuity(rate, years))
    return cases.withColumns({"needed_nominal": round_half_away(cost / years, 2), "needed_discounted": round_half_away(need, 2), "gap": round_half_away(F.greatest(F.lit(0.0), need - saving), 2)})


def sensitivity(cases: DataFrame, parameters: dict[str, tuple[float, float, float]], npv_of) -> DataFrame:
    """One parameter at a time on three levels: ``npv_of`` maps a dict of columns to the NPV column."""
    base = {k: F.lit(v[1]) for k, v in parameters.items()}
    rows = [F.struct(F.lit(k).alias("parameter"), F.lit(level).alias("level"), F.lit(float(x)).alias("value"), round_half_away(npv_of(base | {k: F.lit(float(x))}), 2).alias("npv")) for k, v in parameters.items() for level, x in zip(("low", "base", "high"), v)]
    return cases.select("*", F.explode(F.array(*rows)).alias("_x")).select(*cases.columns, "_x.parameter", "_x.level", "_x.value", "_x.npv")


def tornado(rows: DataFrame, by: list[str]) -> DataFrame:
    """The largest distance from the base by parameter, ranked."""
    base = rows.where("level = 'base'").select(*by, "parameter", F.col("npv").alias("base_npv"))
    impact = rows.join(base, [*by, "parameter"]).groupBy(*by, "parameter").agg(round_half_away(F.max(F.abs(F.col("npv") - F.col("base_npv"))), 2).alias("impact"))
    return impact.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("impact"), "parameter")))


def running_contingency(components: DataFrame, by: list[str], share: float) -> DataFrame:
    """Contingency on the components that sort before it."""
    w = Window.partitionBy(*by).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("amount").over(w), F.lit(0.0))
    return components.withColumn("amount", round_half_away(F.when(F.col("component") == "contingency_cost", before * share).otherwise(F.col("amount")), 2))
