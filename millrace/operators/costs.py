"""Transition costs by formula, sensitivities over whole cash flows, planning demand and the parts of an objective."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import benefit_ramp, round_half_away


@dataclass(frozen=True)
class Component:
    """A cost of a case: its formula in words and as a column over the case's numbers, and when it falls due.  Without a column it is a share of all components before it by name."""

    name: str
    formula: str
    amount: Column | None
    year: int = 1
    share: float = 0.0


def formula_costs(cases: DataFrame, by: Sequence[str], components: Sequence[Component]) -> DataFrame:
    """A row for each case and component: amount, formula, year.  Components of a case add up in the order of their names."""
    each = [F.struct(F.lit(c.name).alias("component"), (F.lit(None).cast("double") if c.amount is None else round_half_away(c.amount.cast("double"))).alias("own"), F.lit(c.formula).alias("formula"), F.lit(c.year).alias("year"), F.lit(float(c.share)).alias("share")) for c in components]
    rows = cases.select(*by, F.inline(F.array(*each)))
    # a share counts what comes before it, which may hold a share: at most a few components, so a fold over them
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("component", "own", "formula", "year", "share"))).alias("all"))
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<struct<component:string,amount:double,formula:string,year:int>>").alias("rows"))

    def add(acc: Column, x: Column) -> Column:
        amount = F.coalesce(x["own"], round_half_away(acc["total"] * x["share"]))
        return F.struct((acc["total"] + amount).alias("total"), F.concat(acc["rows"], F.array(F.struct(x["component"].alias("component"), amount.alias("amount"), x["formula"].alias("formula"), x["year"].alias("year")))).alias("rows"))

    return lists.select(*by, F.inline(F.aggregate("all", start, add, lambda acc: acc["rows"])))


#: Parameters of a cash flow, at their base.
BASE = {"demand_growth": 0.0, "implementation_cost": 1.0, "transition_cost": 1.0, "operational_mitigation_cost": 1.0, "benefit_ramp": 1.0, "discount_rate": 0.035, "cost_escalation": 0.02, "forecast_demand_basis": 1.0, "simulation_risk_adjustment": 0.0, "building_release_timing": 1.0}


def flow_value(saving: Column, transition: Column, mitigation: Column, p: dict[str, Column], horizon: int, ramp_years: int) -> Column:
    """Net present value of a case over ``horizon`` years.

    Savings grow with escalation and demand, start after the release and ramp
    up, times the ramp's factor and never beyond 1; a risk adjustment takes its share of them.
    Mitigation is paid every year and the transition in the first.
    """

    def year(y: Column) -> Column:
        k = y.cast("double")
        ramp = F.least(F.lit(1.0), benefit_ramp(y, p["building_release_timing"], F.lit(ramp_years)) * p["benefit_ramp"])
        gain = saving * p["forecast_demand_basis"] * F.pow(1 + p["cost_escalation"], k - 1) * F.pow(1 + p["demand_growth"], k - 1) * ramp * (1 - p["simulation_risk_adjustment"])
        paid = mitigation * p["operational_mitigation_cost"] + F.when(y == 1, transition * p["transition_cost"] * p["implementation_cost"]).otherwise(0.0)
        return (gain - paid) / F.pow(1 + p["discount_rate"], k)

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.lit(0.0), lambda acc, y: acc + year(y))


def flow_sensitivity(cases: DataFrame, by: Sequence[str], saving: str, transition: str, mitigation: str, levels: dict[str, tuple[float, float, float]], horizon: int = 10, ramp_years: int = 3) -> DataFrame:
    """A row for each case, parameter and level (low, base, high) with its value, NPV, and distance from the case's NPV at all bases; ranked over all by the largest distance of a parameter."""
    unknown = set(levels) - set(BASE)
    if unknown:
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    rows = F.array(*[F.struct(F.lit(k).alias("parameter"), F.lit(name).alias("level"), F.lit(float(x)).alias("value")) for k, v in levels.items() for name, x in zip(("low", "base", "high"), v)])
    each = cases.select(*by, saving, transition, mitigation, F.inline(rows))
    at = {k: F.when(F.col("parameter") == k, F.col("value")).otherwise(F.lit(v)) for k, v in BASE.items()}
    money = [F.col(c).cast("double") for c in (saving, transition, mitigation)]
    npv = round_half_away(flow_value(*money, at, horizon, ramp_years), 2)
    base = round_half_away(flow_value(*money, {k: F.lit(v) for k, v in BASE.items()}, horizon, ramp_years), 2)
    return each.withColumn("npv", npv).withColumn("change", round_half_away(F.col("npv") - base, 2)).select(*by, "parameter", "level", "value", "npv", "change")


def ranked_parameters(rows: DataFrame) -> DataFrame:
    """Parameters by the largest change that any case sees, over all cases."""
    most = rows.groupBy("parameter").agg(F.max(F.abs("change")).alias("impact"))
    return most.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("impact"), "parameter")))


def planning_demand(points: DataFrame, bounds: DataFrame, homes: DataFrame, entity: str, on: Sequence[str], point: str, upper: str, home: str) -> DataFrame:
    """Demand to plan for: the upper bound of each entity and period where there is one, else the point; with the entity's home, ``UNKNOWN`` where it has none."""
    joined = points.join(bounds.select(*on, upper), list(on), "left").join(homes.select(entity, home), entity, "left")
    return joined.select(*on, round_half_away(F.col(point)).alias("point_demand"), round_half_away(F.coalesce(upper, point)).alias("planning_demand"), F.when(F.col(upper).isNull(), "point").otherwise("upper_bound").alias("basis"), F.coalesce(home, F.lit("UNKNOWN")).alias(home))


def objective_parts(terms: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """component, quantity, value, share of the total: the ``quantity`` of each component times its weight and coefficient; a component without terms is 0."""
    sums = terms.groupBy(F.col("component").alias("of")).agg(F.sum(F.col("quantity").cast("decimal(28,6)")).cast("double").alias("quantity"))
    spark = terms.sparkSession
    table = spark.createDataFrame([(k, float(w), float(c)) for k, (w, c) in weights.items()], "component string, weight double, coefficient double")
    rows = table.join(sums, F.col("component") == F.col("of"), "left").withColumn("quantity", F.coalesce("quantity", F.lit(0.0)))
    rows = rows.withColumn("value", round_half_away(F.col("weight") * F.col("coefficient") * F.col("quantity")))
    total = F.sum(F.col("value").cast("decimal(28,4)")).over(Window.partitionBy(F.lit(0))).cast("double")
    return rows.select("component", "quantity", "value", round_half_away(F.when(total != 0, F.col("value") / total).otherwise(0.0)).alias("share"))


def recurring_components(parents: DataFrame, released: str, classes: dict[str, str]) -> DataFrame:
    """What each component of recurring cost is in all, and without the released parents; one row for each of ``classes``.

    ``classes`` name the columns of ``parents`` that are components, and how
    each behaves: a ``variable`` one stays while nothing is released, of a
    ``semi_variable`` one a floor stays with the parents that are kept.  Null
    amounts count 0, a null mark is not released; without parents all is 0.
    """
    money = lambda x: F.coalesce(F.sum(x.cast("decimal(24,4)")), F.lit(0)).cast("double")
    gone = F.coalesce(F.col(released).cast("boolean"), F.lit(False))
    sums = parents.agg(F.coalesce(F.max(gone), F.lit(False)).alias("some"), *[money(x).alias(f"{part}_{i}") for i, k in enumerate(classes) for part, x in (("all", F.col(k)), ("gone", F.when(gone, F.col(k))))])
    each = [F.struct(F.lit(k).alias("component"), F.lit(kind).alias("classification"), F.col(f"all_{i}").alias("base"), F.col(f"gone_{i}").alias("removed")) for i, (k, kind) in enumerate(classes.items())]
    rows = sums.select("some", F.inline(F.array(*each)))
    kind = F.col("classification")
    treatment = F.when((kind == "variable") & ~F.col("some"), "kept_without_release").when((kind == "semi_variable") & F.col("some"), "removed_with_floor").when(F.col("removed") != 0, "removed").otherwise("retained")
    return rows.select("component", "classification", round_half_away(F.col("base")).alias("baseline"), round_half_away(F.col("base") - F.col("removed")).alias("case_amount"), round_half_away(F.col("removed")).alias("difference"), treatment.alias("treatment"))
