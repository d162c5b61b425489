"""Monthly series and scenarios that are defined as data, not as code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away

_EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Definition:
    """One target: the sum of ``measure`` (two places) by ``entity`` and month, over rows where ``where`` holds."""

    target: str
    entity: Column
    measure: Column
    where: Column | None = None


def observed(facts: DataFrame, stamp: str, definitions: Sequence[Definition]) -> DataFrame:
    """target, entity, period (first of the month), cents: all definitions of a fact table in one pass.

    Each row gives one entry for each definition that it fits; entries are
    summed before they move.  A null entity or stamp is no entry; a null measure counts 0.
    """
    month = F.trunc(F.col(stamp), "month")
    each = [F.struct(F.lit(x.target).alias("target"), x.entity.cast("string").alias("entity"), F.round(F.coalesce(x.measure, F.lit(0)).cast("decimal(20,2)") * 100).cast("long").alias("cents"), F.coalesce(F.lit(True) if x.where is None else x.where, F.lit(False)).alias("fits")) for x in definitions]
    rows = facts.select(month.alias("period"), F.inline(F.array(*each))).where("fits AND entity IS NOT NULL AND period IS NOT NULL")
    return rows.groupBy("target", "entity", "period").agg(F.sum(F.col("cents").cast(_EXACT)).alias("cents"))


def dense(rows: DataFrame) -> DataFrame:
    """All months from the first to the last of the fact table for each of its series; ``imputation_flag`` tells those that had no rows, which are 0."""
    ends = rows.agg(F.min("period").alias("low"), F.max("period").alias("high"))
    months = rows.select("target", "entity").distinct().join(F.broadcast(ends)).select("target", "entity", F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("period"))
    joined = months.join(rows, ["target", "entity", "period"], "left")
    return joined.select("target", "entity", "period", F.coalesce("cents", F.lit(0).cast(_EXACT)).alias("cents"), F.when(F.col("cents").isNull(), "zero_filled").otherwise("observed").alias("imputation_flag"))


def assessed(series: DataFrame, least: int = 18, most_missing: float = 0.2, least_non_zero: int = 12, most_interval: float = 2.0) -> DataFrame:
    """Seven states in order, with diagnostics to six places, for each (target, entity).

    Sums of whole cents are exact, so no order of rows moves a diagnostic; the
    mean interval between months with a value is the span from the first to the
    last over their number less one, so no series is ordered.
    """
    place = F.months_between(F.col("period"), F.lit("1970-01-01").cast("date")).cast("int")
    some, more = F.col("cents") != 0, F.col("cents") > 0
    at = series.withColumn("at", place)
    top = F.max("at")
    square = (F.col("cents") * F.col("cents")).cast(_EXACT)
    sums = at.groupBy("target", "entity").agg(
        F.count(F.lit(1)).alias("periods"), F.count(F.when(some, 1)).alias("non_zero"), F.count(F.when(F.col("imputation_flag") != "observed", 1)).alias("missing"), top.alias("last"), F.max(F.when(more, F.col("at"))).alias("last_positive"),
        F.min(F.when(some, F.col("at"))).alias("first_at"), F.max(F.when(some, F.col("at"))).alias("last_at"), F.sum("cents").alias("s"), F.sum(square).alias("q"),
        F.count(F.when(more, 1)).alias("m"), F.sum(F.when(more, F.col("cents"))).alias("ps"), F.sum(F.when(more, square)).alias("pq"),
    )
    wide = lambda c: F.col(c).cast(_EXACT)
    spread = lambda n, q, s: (wide(n) * wide(q)).cast(_EXACT) - (wide(s) * wide(s)).cast(_EXACT)
    six = lambda c: round_half_away(c, 6)
    n, d = F.col("periods"), lambda c: c.cast("double")
    out = sums.withColumns(
        {
            "missing_ratio": six(F.col("missing") / d(n)),
            "variance": six(F.when(n > 1, d(spread("periods", "q", "s")) / d(n * (n - 1)) / 10000.0).otherwise(0.0)),
            "non_zero_ratio": six(F.col("non_zero") / d(n)),
            "average_interval": six(F.when(F.col("non_zero") > 1, (F.col("last_at") - F.col("first_at")) / d(F.col("non_zero") - 1))),
            "squared_cv": six(F.when(F.col("m") > 1, d(F.col("m")) * d(spread("m", "pq", "ps")) / (d(F.col("m") - 1) * d(F.col("ps")) * d(F.col("ps"))))),
            "recent": F.coalesce(F.col("last_positive") > F.col("last") - 3, F.lit(False)),
        }
    )
    state = (
        F.when(n < least, "insufficient_history").when(F.col("missing_ratio") > most_missing, "quality_blocked").when((F.col("non_zero") == 0) | ~F.col("recent"), "inactive_series")
        .when(F.col("non_zero") < least_non_zero, "too_sparse").when(F.col("variance") == 0, "constant_series").when(F.col("average_interval") > most_interval, "baseline_only").otherwise("eligible")
    )
    return out.select("target", "entity", "periods", "non_zero", "missing_ratio", "variance", "non_zero_ratio", "average_interval", "squared_cv", "recent", state.alias("status"))


@dataclass(frozen=True)
class Scenario:
    """How demand and units change: ``release`` units with the least use are given up."""

    name: str
    demand_factor: float
    release: int


#: Parts of the absolute difference of recurring cost that each exposure is.
EXPOSURES = {"transition": 0.15, "planned_capital": 0.10, "exit": 0.05, "relocation": 0.08}


def composite(units: DataFrame, key: str, use: str, capacity: str, cost: str, scenarios: Sequence[Scenario], contingency: float = 0.15, margin: float = 0.1) -> DataFrame:
    """All results of all scenarios as one relation: scenario, relation, item, value, status.

    ``units`` has whole numbers for use, capacity and cost.  The scenarios are
    a small table that each unit is joined to once; the units of least use are a top-k, and what
    each scenario keeps is one aggregation.  Capacity, costs, exposures, constraints, risks, confidence and
    feasibility then follow from one row for each scenario, stacked as tagged
    rows, so units are read once for their sums and once for the top-k.
    """
    most = max(s.release for s in scenarios)
    least = units.orderBy(use, key).limit(max(most, 1)).select(F.col(key).alias("given"), use)
    order = F.transform(F.sort_array(F.collect_list(F.struct(use, "given"))), lambda x: x["given"])
    places = least.agg(order.alias("given")).select(F.posexplode("given").alias("place", "given"))
    params = F.inline(F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.lit(float(s.demand_factor)).alias("factor"), F.lit(s.release).alias("release")) for s in scenarios]))
    each = units.join(places, F.col(key) == F.col("given"), "left").select(use, capacity, cost, "place", params)
    kept = F.col("place").isNull() | (F.col("place") >= F.col("release"))
    total = lambda c, cond=None: F.sum((F.col(c) if cond is None else F.when(cond, F.col(c)).otherwise(0)).cast(_EXACT)).cast("double")
    sums = each.groupBy("scenario", "factor", "release").agg(
        total(use).alias("demand"), total(capacity, kept).alias("kept_capacity"), total(cost).alias("baseline"), total(cost, kept).alias("recurring"),
        F.count(F.when(kept, 1)).cast("double").alias("retained"), F.count(F.when(~kept, 1)).cast("double").alias("released"),
    )
    plan = sums.withColumn("planning", round_half_away(F.col("demand") * F.col("factor"))).withColumn("headroom", round_half_away(F.col("kept_capacity") * (1 - contingency) - F.col("demand") * F.col("factor")))
    plan = plan.withColumn("difference", F.col("recurring") - F.col("baseline"))
    plan = plan.withColumn("capacity_state", F.when(F.col("headroom") < 0, "fail").when(F.col("headroom") < margin * F.col("planning"), "warning").otherwise("pass"))
    plan = plan.withColumn("share_state", F.when(F.col("released") > 0.05 * (F.col("retained") + F.col("released")), "warning").otherwise("pass")).withColumn("cost_state", F.when(F.col("difference") > 0, "warning").otherwise("pass"))
    states = ["capacity_state", "share_state", "cost_state"]
    warnings = sum((F.col(c) == "warning").cast("int") for c in states)
    plan = plan.withColumn("warnings", warnings).withColumn("feasibility", F.when(F.col("capacity_state") == "fail", "infeasible").when(F.col("warnings") > 0, "feasible_with_warnings").otherwise("feasible"))
    plan = plan.withColumn("confidence", F.when((F.col("warnings") == 0) & (F.col("headroom") >= margin * F.col("planning")), "high").when((F.col("warnings") <= 1) & (F.col("headroom") >= 0), "medium").otherwise("low"))
    risk = lambda c: F.when(F.col(c) == "fail", "high").when(F.col(c) == "warning", "medium").otherwise("low")
    row = lambda relation, item, value, status: F.struct(F.lit(relation).alias("relation"), F.lit(item).alias("item"), value.cast("double").alias("value"), status.cast("string").alias("status"))
    none = F.lit(None)
    rows = [row("capacity", c, F.col(c), none) for c in ("demand", "planning", "kept_capacity", "headroom", "retained", "released")]
    rows += [row("cost", c, F.col(c), none) for c in ("baseline", "recurring", "difference")]
    rows += [row("exposure", k, round_half_away(F.abs("difference") * v), none) for k, v in EXPOSURES.items()]
    rows += [row("constraint", c.removesuffix("_state"), none, F.col(c)) for c in states]
    rows += [row("risk", c.removesuffix("_state"), none, risk(c)) for c in states] + [row("risk", "confidence", none, F.when(F.col("confidence") == "low", "medium").otherwise("low"))]
    rows += [row("outcome", "feasibility", F.col("warnings"), F.col("feasibility")), row("outcome", "confidence", F.col("warnings"), F.col("confidence"))]
    return plan.select("scenario", F.inline(F.array(*rows)))
