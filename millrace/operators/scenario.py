"""Compatibility, candidates, capacity, release choice, weighted comparison and sparse constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp01, round_half_away, safe_ratio
from .prefix import carried_forward, running_totals


def first_failing(rules: list[tuple[str, Column]], fine: str = "compatible") -> Column:
    """The name of the first rule that fails."""
    out = F.lit(fine)
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def all_failing(rules: list[tuple[str, Column]]) -> Column:
    """All failing rules in order, joined by semicolons; empty where none fails."""
    return F.concat_ws(";", *[F.when(fails, F.lit(name)) for name, fails in rules])


def reason_census(frame: DataFrame, reasons: str) -> DataFrame:
    return frame.where(F.col(reasons) != "").select(F.explode(F.split(reasons, ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def capacity_rows(frame: DataFrame, demand: Column, capacity: Column, contingency: float) -> DataFrame:
    """Headroom, headroom after contingency, shortfall and utilisation."""
    usable = capacity * (1 - contingency)
    return frame.withColumns(
        {"headroom": round_half_away(capacity - demand), "contingency_headroom": round_half_away(usable - demand), "shortfall": round_half_away(F.greatest(F.lit(0.0), demand - capacity)), "utilisation": round_half_away(safe_ratio(demand, capacity))}
    )


def release_candidates(units: DataFrame, by: list[str], score: str, key: str, sizes: dict[str, int], kind: str) -> DataFrame:
    """The lowest scores of each group; how many depends on the kind of scenario.  Spark keeps only as many a task."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(kind))
    ranked = units.withColumn("rank_value", F.row_number().over(Window.partitionBy(*by).orderBy(score, key)))
    return ranked.where((F.col("rank_value") <= max(sizes.values())) & (F.col("rank_value") <= most))


def comparison(frame: DataFrame, by: list[str], dimensions: dict[str, tuple[Column, float]], feasible: Column) -> DataFrame:
    """A row for each dimension with its weighted score, all 0 where infeasible."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), round_half_away(clamp01(v)).alias("score"), F.lit(float(w)).alias("weight")) for k, (v, w) in dimensions.items()]))
    rows = frame.select(*by, feasible.alias("_f"), each.alias("x")).select(*by, "_f", "x.dimension", "x.score", "x.weight")
    return rows.withColumn("weighted", round_half_away(F.when(F.col("_f"), F.col("score") * F.col("weight")).otherwise(0.0))).drop("_f")


def home_of(frame: DataFrame, key: str, place: str, weight: str) -> DataFrame:
    """The place with the largest weight of each key, ties by name."""
    sums = frame.groupBy(key, place).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(key).agg(F.min_by(place, F.struct(-F.col("_w"), F.col(place))).alias(place), round_half_away(F.max("_w"), 2).alias("weight"))


def constraint_slack(coefficients: DataFrame, values: DataFrame, bounds: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Row activity of a sparse matrix, its slack to the upper bound, and whether it binds: a join and one aggregation."""
    active = coefficients.join(values, "variable").groupBy("constraint").agg(F.sum(F.col("coefficient") * F.col("value")).alias("a"))
    slack = F.col("upper") - F.coalesce("a", F.lit(0.0))
    return bounds.join(active, "constraint", "left").select("constraint", round_half_away(F.coalesce("a", F.lit(0.0))).alias("activity"), "upper", round_half_away(slack).alias("slack"), (F.abs(slack) <= tolerance).alias("binding"))


#: Amounts on the axis of an allocation are exact to six places, so that no order of sums moves a cut.
_AXIS = "decimal(28,6)"


def allocate(demand: DataFrame, supply: DataFrame, group: str, need: str, demand_order: list[str], offer: str, supply_order: list[str], rows_per_part: int = 100_000) -> DataFrame:
    """Demand served in order from supply in order within each group: both become ranges of one axis, and overlap is the allocation.

    For one resource per group and cost increasing with the order this is the
    least-cost allocation.  Where a range begins is a running sum in two levels,
    and the range that a cut falls into is carried forward in two levels, so a
    group of any size is the work of many tasks; no pairs are compared.
    Orders end with a column that tells rows apart.
    """

    def ranges(df: DataFrame, amount: str, order: list[str], side: str) -> DataFrame:
        kept = df.select(group, *order, F.col(amount).cast(_AXIS).alias("size")).where("size > 0")
        begun = running_totals(kept, [group], order, {"begin": F.col("size")}, rows_per_part=rows_per_part)
        return begun.select(group, F.col("begin").cast(_AXIS).alias("at"), F.struct(F.struct(*order).alias("of"), (F.col("begin") + F.col("size")).cast(_AXIS).alias("end")).alias(side))

    d, s = ranges(demand, need, demand_order, "d"), ranges(supply, offer, supply_order, "s")
    cuts = d.select(group, "at", "d", F.lit(None).cast(s.schema["s"].dataType).alias("s")).unionByName(s.select(group, "at", F.lit(None).cast(d.schema["d"].dataType).alias("d"), "s"))
    merged = cuts.groupBy(group, "at").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    filled = carried_forward(merged, [group], ["at"], ["d", "s"], rows_per_part)
    # ranges of a side follow each other, so the next cut is where the shorter of the two ends
    overlap = filled.where("d IS NOT NULL AND s IS NOT NULL").withColumn("amount", round_half_away((F.least("d.end", "s.end") - F.col("at")).cast("double")))
    return overlap.where("amount > 0").select(group, F.col("d.of").alias("d"), F.col("s.of").alias("s"), "amount")


def with_unmet(rows: DataFrame, demand: DataFrame, group: str, need: str, order: list[str]) -> DataFrame:
    """Allocated rows as (group, order, s, amount, unmet): what is left of a demand stands on its first row only, and a demand that got nothing has one row without a supply."""
    flat = rows.select(F.col(group).alias("of_group"), *[F.col(f"d.{c}").alias(f"of_{c}") for c in order], "s", "amount")
    whole = Window.partitionBy("of_group", *[f"of_{c}" for c in order])
    flat = flat.withColumn("served", F.sum(F.col("amount").cast(_AXIS)).over(whole)).withColumn("first", F.row_number().over(whole.orderBy("s")) == 1)
    cond = F.col(group).eqNullSafe(F.col("of_group"))
    for c in order:
        cond &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    left = round_half_away(F.col(need).cast("double") - F.coalesce(F.col("served").cast("double"), F.lit(0.0)))
    return demand.join(flat, cond, "left").select(group, *order, "s", F.coalesce("amount", F.lit(0.0)).alias("amount"), F.when(F.coalesce("first", F.lit(True)), left).otherwise(0.0).alias("unmet"))


def moves(rows: DataFrame, by: list[str], source: str, target: str, amount: str) -> DataFrame:
    """What goes from each place to each other place, and whether that is a move at all."""
    away = rows.where(~F.col(source).eqNullSafe(F.col(target))).groupBy(*by, source, target).agg(F.sum(F.col(amount).cast(_AXIS)).cast("double").alias("moved"))
    return away.withColumn("moved", round_half_away(F.col("moved"))).withColumn("status", F.when(F.col("moved") > 1e-6, "candidate_move").otherwise("not_moved"))
