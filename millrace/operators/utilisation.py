"""Utilisation of units by bookings, rolled up, cut by time, and costed.

Roles are bound to columns by :class:`Bookings`, so the operators run on any
table that can supply them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bounded_ratio, exact_mean, month_key, round_half_away, safe_ratio, weighted_score


@dataclass(frozen=True)
class Bookings:
    """Columns of the roles, as expressions."""

    unit: Column
    minutes: Column
    date: Column
    cancelled: Column
    no_show: Column
    completed: Column
    planned: Column
    actual: Column

    @property
    def occupied(self) -> Column:
        return self.completed & ~self.cancelled & ~self.no_show


def unit_kpis(units: DataFrame, bookings: DataFrame, b: Bookings, unit_key: str, keep: list[str], available: Column, weights: dict[str, float]) -> DataFrame:
    """Hours, attendance and ratios of every unit, those without bookings too.

    Rates of cancellation and no-show are over all bookings, attendance over
    those not cancelled.  One shuffle by unit, combined before it.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    facts = bookings.groupBy(b.unit.alias("_unit")).agg(
        F.count(F.lit(1)).alias("bookings"),
        F.sum(b.minutes).alias("scheduled_minutes"),
        F.sum(F.when(~b.cancelled, b.minutes).otherwise(0)).alias("booked_minutes"),
        F.sum(F.when(b.occupied, b.minutes).otherwise(0)).alias("occupied_minutes"),
        F.sum(F.when(~b.cancelled, b.planned).otherwise(0)).alias("planned"),
        F.sum(F.when(~b.cancelled, b.actual).otherwise(0)).alias("actual"),
        one(b.cancelled).alias("cancelled"),
        one(b.no_show).alias("no_shows"),
    )
    counts = ["bookings", "scheduled_minutes", "booked_minutes", "occupied_minutes", "planned", "actual", "cancelled", "no_shows"]
    joined = units.join(facts, units[unit_key] == facts["_unit"], "left").select(unit_key, *keep, available.alias("available_hours"), *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in counts])
    ratios = joined.select(
        unit_key, *keep, "bookings", round_half_away(F.col("available_hours")).alias("available_hours"),
        *[round_half_away(F.col(f"{x}_minutes") / 60).alias(f"{x}_hours") for x in ("scheduled", "booked", "occupied")], "planned", "actual",
        round_half_away(safe_ratio(F.col("cancelled"), F.col("bookings"))).alias("cancellation_rate"),
        round_half_away(safe_ratio(F.col("no_shows"), F.col("bookings"))).alias("no_show_rate"),
    )
    return with_ratios(ratios, weights)


def with_ratios(frame: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Booked, occupied and attendance ratios, and their weighted score."""
    parts = {"booked_ratio": ("booked_hours", "available_hours"), "occupied_ratio": ("occupied_hours", "available_hours"), "attendance_ratio": ("actual", "planned")}
    out = frame.withColumns({k: round_half_away(bounded_ratio(F.col(a), F.col(c))) for k, (a, c) in parts.items()})
    return out.withColumn("effective", round_half_away(weighted_score(weights)))


def roll_up(frame: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the rounded unit values, ratios anew, and the plain mean of the units' scores."""
    sums = ["available_hours", "booked_hours", "occupied_hours"]
    out = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *[round_half_away(F.sum(c)).alias(c) for c in sums], round_half_away(exact_mean(F.col("effective"))).alias("effective"))
    return out.withColumns({"booked_ratio": round_half_away(bounded_ratio(F.col("booked_hours"), F.col("available_hours"))), "occupied_ratio": round_half_away(bounded_ratio(F.col("occupied_hours"), F.col("available_hours")))})


def two_grains(events: DataFrame, stamp: Column, value: Column, bands: list[tuple[str, int, int]], peaks: set[str]) -> DataFrame:
    """Counts and sums by weekday and by band of the day, in one pass; outside all bands is ``out_of_hours``."""
    minute = F.hour(stamp) * 60 + F.minute(stamp)
    name = F.lit(None).cast("string")
    for label, start, end in reversed(bands):
        name = F.when((minute >= start) & (minute < end), label).otherwise(name)
    grains = F.array(F.struct(F.lit("weekday").alias("grain"), F.date_format(stamp, "EEEE").alias("part")), F.struct(F.lit("band").alias("grain"), F.coalesce(name, F.lit("out_of_hours")).alias("part")))
    each = events.select(F.explode(grains).alias("g"), value.alias("v")).select("g.grain", "g.part", "v")
    return each.groupBy("grain", "part").agg(F.count(F.lit(1)).alias("n"), round_half_away(F.sum("v")).alias("total")).withColumn("peak", F.col("part").isin(*peaks))


def monthly_spine(units: DataFrame, bookings: DataFrame, b: Bookings, unit_key: str, first: str, last: str, weekly_hours: Column) -> DataFrame:
    """Utilisation of every unit in every month, zero where nothing was booked; bookings outside the spine are ignored."""
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    spine = units.select(F.col(unit_key), weekly_hours.alias("weekly"), months.alias("month")).withColumn("period", month_key(F.col("month")))
    facts = bookings.where(~b.cancelled).groupBy(b.unit.alias("_unit"), month_key(b.date).alias("_period")).agg(F.sum(b.minutes).alias("minutes"))
    joined = spine.join(facts, (spine[unit_key] == facts["_unit"]) & (spine["period"] == facts["_period"]), "left")
    return joined.select(
        unit_key, "period", round_half_away(F.col("weekly") * 52 / 12).alias("available_hours"), round_half_away(F.coalesce("minutes", F.lit(0)).cast("double") / 60).alias("booked_hours")
    ).withColumn("booked_ratio", round_half_away(bounded_ratio(F.col("booked_hours"), F.col("available_hours"))))


def persistent_low(monthly: DataFrame, unit_key: str, threshold: float, least_low: int = 4, least_seen: int = 3) -> DataFrame:
    low = F.sum(F.when(F.col("booked_ratio") < threshold, 1).otherwise(0)).alias("low_months")
    out = monthly.groupBy(unit_key).agg(F.count(F.lit(1)).alias("months"), low)
    return out.withColumn("persistent", (F.col("low_months") >= least_low) & (F.col("months") >= least_seen))


def two_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of two fact tables side by side, a key of either kept: a tagged union and one aggregation, no outer join."""
    values = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    fill = lambda df: df.select(*keys, *[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in values])
    return fill(left).unionByName(fill(right)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])
