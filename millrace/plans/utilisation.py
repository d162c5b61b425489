"""Utilisation over the test tables: suppliers are units, nations their parents, line items bookings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, round_half_away, safe_ratio
from ..operators import utilisation as u
from ..sources.tables import table

WEIGHTS = {"booked_ratio": 0.4, "occupied_ratio": 0.4, "attendance_ratio": 0.2}
WEEKLY = 10.0
FIRST, LAST = "1995-01-01", "2001-12-01"
BANDS = [("early", 420, 540), ("morning", 540, 720), ("afternoon", 720, 1020), ("evening", 1020, 1260)]


def bookings() -> u.Bookings:
    """Line items as bookings."""
    back, status = F.col("l_returnflag"), F.col("l_linestatus")
    return u.Bookings(
        unit=F.col("l_suppkey"), minutes=F.col("l_quantity").cast("long"), date=F.col("l_shipdate"), cancelled=back == "R",
        no_show=(back == "A") & (status == "O"), completed=status == "F", planned=F.lit(10), actual=F.col("l_linenumber").cast("long"),
    )


def _units(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "s_acctbal", F.col("n_name").alias("parent"), F.col("r_name").alias("site"))


def booking_context(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_type")
    joined = table(spark, d, "lineitem").join(_units(spark, d), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "s_name", "parent", "site", "p_type", F.date_format("l_shipdate", "yyyy-MM").alias("period"))


def unit_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return u.unit_kpis(_units(spark, d), table(spark, d, "lineitem"), bookings(), "s_suppkey", ["parent", "site"], F.lit(WEEKLY), WEIGHTS)


def parent_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return u.roll_up(unit_utilisation(spark, d), ["parent"])


def site_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return u.roll_up(unit_utilisation(spark, d), ["site"])


def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    return unit_utilisation(spark, d).agg(
        F.count(F.lit(1)).alias("units"), F.sum("bookings").cast("long").alias("bookings"), round_half_away(F.sum("booked_hours")).alias("booked_hours"), round_half_away(exact_mean(F.col("effective"))).alias("effective"), round_half_away(exact_mean(F.col("cancellation_rate"))).alias("cancellation_rate")
    )


def service_utilisation(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("service"))
    facts = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    services = part.select("service").distinct()
    b = replace(bookings(), unit=F.col("service"))
    return u.unit_kpis(services, facts, b, "service", [], F.lit(WEEKLY * 100), WEIGHTS).drop("planned", "actual")


def unit_service_hours(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_type")
    facts = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    b = bookings()
    left = facts.where(~b.cancelled).groupBy(F.col("l_suppkey").alias("unit"), F.col("p_type").alias("service")).agg(F.sum(b.minutes).alias("minutes"))
    right = facts.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("unit"), F.col("p_type").alias("service")).agg(F.count(F.lit(1)).alias("contacts"))
    return u.two_sided(left, right, ["unit", "service"])


def weekday_and_band(spark: SparkSession, d: str) -> DataFrame:
    return u.two_grains(table(spark, d, "events"), F.col("ts"), F.col("value"), BANDS, {"morning", "Monday"})


def monthly_spine(spark: SparkSession, d: str) -> DataFrame:
    return u.monthly_spine(_units(spark, d), table(spark, d, "lineitem"), bookings(), "s_suppkey", FIRST, LAST, F.lit(WEEKLY))


def persistent_low_use(spark: SparkSession, d: str) -> DataFrame:
    return u.persistent_low(monthly_spine(spark, d), "s_suppkey", 0.06)


def unit_cost(spark: SparkSession, d: str) -> DataFrame:
    hours = parent_utilisation(spark, d)
    cost = _units(spark, d).groupBy("parent").agg(round_half_away(F.sum(F.greatest(F.col("s_acctbal"), F.lit(0.0))), 2).alias("annual_cost"))
    return hours.join(cost, "parent").select("parent", "annual_cost", "booked_hours", round_half_away(safe_ratio(F.col("annual_cost"), F.col("booked_hours"))).alias("cost_per_hour"))


QUERIES = {
    "booking_context": booking_context, "unit_utilisation": unit_utilisation, "parent_utilisation": parent_utilisation, "site_utilisation": site_utilisation,
    "portfolio_summary": portfolio_summary, "service_utilisation": service_utilisation, "unit_service_hours": unit_service_hours, "weekday_and_band": weekday_and_band,
    "monthly_spine": monthly_spine, "persistent_low_use": persistent_low_use, "unit_cost": unit_cost,
}


def r(x: str, digits: int = 4) -> str:
    """Half away from zero, as the operators round."""
    s = f"{10**digits}.0"
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


_ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN least(1.0, greatest(0.0, ({a})::DOUBLE / ({b})::DOUBLE)) ELSE 0.0 END"
_mean = lambda c: f"(sum({c}::DECIMAL(24,4))::DOUBLE / count({c}))"
_UNITS = "SELECT s_suppkey, s_name, s_acctbal, n_name AS parent, r_name AS site FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_SUMS = """count(*)::DOUBLE AS bookings, sum(l_quantity)::DOUBLE AS sm, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS bm,
  sum(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS om,
  sum(CASE WHEN l_returnflag <> 'R' THEN 10 ELSE 0 END)::DOUBLE AS planned, sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END)::DOUBLE AS actual,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS cancelled, sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 ELSE 0 END)::DOUBLE AS no_shows"""


def _kpis(source: str, keys: str, weekly: float) -> str:
    z = lambda c: f"coalesce({c}, 0.0)"
    rate = lambda a: r(f"(CASE WHEN {z('bookings')} > 0 THEN {z(a)} / {z('bookings')} ELSE 0.0 END)")
    return f"""SELECT *, {r('(least(1.0, greatest(0.0, booked_ratio * 0.4 + occupied_ratio * 0.4 + attendance_ratio * 0.2)))')} AS effective FROM (
  SELECT *, {r('(' + _ratio('booked_hours', 'available_hours') + ')')} AS booked_ratio, {r('(' + _ratio('occupied_hours', 'available_hours') + ')')} AS occupied_ratio, {r('(' + _ratio('actual', 'planned') + ')')} AS attendance_ratio FROM (
    SELECT {keys}, {z('bookings')} AS bookings, {weekly}::DOUBLE AS available_hours, {r(f"({z('sm')} / 60)")} AS scheduled_hours, {r(f"({z('bm')} / 60)")} AS booked_hours, {r(f"({z('om')} / 60)")} AS occupied_hours,
      {z('planned')} AS planned, {z('actual')} AS actual, {rate('cancelled')} AS cancellation_rate, {rate('no_shows')} AS no_show_rate FROM {source}))"""


_UNIT = _kpis(f"({_UNITS}) u LEFT JOIN (SELECT l_suppkey, {_SUMS} FROM lineitem GROUP BY 1) f ON s_suppkey = l_suppkey", "s_suppkey, parent, site", WEEKLY)
_ROLL = f"""SELECT *, {r('(' + _ratio('booked_hours', 'available_hours') + ')')} AS booked_ratio, {r('(' + _ratio('occupied_hours', 'available_hours') + ')')} AS occupied_ratio FROM (
  SELECT KEY, count(*) AS units, {r('sum(available_hours)')} AS available_hours, {r('sum(booked_hours)')} AS booked_hours, {r('sum(occupied_hours)')} AS occupied_hours, {r(_mean('effective'))} AS effective FROM ({_UNIT}) GROUP BY KEY)"""
_SERVICE = _kpis(f"(SELECT DISTINCT p_type AS service FROM part) s LEFT JOIN (SELECT p_type, {_SUMS} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) f ON service = p_type", "service", WEEKLY * 100)
MONTHLY = f"""SELECT s_suppkey, period, available_hours, booked_hours, {r('(' + _ratio('booked_hours', 'available_hours') + ')')} AS booked_ratio FROM (
  SELECT s_suppkey, strftime(m, '%Y-%m') AS period, {r(f'({WEEKLY} * 52 / 12)')} AS available_hours, {r('(coalesce(minutes, 0) / 60.0::DOUBLE)')} AS booked_hours
  FROM supplier CROSS JOIN (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 MONTH)) AS m) LEFT JOIN
  (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS p, sum(l_quantity) AS minutes FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) ON l_suppkey = s_suppkey AND p = strftime(m, '%Y-%m'))"""
_MINUTE = "(hour(ts) * 60 + minute(ts))"
_BAND = "CASE " + " ".join(f"WHEN {_MINUTE} >= {a} AND {_MINUTE} < {b} THEN '{n}'" for n, a, b in BANDS) + " ELSE 'out_of_hours' END"

ORACLE_SQL = {
    "booking_context": f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, s_name, parent, site, p_type, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem LEFT JOIN ({_UNITS}) ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey",
    "unit_utilisation": _UNIT,
    "parent_utilisation": _ROLL.replace("KEY", "parent"),
    "site_utilisation": _ROLL.replace("KEY", "site"),
    "portfolio_summary": f"SELECT count(*) AS units, sum(bookings)::BIGINT AS bookings, {r('sum(booked_hours)')} AS booked_hours, {r(_mean('effective'))} AS effective, {r(_mean('cancellation_rate'))} AS cancellation_rate FROM ({_UNIT})",
    "service_utilisation": f"SELECT * EXCLUDE (planned, actual) FROM ({_SERVICE})",
    "unit_service_hours": "SELECT l_suppkey AS unit, p_type AS service, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::BIGINT AS minutes, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS contacts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) FILTER (WHERE l_returnflag <> 'R') > 0",
    "weekday_and_band": f"""SELECT grain, part, count(*) AS n, {r('sum(value)')} AS total, part IN ('morning', 'Monday') AS peak FROM (
      SELECT 'weekday' AS grain, dayname(ts) AS part, value FROM events UNION ALL SELECT 'band', {_BAND}, value FROM events) GROUP BY 1, 2""",
    "monthly_spine": MONTHLY,
    "persistent_low_use": f"SELECT s_suppkey, months, low_months, low_months >= 4 AND months >= 3 AS persistent FROM (SELECT s_suppkey, count(*) AS months, sum(CASE WHEN booked_ratio < 0.06 THEN 1 ELSE 0 END)::BIGINT AS low_months FROM ({MONTHLY}) GROUP BY 1)",
    "unit_cost": f"SELECT parent, annual_cost, booked_hours, {r('(CASE WHEN booked_hours > 0 THEN annual_cost / booked_hours ELSE 0.0 END)')} AS cost_per_hour FROM ({_ROLL.replace('KEY', 'parent')}) JOIN (SELECT parent, {r('sum(greatest(s_acctbal, 0.0))', 2)} AS annual_cost FROM ({_UNITS}) GROUP BY 1) USING (parent)",
}
