"""Series and scenarios defined as data, and sessions, over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away
from ..operators.definitions import EXPOSURES, Definition, Scenario, assessed, composite, dense, observed
from ..sources.tables import table
from ..streaming.events import session_counts
from .utilisation import r

#: fact table, date column, and for each target: name, entity, measure, filter.
TARGETS = [
    ("orders", "o_orderdate", [("orders_by_priority", "o_orderpriority", "1", None), ("value_by_priority", "o_orderpriority", "o_totalprice", None), ("open_by_priority", "o_orderpriority", "1", "o_orderstatus = 'O'"), ("large_by_status", "o_orderstatus", "1", "o_totalprice > 495000")]),
    ("lineitem", "l_shipdate", [("quantity_by_flag", "l_returnflag", "l_quantity", None), ("price_by_status", "l_linestatus", "l_extendedprice", None), ("returns_by_status", "l_linestatus", "1", "l_returnflag = 'R'"), ("odd_by_status", "l_linestatus", "1", "l_discount > 0.09 AND l_quantity > 49 AND l_tax < 0.01")]),
    ("events", "ts", [("events_by_type", "event_type", "1", None), ("value_by_type", "event_type", "value", None), ("errors", "'all'", "1", "event_type = 'error'")]),
    ("orders JOIN customer ON o_custkey = c_custkey", "o_orderdate", [("value_by_segment", "c_mktsegment", "o_totalprice", None)]),
]
SCENARIOS = [Scenario("light", 1.0, 4), Scenario("site", 1.03, 3), Scenario("hybrid", 0.93, 6)]
CAPACITY = 4


def _facts(spark: SparkSession, d: str, name: str) -> DataFrame:
    if " JOIN " not in name:
        return table(spark, d, name)
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _months(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, stamp, targets in TARGETS:
        definitions = [Definition(n, F.expr(e), F.expr(m), None if w is None else F.expr(w)) for n, e, m, w in targets]
        parts.append(dense(observed(_facts(spark, d, name), stamp, definitions)))
    return reduce(DataFrame.unionByName, parts)


def defined_series(spark: SparkSession, d: str) -> DataFrame:
    """Twelve targets of four fact tables, each table in one pass; months without rows are told."""
    rows = _months(spark, d)
    return rows.select("target", "entity", F.date_format("period", "yyyy-MM").alias("period"), (F.col("cents").cast("double") / 100.0).alias("value"), "imputation_flag")


def defined_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """States and diagnostics of the same series, from their whole cents."""
    return assessed(_months(spark, d))


def scenario_composite(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as units: use is what they delivered, capacity and cost follow from their balance."""
    used = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("of")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    balance = F.greatest(F.floor("s_acctbal"), F.lit(0))
    units = table(spark, d, "supplier").join(used, F.col("s_suppkey") == F.col("of"), "left").select("s_suppkey", F.coalesce("quantity", F.lit(0).cast("long")).alias("quantity"), (balance * CAPACITY).alias("capacity"), balance.alias("cost"))
    return composite(units, "s_suppkey", "quantity", "capacity", "cost", SCENARIOS)


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user that follow each other within half an hour; as a stream in ``streaming.events``."""
    rows = table(spark, d, "events").select("ts", "user_id", F.col("value").cast("decimal(18,2)").alias("value"))
    found = session_counts(rows, "ts", "user_id", "value")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), round_half_away(F.max("total").cast("double"), 2).alias("largest"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (defined_series, defined_eligibility, scenario_composite, user_sessions)}


def _series() -> str:
    out = []
    for name, stamp, targets in TARGETS:
        each = " UNION ALL ".join(f"SELECT '{n}' AS target, {e} AS entity, date_trunc('month', {stamp})::DATE AS period, sum(round(({m})::DECIMAL(20,2) * 100)::BIGINT) AS cents FROM {name} WHERE {w or 'true'} GROUP BY 1, 2, 3" for n, e, m, w in targets)
        out.append(f"SELECT k.target, k.entity, k.period, coalesce(cents, 0)::HUGEINT AS cents, CASE WHEN cents IS NULL THEN 'zero_filled' ELSE 'observed' END AS imputation_flag FROM (SELECT DISTINCT target, entity, unnest(generate_series(low, high, INTERVAL 1 MONTH))::DATE AS period FROM ({each}), (SELECT min(period) AS low, max(period) AS high FROM ({each}))) k LEFT JOIN ({each}) o ON k.target = o.target AND k.entity = o.entity AND k.period = o.period")
    return " UNION ALL ".join(out)


_PLACE = "(year(period) - 1970) * 12 + month(period) - 1"
_COMPOSITE_ROWS = (
    [("capacity", c, c, "NULL") for c in ("demand", "planning", "kept_capacity", "headroom", "retained", "released")] + [("cost", c, c, "NULL") for c in ("baseline", "recurring", "difference")]
    + [("exposure", k, r(f"(abs(difference) * {v}::DOUBLE)"), "NULL") for k, v in EXPOSURES.items()] + [("constraint", c, "NULL", f"{c}_state") for c in ("capacity", "share", "cost")]
    + [("risk", c, "NULL", f"CASE {c}_state WHEN 'fail' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END") for c in ("capacity", "share", "cost")] + [("risk", "confidence", "NULL", "CASE WHEN confidence = 'low' THEN 'medium' ELSE 'low' END"), ("outcome", "feasibility", "warnings", "feasibility"), ("outcome", "confidence", "warnings", "confidence")]
)
_UNITS = f"SELECT s_suppkey, coalesce(q, 0) AS quantity, greatest(floor(s_acctbal), 0)::BIGINT * {CAPACITY} AS capacity, greatest(floor(s_acctbal), 0)::BIGINT AS cost, row_number() OVER (ORDER BY coalesce(q, 0), s_suppkey) - 1 AS place FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey"
_PLAN = f"""SELECT *, CASE WHEN capacity_state = 'fail' THEN 'infeasible' WHEN warnings > 0 THEN 'feasible_with_warnings' ELSE 'feasible' END AS feasibility, CASE WHEN warnings = 0 AND headroom >= 0.1::DOUBLE * planning THEN 'high' WHEN warnings <= 1 AND headroom >= 0 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT *, (capacity_state = 'warning')::INTEGER + (share_state = 'warning')::INTEGER + (cost_state = 'warning')::INTEGER AS warnings FROM (
  SELECT *, CASE WHEN headroom < 0 THEN 'fail' WHEN headroom < 0.1::DOUBLE * planning THEN 'warning' ELSE 'pass' END AS capacity_state, CASE WHEN released > 0.05::DOUBLE * (retained + released) THEN 'warning' ELSE 'pass' END AS share_state, CASE WHEN difference > 0 THEN 'warning' ELSE 'pass' END AS cost_state FROM (
  SELECT *, {r('(demand * factor)')} AS planning, {r('(kept_capacity * 0.85::DOUBLE - demand * factor)')} AS headroom, recurring - baseline AS difference FROM (
  SELECT scenario, factor, sum(quantity)::DOUBLE AS demand, (coalesce(sum(capacity) FILTER (WHERE place >= release), 0))::DOUBLE AS kept_capacity, sum(cost)::DOUBLE AS baseline, (coalesce(sum(cost) FILTER (WHERE place >= release), 0))::DOUBLE AS recurring, (count(*) FILTER (WHERE place >= release))::DOUBLE AS retained, (count(*) FILTER (WHERE place < release))::DOUBLE AS released
  FROM ({_UNITS}), (VALUES {', '.join(f"('{x.name}', {x.demand_factor}::DOUBLE, {x.release})" for x in SCENARIOS)}) v(scenario, factor, release) GROUP BY 1, 2))))"""
ORACLE_SQL = {
    "defined_series": f"SELECT target, entity, strftime(period, '%Y-%m') AS period, cents::DOUBLE / 100.0::DOUBLE AS value, imputation_flag FROM ({_series()})",
    "defined_eligibility": f"""SELECT target, entity, periods, non_zero, missing_ratio, variance, non_zero_ratio, average_interval, squared_cv, recent, CASE WHEN periods < 18 THEN 'insufficient_history' WHEN missing_ratio > 0.2 THEN 'quality_blocked' WHEN non_zero = 0 OR NOT recent THEN 'inactive_series'
    WHEN non_zero < 12 THEN 'too_sparse' WHEN variance = 0 THEN 'constant_series' WHEN average_interval > 2.0 THEN 'baseline_only' ELSE 'eligible' END AS status FROM (
  SELECT target, entity, periods, non_zero, {r('(missing / periods::DOUBLE)', 6)} AS missing_ratio, {r('(CASE WHEN periods > 1 THEN (periods::HUGEINT * q - s * s)::DOUBLE / (periods * (periods - 1))::DOUBLE / 10000.0::DOUBLE ELSE 0.0 END)', 6)} AS variance, {r('(non_zero / periods::DOUBLE)', 6)} AS non_zero_ratio,
    {r('(CASE WHEN non_zero > 1 THEN (last_at - first_at) / (non_zero - 1)::DOUBLE END)', 6)} AS average_interval, {r('(CASE WHEN m > 1 THEN m::DOUBLE * (m::HUGEINT * pq - ps * ps)::DOUBLE / ((m - 1)::DOUBLE * ps::DOUBLE * ps::DOUBLE) END)', 6)} AS squared_cv, coalesce(last_positive > last - 3, false) AS recent FROM (
  SELECT target, entity, count(*) AS periods, count(*) FILTER (WHERE cents <> 0) AS non_zero, count(*) FILTER (WHERE imputation_flag <> 'observed') AS missing, max({_PLACE}) AS last, max({_PLACE}) FILTER (WHERE cents > 0) AS last_positive, min({_PLACE}) FILTER (WHERE cents <> 0) AS first_at, max({_PLACE}) FILTER (WHERE cents <> 0) AS last_at,
    sum(cents)::HUGEINT AS s, sum(cents * cents)::HUGEINT AS q, count(*) FILTER (WHERE cents > 0) AS m, (sum(cents) FILTER (WHERE cents > 0))::HUGEINT AS ps, (sum(cents * cents) FILTER (WHERE cents > 0))::HUGEINT AS pq FROM ({_series()}) GROUP BY 1, 2))""",
    "scenario_composite": " UNION ALL ".join(f"SELECT scenario, '{a}' AS relation, '{b}' AS item, ({v})::DOUBLE AS value, ({s})::VARCHAR AS status FROM ({_PLAN})" for a, b, v, s in _COMPOSITE_ROWS),
    "user_sessions": f"SELECT user_id, count(*) AS sessions, max(n) AS longest, {r('max(total)::DOUBLE', 2)} AS largest, sum(n)::BIGINT AS events FROM (SELECT user_id, session, count(*) AS n, sum(value::DECIMAL(18,2)) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1",
}
