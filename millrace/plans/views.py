"""Reporting views, gates, JSON fields, and simulated queues over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clean, exact_mean, key_digest, round_half_away
from ..operators import simulation as sim
from ..sources.tables import table
from . import utilisation
from .utilisation import r


def activity_view(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), "c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), round_half_away(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


def executive_view(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, name: table(spark, d, t).agg(c.alias(name)).withColumn("k", F.lit(1))
    out = one("orders", F.count(F.lit(1)), "orders")
    for t, c, name in (("customer", F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)), "customers_in_debt"), ("part", F.count_distinct("p_brand"), "brands"), ("supplier", F.max("s_acctbal"), "top_balance"), ("lineitem", F.sum(F.col("l_quantity").cast("long")), "quantity"), ("events", F.count_distinct("user_id"), "users")):
        out = out.join(one(t, c, name), "k")
    return out.drop("k")


def portfolio_view(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.sum(F.when(F.col("s_acctbal") > 5000, 1).otherwise(0)).alias("rich"))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    joined = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("suppliers", "rich", "customers")])


def filtered_view(spark: SparkSession, d: str, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Orders by optional equality filters; empty ones do not filter."""
    out = table(spark, d, "orders")
    for name, value in (filters if filters is not None else {"o_orderstatus": "F", "o_orderpriority": None}).items():
        if value:
            out = out.where(F.col(name) == value)
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc(F.abs("o_totalprice")), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def events_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def cleaned_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", clean(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name"), key_digest("CUS-", 12, F.col("c_custkey").cast("string"), F.col("c_name")).alias("digest"))


def sites_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Bag union of keys over three tables, counted."""
    keys = table(spark, d, "supplier").select(F.col("s_nationkey").alias("site")).unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("site"))).unionByName(table(spark, d, "nation").select(F.col("n_nationkey").alias("site")))
    return keys.groupBy("site").agg(F.count(F.lit(1)).alias("uses"))


def idle_parts(spark: SparkSession, d: str) -> DataFrame:
    """Set difference: parts that no line of more than 25 pieces names."""
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """All events that have a time: each type on each day is a queue of its own."""
    e = table(spark, d, "events").where(F.col("ts").isNotNull())
    return e.select(F.col("event_type").alias("resource"), F.to_date("ts").alias("day"), F.col("event_id").alias("contact"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))


def sim_events(spark: SparkSession, d: str) -> DataFrame:
    return sim.replicate(_arrivals(spark, d), 5, 480.0, 1080.0, (2.0, 6.0, 15.0), by=("resource", "day"))


def sim_metrics(spark: SparkSession, d: str) -> DataFrame:
    return sim.queue_measures(sim_events(spark, d), ["resource", "day", "replication"])


def sim_resilience(spark: SparkSession, d: str) -> DataFrame:
    return sim.resilience(sim_metrics(spark, d), ["resource", "day"], "mean_wait", 60.0)


def admissions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return sim.admit(e, ["event_type", "day"], ["ts", "event_id"], 40).select("event_id", "place", "blocked")


def queue_measures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.col("value").alias("wait"), F.greatest(F.lit(0.0), F.col("value") - 90).alias("overtime"))
    return sim.queue_measures(e, ["event_type"])


def decision_base(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", "s_name", "s_acctbal", "n_name", "r_name")


def unit_view(spark: SparkSession, d: str) -> DataFrame:
    """Units with their utilisation and flag, missing ones kept."""
    use = utilisation.unit_utilisation(spark, d).select(F.col("s_suppkey").alias("u"), "booked_hours", "effective")
    flags = utilisation.persistent_low_use(spark, d).where("persistent").select(F.col("s_suppkey").alias("p"), "low_months")
    joined = table(spark, d, "supplier").join(use, F.col("s_suppkey") == F.col("u"), "left").join(flags, F.col("s_suppkey") == F.col("p"), "left")
    return joined.select("s_suppkey", "s_name", "booked_hours", "effective", F.coalesce("low_months", F.lit(0)).alias("low_months"))


def workforce_view(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return joined.groupBy(F.year("o_orderdate").alias("year"), "c_nationkey", "c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), round_half_away(F.sum(price).cast("double") / F.count(F.lit(1)), 2).alias("mean"), F.sum(price).cast("double").alias("total"))


def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.hour("ts").alias("hour"), F.col("value").cast("decimal(18,4)").alias("v"))
    return e.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"), round_half_away(F.sum("v").cast("double") / F.count(F.lit(1)), 2).alias("mean"), round_half_away(F.sum("v").cast("double"), 2).alias("total"))


def sim_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the measures of each queue over all replications."""
    return sim_metrics(spark, d).groupBy("resource", "day").agg(F.count(F.lit(1)).alias("replications"), *[round_half_away(exact_mean(F.col(c))).alias(c) for c in ("contacts", "mean_wait", "p95_wait", "max_overtime")])


QUERIES = {x.__name__: x for x in (activity_view, executive_view, portfolio_view, filtered_view, top_orders, events_props, cleaned_names, sites_in_use, idle_parts, sim_events, sim_metrics, sim_resilience, admissions, queue_measures, decision_base, unit_view, workforce_view, bottlenecks, sim_means)}

ORACLE_SQL = {
    "activity_view": f"SELECT strftime(o_orderdate, '%Y-%m') AS period, c_mktsegment, o_orderstatus, count(*) AS orders, {r('sum(o_totalprice::DECIMAL(18,2))::DOUBLE', 2)} AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3",
    "executive_view": "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FILTER (WHERE c_acctbal < 0) FROM customer) AS customers_in_debt, (SELECT count(DISTINCT p_brand) FROM part) AS brands, (SELECT max(s_acctbal) FROM supplier) AS top_balance, (SELECT sum(l_quantity)::BIGINT FROM lineitem) AS quantity, (SELECT count(DISTINCT user_id) FROM events) AS users",
    "portfolio_view": "SELECT n_name, coalesce(suppliers, 0) AS suppliers, coalesce(rich, 0)::BIGINT AS rich, coalesce(customers, 0) AS customers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, count(*) FILTER (WHERE s_acctbal > 5000) AS rich FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON n_nationkey = c_nationkey",
    "filtered_view": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice) DESC, o_orderkey LIMIT 20",
    "events_props": "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events",
    "cleaned_names": "SELECT c_custkey, trim(c_name) AS name, 'CUS-' || substr(sha256(c_custkey::VARCHAR || '|' || c_name), 1, 12) AS digest FROM customer",
    "sites_in_use": "SELECT site, count(*) AS uses FROM (SELECT s_nationkey AS site FROM supplier UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT n_nationkey FROM nation) GROUP BY 1",
    "idle_parts": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25",
    "admissions": "SELECT event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)::INTEGER AS place, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) > 40 AS blocked FROM events",
    "queue_measures": f"SELECT event_type, count(*) AS contacts, {r('avg(value)')} AS mean_wait, {r('quantile_cont(value, 0.5)')} AS median_wait, {r('quantile_cont(value, 0.95)')} AS p95_wait, {r('max(greatest(0.0, value - 90))')} AS max_overtime FROM events GROUP BY 1",
    "decision_base": "SELECT s_suppkey, s_name, s_acctbal, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "unit_view": f"SELECT s.s_suppkey, s_name, booked_hours, effective, coalesce(low_months, 0)::BIGINT AS low_months FROM supplier s LEFT JOIN ({utilisation.ORACLE_SQL['unit_utilisation']}) u ON s.s_suppkey = u.s_suppkey LEFT JOIN (SELECT * FROM ({utilisation.ORACLE_SQL['persistent_low_use']}) WHERE persistent) p ON s.s_suppkey = p.s_suppkey",
    "workforce_view": f"SELECT year(o_orderdate)::INTEGER AS year, c_nationkey, c_mktsegment, o_orderpriority, count(*) AS orders, {r('(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*))', 2)} AS mean, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4",
    "bottlenecks": f"SELECT event_type, hour(ts)::INTEGER AS hour, count(*) AS n, {r('(sum(value::DECIMAL(18,4))::DOUBLE / count(*))', 2)} AS mean, {r('sum(value::DECIMAL(18,4))::DOUBLE', 2)} AS total FROM events GROUP BY 1, 2",
}

_U = "(('0x' || substr(md5(concat_ws('|', event_type, ts::DATE, rep, event_id)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE)"
_SERVED = r(f"(CASE WHEN {_U} < {4.0 / 13.0!r}::DOUBLE THEN 2.0::DOUBLE + sqrt({_U} * 52.0::DOUBLE) ELSE 15.0::DOUBLE - sqrt((1.0::DOUBLE - {_U}) * 117.0::DOUBLE) END)", 2)
_exact = lambda c: f"(sum({c}::DECIMAL(24,4))::DOUBLE / count({c}))"
_QUEUE = "(PARTITION BY resource, day, replication ORDER BY arrival, contact ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORACLE_SQL["sim_events"] = f"""WITH a AS (SELECT event_type AS resource, ts::DATE AS day, rep::INTEGER AS replication, event_id AS contact, (hour(ts) * 60 + minute(ts))::DECIMAL(18,4) AS arrival, ({_SERVED})::DECIMAL(18,4) AS service
    FROM events, (SELECT unnest(range(1, 6)) AS rep) WHERE ts IS NOT NULL),
  b AS (SELECT *, (sum(service) OVER {_QUEUE} - service)::DECIMAL(18,4) AS before FROM a),
  c AS (SELECT *, (max(greatest(arrival, 480::DECIMAL(18,4)) - before) OVER {_QUEUE} + before)::DECIMAL(18,4) AS start FROM b)
SELECT resource, day, replication, contact, arrival::DOUBLE AS arrival, start::DOUBLE AS start, (start + service)::DOUBLE AS "end", (start - arrival)::DOUBLE AS wait, greatest(0.0::DOUBLE, (start + service - 1080)::DOUBLE) AS overtime FROM c"""
ORACLE_SQL["sim_metrics"] = f"SELECT resource, day, replication, count(*) AS contacts, {r(_exact('wait'))} AS mean_wait, {r('quantile_cont(wait, 0.5)')} AS median_wait, {r('quantile_cont(wait, 0.95)')} AS p95_wait, {r('max(overtime)')} AS max_overtime FROM ({ORACLE_SQL['sim_events']}) GROUP BY 1, 2, 3"
ORACLE_SQL["sim_means"] = f"SELECT resource, day, count(*) AS replications, {r(_exact('contacts'))} AS contacts, {r(_exact('mean_wait'))} AS mean_wait, {r(_exact('p95_wait'))} AS p95_wait, {r(_exact('max_overtime'))} AS max_overtime FROM ({ORACLE_SQL['sim_metrics']}) GROUP BY 1, 2"
_HALF = "1.96::DOUBLE * (coalesce(stddev_samp(mean_wait), 0.0) / sqrt(count(*)))"
ORACLE_SQL["sim_resilience"] = f"SELECT resource, day, count(*) AS replications, {r('avg(mean_wait)')} AS mean, {r(f'(avg(mean_wait) - {_HALF})')} AS low, {r(f'(avg(mean_wait) + {_HALF})')} AS high, {r('(count(*) FILTER (WHERE mean_wait > 60.0)::DOUBLE / count(*))')} AS failure_rate FROM ({ORACLE_SQL['sim_metrics']}) GROUP BY 1, 2"
