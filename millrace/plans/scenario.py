"""Scenario operators over the test tables: part types are services, suppliers rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away, safe_ratio
from ..operators import scenario as s
from ..sources.tables import table
from .utilisation import QUERIES as UTILISATION
from .utilisation import ORACLE_SQL as UTILISATION_SQL
from .utilisation import r

SIZES = {"light": 4, "site": 3, "hybrid": 6}
_RULES = [("inactive", "s_acctbal < 0"), ("too_small", "p_size > 40"), ("no_equipment", "p_brand LIKE '%5' AND s_acctbal < 2000"), ("price_conflict", "p_retailprice > 1400")]


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Each sold (part, supplier) pair: candidates come from what was booked, not from a cross product."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    return pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def compatibility(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("p_partkey", "s_suppkey", s.first_failing([(n, F.expr(c)) for n, c in _RULES]).alias("status"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("p_partkey", "s_suppkey", s.all_failing([(n, F.expr(c)) for n, c in _RULES]).alias("reasons")).withColumn("eligible", F.col("reasons") == "")


def candidate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return s.reason_census(candidates(spark, d), "reasons")


def capacity(spark: SparkSession, d: str) -> DataFrame:
    rows = UTILISATION["parent_utilisation"](spark, d).select("parent", "available_hours", "booked_hours")
    return s.capacity_rows(rows, F.col("booked_hours") * 3, F.col("available_hours"), 0.15)


def top_release_candidates(spark: SparkSession, d: str) -> DataFrame:
    units = UTILISATION["unit_utilisation"](spark, d).select("s_suppkey", "site", "effective")
    kinds = units.withColumn("kind", F.explode(F.array(*map(F.lit, SIZES))))
    return s.release_candidates(kinds, ["site", "kind"], "effective", "s_suppkey", SIZES, "kind").select("site", "kind", "s_suppkey", "effective", "rank_value")


def scenario_score(spark: SparkSession, d: str) -> DataFrame:
    rows = UTILISATION["site_utilisation"](spark, d)
    dims = {"utilisation": (F.col("booked_ratio"), 0.5), "effective": (F.col("effective"), 0.3), "occupancy": (safe_ratio(F.col("occupied_hours"), F.col("booked_hours")), 0.2)}
    return s.comparison(rows, ["site"], dims, F.col("booked_ratio") > 0)


def home_site(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return s.home_of(joined.select("c_mktsegment", "n_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")), "c_mktsegment", "n_name", "c_acctbal").withColumn("weight", F.col("weight").cast("double"))


def constraint_slack(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem")
    coefficients = facts.groupBy(F.col("l_suppkey").alias("constraint"), F.col("l_partkey").alias("variable")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("coefficient"))
    values = table(spark, d, "part").select(F.col("p_partkey").alias("variable"), (F.col("p_size") / 10).alias("value"))
    bounds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("constraint"), F.lit(50000.0).alias("upper"))
    return s.constraint_slack(coefficients, values, bounds)


def allocation(spark: SparkSession, d: str) -> DataFrame:
    demand = table(spark, d, "customer").where("c_acctbal > 0").select("c_nationkey", "c_custkey", F.floor("c_acctbal").cast("double").alias("need"))
    supply = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", (F.floor("s_acctbal") * 10).cast("double").alias("offer"))
    out = s.allocate(demand, supply, "c_nationkey", "need", ["c_custkey"], "offer", ["s_suppkey"])
    return out.select("c_nationkey", F.col("d.c_custkey").alias("c_custkey"), F.col("s.s_suppkey").alias("s_suppkey"), "amount")


QUERIES = {x.__name__: x for x in (compatibility, candidates, candidate_reasons, capacity, top_release_candidates, scenario_score, home_site, constraint_slack, allocation)}

_PAIRS = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
_CAND = f"SELECT *, reasons = '' AS eligible FROM (SELECT p_partkey, s_suppkey, concat_ws(';', {', '.join(f'CASE WHEN {c} THEN $${n}$$ END' for n, c in _RULES)}) AS reasons FROM {_PAIRS})"
_DIMS = {"utilisation": ("booked_ratio", 0.5), "effective": ("effective", 0.3), "occupancy": ("(CASE WHEN booked_hours > 0 THEN occupied_hours / booked_hours ELSE 0.0 END)", 0.2)}
_RANGE = "SELECT {g} AS g, {k} AS k, a, sum(a) OVER (PARTITION BY {g} ORDER BY {k}) AS e FROM ({t})"
_D = _RANGE.format(g="c_nationkey", k="c_custkey", t="SELECT *, floor(c_acctbal)::DOUBLE AS a FROM customer WHERE c_acctbal > 0")
_S = _RANGE.format(g="s_nationkey", k="s_suppkey", t="SELECT *, (floor(s_acctbal) * 10)::DOUBLE AS a FROM supplier WHERE s_acctbal > 0")
ORACLE_SQL = {
    "compatibility": f"SELECT p_partkey, s_suppkey, CASE {' '.join(f'WHEN {c} THEN $${n}$$' for n, c in _RULES)} ELSE 'compatible' END AS status FROM {_PAIRS}",
    "candidates": _CAND,
    "candidate_reasons": f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM ({_CAND}) WHERE reasons <> '') GROUP BY 1",
    "capacity": f"SELECT parent, available_hours, booked_hours, {r('(available_hours - booked_hours * 3)')} AS headroom, {r('(available_hours * 0.85::DOUBLE - booked_hours * 3)')} AS contingency_headroom, {r('greatest(0.0, booked_hours * 3 - available_hours)')} AS shortfall, {r('(CASE WHEN available_hours > 0 THEN booked_hours * 3 / available_hours ELSE 0.0 END)')} AS utilisation FROM ({UTILISATION_SQL['parent_utilisation']})",
    "top_release_candidates": f"SELECT site, kind, s_suppkey, effective, row_number() OVER (PARTITION BY site, kind ORDER BY effective, s_suppkey)::INTEGER AS rank_value FROM ({UTILISATION_SQL['unit_utilisation']}), (VALUES ('light', 4), ('site', 3), ('hybrid', 6)) v(kind, k) QUALIFY rank_value <= k",
    "scenario_score": " UNION ALL ".join(f"SELECT site, '{k}' AS dimension, {r(f'least(1.0, greatest(0.0, {v}))')} AS score, {w}::DOUBLE AS weight, CASE WHEN booked_ratio > 0 THEN {r(f'({r(f'least(1.0, greatest(0.0, {v}))')} * {w}::DOUBLE)')} ELSE 0.0 END AS weighted FROM ({UTILISATION_SQL['site_utilisation']})" for k, (v, w) in _DIMS.items()),
    "home_site": "SELECT c_mktsegment, n_name, w::DOUBLE AS weight FROM (SELECT c_mktsegment, n_name, sum(c_acctbal::DECIMAL(18,2)) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY w DESC, n_name) = 1",
    "constraint_slack": f"SELECT s_suppkey AS \"constraint\", {r('coalesce(a, 0.0)')} AS activity, 50000.0::DOUBLE AS upper, {r('(50000.0::DOUBLE - coalesce(a, 0.0))')} AS slack, abs(50000.0::DOUBLE - coalesce(a, 0.0)) <= 1e-5 AS binding FROM supplier LEFT JOIN (SELECT l_suppkey, sum(q * (p_size / 10.0::DOUBLE)) AS a FROM (SELECT l_suppkey, l_partkey, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey GROUP BY 1) ON s_suppkey = l_suppkey",
    "allocation": f"SELECT d.g AS c_nationkey, d.k AS c_custkey, s.k AS s_suppkey, least(d.e, s.e) - greatest(d.e - d.a, s.e - s.a) AS amount FROM ({_D}) d JOIN ({_S}) s ON d.g = s.g AND d.e - d.a < s.e AND s.e - s.a < d.e WHERE least(d.e, s.e) > greatest(d.e - d.a, s.e - s.a)",
}
