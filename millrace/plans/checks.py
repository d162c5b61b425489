"""References, verdicts, strict values, scaled errors and small reports over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ordinal, round_half_away, strict_cast
from ..operators import forecast as f
from ..operators import quality as q
from ..sources.tables import table
from . import forecast, reporting, scenario
from .utilisation import r

#: (child, key, parent, key)
REFERENCES = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"),
]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
FIRST_MOVES = 5


def dq_references(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [q.reference_counts(f"{a}.{x}", table(spark, d, a), table(spark, d, b), x, y) for a, x, b, y in REFERENCES])


def reference_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = dq_references(spark, d).withColumn("dataset", F.substring_index("spec", ".", 1))
    return q.verdicts(rows, ["dataset"], F.col("orphans") + F.col("unset") > 0)


def priority_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The place of a priority in the agreed order; one that is not agreed has none."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("place", ordinal(F.col("o_orderpriority"), PRIORITIES))


def priority_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The number that a priority starts with; anything else there stops the query."""
    number = strict_cast(F.substring_index("o_orderpriority", "-", 1), "int")
    return table(spark, d, "orders").select("o_orderkey", number.alias("number"))


def places_known(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers or suppliers, once each."""
    sides = [table(spark, d, t).select(F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return sides[0].union(sides[1]).distinct()


def place_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Whom to ask in each nation: its richest supplier, else its richest customer, else nobody."""
    nation = table(spark, d, "nation").select("n_nationkey")
    best = lambda t, k, name, money, key: table(spark, d, t).groupBy(F.col(k).alias(f"{t}_place")).agg(F.max_by(name, F.struct(money, -F.col(key))).alias(f"of_{t}"))
    s, c = best("supplier", "s_nationkey", "s_name", "s_acctbal", "s_suppkey"), best("customer", "c_nationkey", "c_name", "c_acctbal", "c_custkey")
    joined = nation.join(s, F.col("n_nationkey") == F.col("supplier_place"), "left").join(c, F.col("n_nationkey") == F.col("customer_place"), "left")
    return joined.select("n_nationkey", F.coalesce("of_supplier", "of_customer", F.lit("nobody")).alias("contact"))


def segment_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The highest balance and key of each segment, and the name that goes with the balance."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("balance"), F.max("c_custkey").alias("newest"), F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("richest"))


def last_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last order, customers without one at the end of the list."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    joined = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order")
    return joined.orderBy(F.asc_nulls_last("last_order"), "c_custkey")


def first_moves(spark: SparkSession, d: str) -> DataFrame:
    """The first five orders of each customer: tasks keep no more of any customer before the shuffle."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").withColumn("place", place).where(F.col("place") <= FIRST_MOVES).select("o_custkey", "place", "o_orderkey")


def scenario_final(spark: SparkSession, d: str) -> DataFrame:
    """Each site's score in one number, with the largest of its parts."""
    rows = scenario.scenario_score(spark, d)
    return rows.groupBy("site").agg(F.sum(F.col("weighted").cast("decimal(20,4)")).cast("double").alias("score"), F.max_by("dimension", F.struct("weighted", "dimension")).alias("leading"))


def forecast_bundle(spark: SparkSession, d: str) -> DataFrame:
    return f.scaled_errors(forecast.backtest(spark, d), reporting.series_scale(spark, d), ["series_id", "model"])


def forecast_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = reporting.final_forecasts(spark, d)
    return rows.groupBy("series_id").agg(round_half_away(F.sum(F.col("forecast").cast("decimal(20,4)")).cast("double")).alias("total"), F.max("h").alias("months"))


_OF = [dq_references, reference_verdicts, priority_ranks, priority_numbers, places_known, place_contacts, segment_peaks, last_orders, first_moves, scenario_final, forecast_bundle, forecast_totals]
QUERIES = {x.__name__: x for x in _OF}

_REFERENCES = " UNION ALL ".join(
    f"SELECT '{a}.{x}' AS spec, count(*) AS n_rows, count(*) FILTER (WHERE {x} IS NOT NULL AND known IS NULL) AS orphans, count(*) FILTER (WHERE {x} IS NULL) AS unset FROM (SELECT {x} FROM {a}) LEFT JOIN (SELECT DISTINCT {y} AS known FROM {b}) ON {x} = known"
    for a, x, b, y in REFERENCES
)
ORACLE_SQL = {
    "dq_references": _REFERENCES,
    "reference_verdicts": f"SELECT string_split(spec, '.')[1] AS dataset, count(*) AS checks, bool_and(orphans + unset = 0) AS all_pass, bool_or(orphans + unset > 0) AS any_fail FROM ({_REFERENCES}) GROUP BY 1",
    "priority_ranks": f"SELECT o_orderpriority, count(*) AS n, nullif(list_position({PRIORITIES}, o_orderpriority), 0)::INTEGER AS place FROM orders GROUP BY 1",
    "priority_numbers": "SELECT o_orderkey, string_split(o_orderpriority, '-')[1]::INTEGER AS number FROM orders",
    "places_known": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "place_contacts": """SELECT n_nationkey, coalesce(s, c, 'nobody') AS contact FROM nation
      LEFT JOIN (SELECT s_nationkey, s_name AS s FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) ON n_nationkey = s_nationkey
      LEFT JOIN (SELECT c_nationkey, c_name AS c FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1) ON n_nationkey = c_nationkey""",
    "segment_peaks": "SELECT c_mktsegment, max(c_acctbal) AS balance, max(c_custkey) AS newest, first(c_name ORDER BY c_acctbal DESC, c_custkey DESC) AS richest FROM customer GROUP BY 1",
    "last_orders": "SELECT c_custkey, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 NULLS LAST, 1",
    "first_moves": f"SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS place, o_orderkey FROM orders QUALIFY place <= {FIRST_MOVES}",
    "scenario_final": f"SELECT site, sum(weighted::DECIMAL(20,4))::DOUBLE AS score, first(dimension ORDER BY weighted DESC, dimension DESC) AS leading FROM ({scenario.ORACLE_SQL['scenario_score']}) GROUP BY 1",
    "forecast_bundle": f"""SELECT series_id, model, bias_share, mae, scale, CASE WHEN scale > 0 THEN {r('(mae / scale)')} END AS mase FROM (
      SELECT series_id, model, CASE WHEN sum(actual) <> 0 THEN {r(f'(sum({forecast._X})::DOUBLE / sum(actual))')} END AS bias_share, {r(f'(sum(abs({forecast._X}))::DOUBLE / count(*))')} AS mae FROM ({forecast.ORACLE_SQL['backtest']}) GROUP BY 1, 2)
      LEFT JOIN ({reporting.ORACLE_SQL['series_scale']}) USING (series_id)""",
    "forecast_totals": f"SELECT series_id, {r('sum(forecast::DECIMAL(20,4))::DOUBLE')} AS total, max(h) AS months FROM ({reporting.ORACLE_SQL['final_forecasts']}) GROUP BY 1",
}
