"""The catalogue of rules over the test tables, limits by direction, and keys without a parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import direction_holds
from ..operators import rules as q
from ..sources.tables import table
from .checks import REFERENCES

COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
_TEXT = ("name", "segment", "brand", "type", "status", "priority", "flag", "props")
CATALOGUE = q.catalogue(
    [q.Entry(f"COMP-{t}-{c}", t, "completeness", "high" if c.endswith(("key", "_id")) else "medium", "filled" if c.endswith(_TEXT) else "required", (c,)) for t, cs in COLUMNS.items() for c in cs.split()]
    + [
        q.Entry("RANGE-balance", "customer", "validity", "low", "range", ("c_acctbal", -500, 9000)), q.Entry("RANGE-supplier-balance", "supplier", "validity", "low", "range", ("s_acctbal", -500, 9500)),
        q.Entry("RANGE-size", "part", "validity", "medium", "range", ("p_size", 1, 50)), q.Entry("RANGE-price", "part", "validity", "medium", "range", ("p_retailprice", 900, 2000)),
        q.Entry("RANGE-quantity", "lineitem", "validity", "medium", "range", ("l_quantity", 1, 50)), q.Entry("RANGE-discount", "lineitem", "validity", "low", "range", ("l_discount", 0, 0.09)),
        q.Entry("DOMAIN-status", "orders", "validity", "high", "domain", ("o_orderstatus", "F", "O", "P")), q.Entry("DOMAIN-priority", "orders", "validity", "medium", "domain", ("o_orderpriority", "1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
        q.Entry("DOMAIN-event", "events", "validity", "medium", "domain", ("event_type", "view", "click", "purchase", "signup")), q.Entry("ORDER-tax", "lineitem", "consistency", "low", "order", ("l_discount", "l_tax + 0.05")),
        q.Entry("COND-returned", "lineitem", "consistency", "medium", "conditional", ("l_returnflag = 'R'", "l_linestatus = 'F'")), q.Entry("COND-urgent-price", "orders", "consistency", "medium", "conditional", ("o_orderpriority = '1-URGENT'", "o_totalprice >= 5000")),
        q.Entry("COND-debt-cost", "supplier", "reconciliation", "high", "conditional", ("s_acctbal < 0", "s_acctbal > -900")),
    ]
)
LIMITS = {"minimum_quantity": ("sum(l_quantity)", 700.0), "maximum_discount": ("max(l_discount)", 0.1), "maximum_lines": ("count(*)", 30.0), "minimum_price": ("min(l_extendedprice)", 1000.0)}
_REFERENCES = [q.Reference(*x) for x in REFERENCES]


def rule_results(spark: SparkSession, d: str) -> DataFrame:
    return q.run_rules(CATALOGUE, lambda name: table(spark, d, name))


def reference_orphans(spark: SparkSession, d: str) -> DataFrame:
    return q.orphan_keys(q.reference_keys(lambda name: table(spark, d, name), _REFERENCES))


def reference_census(spark: SparkSession, d: str) -> DataFrame:
    return q.reference_totals(q.reference_keys(lambda name: table(spark, d, name), _REFERENCES), _REFERENCES)


def limit_checks(spark: SparkSession, d: str) -> DataFrame:
    """Measures of each supplier against their limits, from below or above by the limit's name."""
    measured = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.expr(e).cast("double").alias(k) for k, (e, _) in LIMITS.items()])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("limit_name"), F.col(k).alias("measure"), F.lit(x).alias("limit_value")) for k, (_, x) in LIMITS.items()]))
    rows = measured.select("l_suppkey", each)
    return rows.withColumn("holds", direction_holds(F.col("limit_name"), F.col("measure"), F.col("limit_value")))


QUERIES = {f.__name__: f for f in (rule_results, reference_orphans, reference_census, limit_checks)}

_SPECS = " UNION ALL ".join(f"SELECT '{a}.{x}' AS spec, {x}::VARCHAR AS key, count(*) AS n, {x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL) AS lost FROM {a} GROUP BY {x}" for a, x, b, y in REFERENCES)
ORACLE_SQL = {
    "rule_results": " UNION ALL ".join(f"SELECT '{e.rule_id}' AS rule, '{e.dataset}' AS dataset, '{e.dimension}' AS dimension, '{e.severity}' AS severity, count(*) AS checked, count(*) FILTER (WHERE {e.broken}) AS failed, CASE WHEN count(*) FILTER (WHERE {e.broken}) = 0 THEN 'pass' ELSE 'fail' END AS status FROM {e.dataset}" for e in CATALOGUE.values()),
    "reference_orphans": f"SELECT spec, key, n FROM ({_SPECS}) WHERE lost",
    "reference_census": f"SELECT spec, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (WHERE lost), 0)::BIGINT AS orphans, coalesce(sum(n) FILTER (WHERE key IS NULL), 0)::BIGINT AS unset FROM ({_SPECS}) GROUP BY 1",
    "limit_checks": " UNION ALL ".join(f"SELECT l_suppkey, '{k}' AS limit_name, ({e})::DOUBLE AS measure, {x}::DOUBLE AS limit_value, ({e})::DOUBLE {'>=' if k.startswith('minimum_') else '<='} {x}::DOUBLE AS holds FROM lineitem GROUP BY l_suppkey" for k, (e, x) in LIMITS.items()),
}
