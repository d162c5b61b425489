"""Data quality over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalise_text
from ..operators import quality as q
from ..sources.tables import census, table


def customer_rules() -> list[q.Rule]:
    return [
        q.Rule("balance_negative", "customer", "validity", "medium", F.col("c_acctbal") < 0),
        q.Rule("segment_missing", "customer", "completeness", "high", F.col("c_mktsegment").isNull()),
        q.Rule("name_missing", "customer", "completeness", "high", F.col("c_name").isNull() | (F.trim("c_name") == "")),
    ]


def item_rules() -> list[q.Rule]:
    return [
        q.Rule("shipped_late", "lineitem", "consistency", "low", F.col("l_discount") > F.col("l_tax") + 0.05),
        q.Rule("quantity_range", "lineitem", "validity", "medium", ~F.col("l_quantity").between(1, 50)),
        q.Rule("open_return", "lineitem", "consistency", "medium", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
    ]


def part_rules() -> list[q.Rule]:
    return [q.Rule("size_range", "part", "validity", "low", ~F.col("p_size").between(1, 50)), q.Rule("type_missing", "part", "completeness", "medium", F.col("p_type").isNull())]


POLICY = {"high": "exclude", "medium": "exclude", "low": "keep"}


def dq_results(spark: SparkSession, d: str) -> DataFrame:
    parts = [q.check_rows(table(spark, d, name), rules) for name, rules in (("customer", customer_rules()), ("lineitem", item_rules()), ("part", part_rules()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dq_issues(spark: SparkSession, d: str) -> DataFrame:
    return q.issue_rows(table(spark, d, "customer"), F.col("c_custkey"), customer_rules())


def dq_scores(spark: SparkSession, d: str) -> DataFrame:
    return q.scores(dq_results(spark, d))


def dq_gates(spark: SparkSession, d: str) -> DataFrame:
    fine = dq_scores(spark, d).where("dataset <> 'all'")
    return q.worst(fine, ["dataset"], "status")


def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return q.duplicate_members(table(spark, d, "part"), [F.col("p_brand"), normalise_text(F.col("p_name"))], F.col("p_partkey")).select("p_partkey", "p_brand", "p_name", "group_size", "place")


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return q.duplicate_groups(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


def dq_orphans(spark: SparkSession, d: str) -> DataFrame:
    return q.orphans(table(spark, d, "documents"), table(spark, d, "labels").select(F.col("doc_id").alias("labelled")), "doc_id", "labelled").select("doc_id", "lang", "source")


def dq_linked(spark: SparkSession, d: str) -> DataFrame:
    return q.linked(table(spark, d, "documents"), table(spark, d, "labels").select(F.col("doc_id").alias("labelled")), "doc_id", "labelled").select("doc_id", "lang", "source")


def dq_population(spark: SparkSession, d: str) -> DataFrame:
    issues = dq_issues(spark, d)
    return q.population(table(spark, d, "customer"), "c_custkey", issues, POLICY, F.col("c_mktsegment") != "MACHINERY").select("c_custkey", "c_mktsegment", "included", "reason")


def dq_exclusions(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return q.cascade(orders, dq_population(spark, d), "o_custkey", "c_custkey")


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    layers = lambda t, key, kept: {"source": table(spark, d, t), "staging": table(spark, d, t).where(F.col(key).isNotNull()), "curated": table(spark, d, t).where(kept)}
    return q.reconcile({"customer": layers("customer", "c_custkey", F.col("c_acctbal") >= 0), "part": layers("part", "p_partkey", F.col("p_size") > 0), "orders": layers("orders", "o_orderkey", F.col("o_totalprice") >= 0)})


def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", normalise_text(F.col("p_name")).alias("normalised"))


def table_census(spark: SparkSession, d: str) -> DataFrame:
    return census(spark, d, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"])


QUERIES = {f.__name__: f for f in (dq_results, dq_issues, dq_scores, dq_gates, dq_duplicates, duplicate_groups, dq_orphans, dq_linked, dq_population, dq_exclusions, reconciliation, text_normalise, table_census)}

_NORM = "trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\\w\\s#''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RULES = [
    ("customer", "balance_negative", "validity", "medium", "c_acctbal < 0"), ("customer", "segment_missing", "completeness", "high", "c_mktsegment IS NULL"), ("customer", "name_missing", "completeness", "high", "c_name IS NULL OR trim(c_name) = ''"),
    ("lineitem", "shipped_late", "consistency", "low", "l_discount > l_tax + 0.05::DOUBLE"), ("lineitem", "quantity_range", "validity", "medium", "NOT l_quantity BETWEEN 1 AND 50"), ("lineitem", "open_return", "consistency", "medium", "l_returnflag = 'R' AND l_linestatus = 'O'"),
    ("part", "size_range", "validity", "low", "NOT p_size BETWEEN 1 AND 50"), ("part", "type_missing", "completeness", "medium", "p_type IS NULL"),
]
_RESULTS = " UNION ALL ".join(f"SELECT '{n}' AS rule, '{t}' AS dataset, '{dim}' AS dimension, '{sev}' AS severity, count(*) AS checked, count(*) FILTER (WHERE {c}) AS failed, CASE WHEN count(*) FILTER (WHERE {c}) = 0 THEN 'pass' ELSE 'fail' END AS status FROM {t}" for t, n, dim, sev, c in _RULES)
_ISSUES = " UNION ALL ".join(f"SELECT c_custkey::VARCHAR AS record_id, '{n}' AS rule, 'customer' AS dataset, '{sev}' AS severity, substr(sha256('customer|{n}|' || c_custkey::VARCHAR), 1, 24) AS evidence_key FROM customer WHERE {c}" for t, n, dim, sev, c in _RULES if t == "customer")
_P = "floor(avg(CASE WHEN status = 'pass' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0 + 0.5) / 100.0"
_SCORES = f"""SELECT *, CASE WHEN score >= 95 THEN 'pass' WHEN score >= 85 THEN 'pass_with_warnings' WHEN score >= 70 THEN 'manual_review_required' ELSE 'fail' END AS status FROM (
  SELECT dataset, dimension, {_P} AS score FROM ({_RESULTS}) GROUP BY 1, 2 UNION ALL SELECT dataset, 'all', {_P} FROM ({_RESULTS}) GROUP BY 1
  UNION ALL SELECT 'all', 'all', floor(avg(s) * 100.0 + 0.5) / 100.0 FROM (SELECT {_P} AS s FROM ({_RESULTS}) GROUP BY dataset))"""
_POPULATION = f"""SELECT c_custkey, c_mktsegment, reason IS NULL AS included, reason FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey::VARCHAR IN (SELECT record_id FROM ({_ISSUES}) WHERE severity IN ('high', 'medium')) THEN 'quality_issue' WHEN c_mktsegment = 'MACHINERY' THEN 'status_not_allowed' END AS reason FROM customer)"""
_DOC = "SELECT doc_id, lang, source FROM documents WHERE doc_id {} (SELECT doc_id FROM labels)"
ORACLE_SQL = {
    "dq_results": _RESULTS,
    "dq_issues": _ISSUES,
    "dq_scores": _SCORES,
    "dq_gates": f"SELECT dataset, count(*) AS checks, ['pass', 'pass_with_warnings', 'manual_review_required', 'fail'][max(list_position(['pass', 'pass_with_warnings', 'manual_review_required', 'fail'], status))] AS gate FROM ({_SCORES}) WHERE dataset <> 'all' GROUP BY 1",
    "dq_duplicates": f"SELECT p_partkey, p_brand, p_name, count(*) OVER (PARTITION BY p_brand, {_NORM}) AS group_size, row_number() OVER (PARTITION BY p_brand, {_NORM} ORDER BY p_partkey)::INTEGER AS place FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, {_NORM}) > 1",
    "duplicate_groups": "SELECT l_orderkey, l_linenumber, count(*) AS members, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS record_identifiers, 'DUP-' || substr(sha256(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR), 1, 12) AS group_id FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "dq_orphans": _DOC.format("NOT IN"),
    "dq_linked": _DOC.format("IN"),
    "dq_population": _POPULATION,
    "dq_exclusions": f"SELECT o_orderkey, o_custkey, 'parent_excluded' AS reason FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ({_POPULATION}) WHERE NOT included)",
    "reconciliation": "SELECT *, CASE WHEN source = staging AND source = curated THEN 'pass' ELSE 'warning' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS source, count(*) FILTER (WHERE {k} IS NOT NULL) AS staging, count(*) FILTER (WHERE {c}) AS curated FROM {t}" for t, k, c in (("customer", "c_custkey", "c_acctbal >= 0"), ("part", "p_partkey", "p_size > 0"), ("orders", "o_orderkey", "o_totalprice >= 0"))) + ")",
    "text_normalise": f"SELECT p_partkey, {_NORM} AS normalised FROM part",
    "table_census": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
}
