"""Rejected rows, duplicates, declared issues, lineage, moves and stand-ins over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normalise_text, round_half_away
from ..operators import issues, lineage, scenario as s
from ..operators.bands import band_join
from ..operators.duplicates import DuplicateType, candidate_members, duplicate_candidates, tagged_keys
from ..operators.fallback import first_with_rows
from ..operators.reporting import numbered
from ..sources.contract import conform
from ..sources.tables import census, table
from . import reporting, scenario
from .checks import REFERENCES
from .utilisation import r

ORDER_LINE = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderdate", T.DateType()), T.StructField("o_totalprice", T.DecimalType(7, 2)), T.StructField("o_orderpriority", T.StringType())])
#: Bands of a day in minutes: name, start, end.
BANDS = [("night", 0, 359), ("dawn", 359, 420), ("morning", 420, 720), ("noon", 720, 721), ("afternoon", 721, 1080), ("evening", 1080, 1320), ("late", 1320, 1440)]
STAGES = sorted({t for a, _, b, _ in REFERENCES for t in (a, b)})
#: What each stage's run rests on; a stage of a table that is not there is missing.
UPSTREAM = sorted({(a, b) for a, _, b, _ in REFERENCES} | {("events", "sessions")})


def contract_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines of text under a contract whose price has seven digits: the lines that break it."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("%.2f", "o_totalprice"), "o_orderpriority")
    found = conform(table(spark, d, "orders").select(line.alias("line")), ORDER_LINE)
    return found.where(F.size("problems") > 0).select(F.col("line").alias("raw_line"), F.array_join("problems", ";").alias("reasons"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))


def _demand(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").where("c_acctbal > 0").join(_places(spark, d), F.col("c_nationkey") == F.col("nation"))
    return own.select("region", "c_custkey", F.col("nation").alias("source_nation"), F.floor("c_acctbal").cast("double").alias("need"))


def regional_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a region served by its suppliers in turn; what is left of a need stands on its first row, and a customer who got nothing has one."""
    offers = table(spark, d, "supplier").where("s_acctbal > 0").join(_places(spark, d), F.col("s_nationkey") == F.col("nation")).select("region", "s_suppkey", F.col("nation").alias("target_nation"), (F.floor("s_acctbal") * 10).cast("double").alias("offer"))
    demand = _demand(spark, d)
    rows = s.with_unmet(s.allocate(demand, offers, "region", "need", ["c_custkey", "source_nation"], "offer", ["s_suppkey", "target_nation"]), demand, "region", "need", ["c_custkey", "source_nation"])
    return rows.select("region", "c_custkey", "source_nation", F.col("s.s_suppkey").alias("s_suppkey"), F.col("s.target_nation").alias("target_nation"), "amount", "unmet")


def site_moves(spark: SparkSession, d: str) -> DataFrame:
    return s.moves(regional_allocation(spark, d).where("s_suppkey IS NOT NULL"), ["region"], "source_nation", "target_nation", "amount")


def diagnostics_all(spark: SparkSession, d: str) -> DataFrame:
    """Shortfalls of nations, then how many candidates each reason blocks, numbered through."""
    short = reporting.allocation_totals(spark, d).where("unmet > 0").select(F.lit("capacity_shortfall").alias("diagnostic_type"), F.col("c_nationkey").cast("string").alias("entity_id"), F.col("unmet").alias("shortfall_value"))
    blocked = scenario.candidate_reasons(spark, d).select(F.concat("reason", F.lit("_blocked")).alias("diagnostic_type"), F.lit("candidate_catalogue").alias("entity_id"), F.col("n").cast("double").alias("shortfall_value"))
    return numbered(short.unionByName(blocked), ["diagnostic_type", "entity_id"], "DIAG-%04d", "diagnostic_id")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: normalise_text(F.col(c))
    key = lambda c: DuplicateType("duplicate_identifier", "high", F.col(c).cast("string"))
    part = [key("p_partkey"), DuplicateType("duplicate_name_within_brand", "low", F.concat("p_brand", F.lit("|"), name("p_name"))), DuplicateType("duplicate_name_global", "low", name("p_name"))]
    parts = [tagged_keys(table(spark, d, "part"), "part", F.col("p_partkey"), part)]
    parts.append(tagged_keys(table(spark, d, "customer"), "customer", F.col("c_custkey"), [key("c_custkey"), DuplicateType("duplicate_customer_name", "medium", name("c_name"))]))
    parts.append(tagged_keys(table(spark, d, "labels"), "labels", F.col("doc_id"), [key("doc_id")]))
    return reduce(DataFrame.unionByName, parts)


def duplicate_types(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_candidates(_tagged(spark, d))


def duplicate_type_members(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged(spark, d)
    return candidate_members(tagged, duplicate_candidates(tagged))


def issue_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Labels declare which documents are of low quality; those of under 500 characters are found to be."""
    as_issue = lambda rows: rows.select(F.lit("documents").alias("dataset"), F.col("doc_id").cast("string").alias("record_id"), F.lit("low_quality").alias("issue_type"))
    return issues.compared(as_issue(table(spark, d, "labels").where("quality = 0")), as_issue(table(spark, d, "documents").where("n_chars < 500")))


def intentional_detection(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders and parts of size 1 are declared; an order is detected by its status, a part by duplicates among parts."""
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("orders").alias("dataset"), F.col("o_orderkey").cast("string").alias("record_id"), F.lit("urgent_open").alias("issue_type"))
    parts = table(spark, d, "part").where("p_size = 1").select(F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("record_id"), F.lit("duplicate_label").alias("issue_type"))
    status = reporting.classified_orders(spark, d).select(F.lit("orders").alias("dataset"), F.col("o_orderkey").cast("string").alias("record_id"), "record_status")
    status = status.unionByName(table(spark, d, "part").select(F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("record_id"), F.lit("accepted").alias("record_status")))
    return issues.detected(orders.unionByName(parts), status, duplicate_types(spark, d), ["urgent_open"], ["duplicate_label"])


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UPSTREAM, "run string, upstream string")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return census(spark, d, [*STAGES, "events"]).select(F.col("table_name").alias("run"), F.col("n_rows").alias("checksum"))


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    """What the run of each table rests on, with the rows of what it rests on, where that is there."""
    return lineage.closure(_edges(spark)).join(_runs(spark, d).select(F.col("run").alias("of"), F.col("checksum").alias("n_rows")), F.col("upstream") == F.col("of"), "left").select("run", "upstream", "depth", "n_rows")


def lineage_errors(spark: SparkSession, d: str) -> DataFrame:
    return lineage.lineage_errors(_runs(spark, d), _edges(spark))


def run_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the runs, each of which hashes the rows of its table and the ids of all that it rests on."""
    return lineage.run_ids(_runs(spark, d), _edges(spark), "v1")


def banded_events(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "band string, start int, end int")
    rows = table(spark, d, "events").select("event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.col("value").cast("decimal(18,2)").alias("value"))
    joined = band_join(rows, F.col("minute"), bands)
    return joined.groupBy("band", "event_type").agg(F.count(F.lit(1)).alias("n"), round_half_away(F.sum("value").cast("double"), 2).alias("total"))


def top_units_by_service(spark: SparkSession, d: str) -> DataFrame:
    """The twelve richest suppliers of its own region for each segment of a region, and whether they fit."""
    services = table(spark, d, "customer").join(_places(spark, d), F.col("c_nationkey") == F.col("nation")).groupBy("c_mktsegment", F.col("region").alias("service_region")).agg(F.count(F.lit(1)).alias("customers"))
    units = table(spark, d, "supplier").join(_places(spark, d), F.col("s_nationkey") == F.col("nation")).select("s_suppkey", "s_acctbal", F.col("region").alias("unit_region"))
    best = units.where(F.col("unit_region") == F.col("service_region").outer()).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(12)
    fits = s.first_failing([("inactive", F.col("s_acctbal") < 0), ("too_small", F.col("s_acctbal") < F.col("customers"))])
    return services.lateralJoin(best).select("c_mktsegment", F.col("service_region").alias("region"), "s_suppkey", "s_acctbal", fits.alias("status"))


def _by_status(spark: SparkSession, d: str, *statuses: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return first_with_rows(*[rows.where(F.col("o_orderstatus") == x) for x in statuses])


def fallback_taken(spark: SparkSession, d: str) -> DataFrame:
    """Orders that wait; as there are none of that status, those in progress."""
    return _by_status(spark, d, "W", "P", "F")


def fallback_unused(spark: SparkSession, d: str) -> DataFrame:
    return _by_status(spark, d, "F", "P")


QUERIES = {
    f.__name__: f
    for f in (contract_rejects, regional_allocation, site_moves, diagnostics_all, duplicate_types, duplicate_type_members, issue_verdicts, intentional_detection, lineage_closure, lineage_errors, run_chain, banded_events, top_units_by_service, fallback_taken, fallback_unused)
}

_norm = lambda c: f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\\w\\s#''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_D = "SELECT n_regionkey AS region, c_custkey, n_nationkey AS source_nation, floor(c_acctbal)::DOUBLE AS need, sum(floor(c_acctbal)::DOUBLE) OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS e FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0"
_O = "SELECT n_regionkey AS region, s_suppkey, n_nationkey AS target_nation, (floor(s_acctbal) * 10)::DOUBLE AS offer, sum((floor(s_acctbal) * 10)::DOUBLE) OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS e FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0"
_REGIONAL = f"""SELECT region, c_custkey, source_nation, s_suppkey, target_nation, amount, CASE WHEN row_number() OVER (PARTITION BY region, c_custkey ORDER BY s_suppkey) = 1 THEN need - sum(amount) OVER (PARTITION BY region, c_custkey) ELSE 0.0 END AS unmet FROM (
  SELECT d.region, c_custkey, source_nation, need, s_suppkey, target_nation, CASE WHEN o.e IS NULL THEN 0.0 ELSE least(d.e, o.e) - greatest(d.e - need, o.e - offer) END AS amount FROM ({_D}) d LEFT JOIN ({_O}) o ON d.region = o.region AND greatest(d.e - need, o.e - offer) < least(d.e, o.e))"""
_TAGGED = f"""SELECT 'part' AS dataset, 'duplicate_identifier' AS duplicate_type, 'high' AS severity, p_partkey::VARCHAR AS match_basis, p_partkey::VARCHAR AS record_id FROM part
  UNION ALL SELECT 'part', 'duplicate_name_within_brand', 'low', p_brand || '|' || {_norm('p_name')}, p_partkey::VARCHAR FROM part UNION ALL SELECT 'part', 'duplicate_name_global', 'low', {_norm('p_name')}, p_partkey::VARCHAR FROM part
  UNION ALL SELECT 'customer', 'duplicate_identifier', 'high', c_custkey::VARCHAR, c_custkey::VARCHAR FROM customer UNION ALL SELECT 'customer', 'duplicate_customer_name', 'medium', {_norm('c_name')}, c_custkey::VARCHAR FROM customer
  UNION ALL SELECT 'labels', 'duplicate_identifier', 'high', doc_id::VARCHAR, doc_id::VARCHAR FROM labels"""
_GROUPS = f"""SELECT dataset, duplicate_type, severity, match_basis, count(*) AS members, 'DUP-' || substr(sha256(dataset || '|' || duplicate_type || '|' || match_basis), 1, 12) AS group_id, 'review_source_records' AS recommended_action
  FROM ({_TAGGED}) WHERE match_basis IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1"""
_EDGES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in UPSTREAM) + ") e(run, upstream)"
_RUNS = " UNION ALL ".join(f"SELECT '{t}' AS run, count(*) AS n_rows FROM {t}" for t in [*STAGES, "events"])
_WAYS = f"WITH RECURSIVE ways AS (SELECT run, upstream, 1 AS depth FROM {_EDGES} UNION ALL SELECT ways.run, e.upstream, depth + 1 FROM ways JOIN {_EDGES} ON ways.upstream = e.run), c AS (SELECT run, upstream, max(depth)::INTEGER AS depth FROM ways GROUP BY 1, 2), n AS ({_RUNS})"


def _chain() -> str:
    """Ids in an order in which each run comes after all that it rests on."""
    above: dict[str, list[str]] = {t: [b for a, b in UPSTREAM if a == t] for t in STAGES}
    level: dict[str, int] = {}
    while len(level) < len(above):
        level |= {t: 1 + max([level[b] for b in up], default=-1) for t, up in above.items() if t not in level and all(b in level for b in up)}
    made = []
    for t in sorted(level, key=level.get):
        ids = "array_to_string(list_sort([" + ", ".join(f"(SELECT run_id FROM id_{b})" for b in above[t]) + "]), ',')" if above[t] else "''"
        made.append(f"id_{t} AS (SELECT '{t}' AS run, {level[t]} AS level, 'RUN-' || substr(sha256('v1|{t}|' || count(*) || '|' || {ids}), 1, 16) AS run_id FROM {t})")
    return f"WITH {', '.join(made)} " + " UNION ALL ".join(f"SELECT * FROM id_{t}" for t in level) + " UNION ALL SELECT 'events', 1, NULL"


_BANDED = "SELECT band, event_type, count(*) AS n, {} AS total FROM events JOIN (VALUES {}) b(band, s, e) ON hour(ts) * 60 + minute(ts) >= s AND hour(ts) * 60 + minute(ts) < e GROUP BY 1, 2"
ORACLE_SQL = {
    "contract_rejects": "SELECT o_orderkey || ',' || strftime(o_orderdate, '%Y-%m-%d') || ',' || printf('%.2f', o_totalprice) || ',' || o_orderpriority AS raw_line, 'o_totalprice:decimal(7,2)' AS reasons FROM orders WHERE abs(o_totalprice::DECIMAL(18,2)) >= 100000",
    "regional_allocation": _REGIONAL,
    "site_moves": f"SELECT region, source_nation, target_nation, sum(amount) AS moved, CASE WHEN sum(amount) > 1e-6 THEN 'candidate_move' ELSE 'not_moved' END AS status FROM ({_REGIONAL}) WHERE s_suppkey IS NOT NULL AND source_nation <> target_nation GROUP BY 1, 2, 3",
    "diagnostics_all": f"SELECT *, 'DIAG-' || lpad((row_number() OVER (ORDER BY diagnostic_type, entity_id))::VARCHAR, 4, '0') AS diagnostic_id FROM (SELECT 'capacity_shortfall' AS diagnostic_type, c_nationkey::VARCHAR AS entity_id, unmet AS shortfall_value FROM ({reporting.ORACLE_SQL['allocation_totals']}) WHERE unmet > 0 UNION ALL SELECT reason || '_blocked', 'candidate_catalogue', n::DOUBLE FROM ({scenario.ORACLE_SQL['candidate_reasons']}))",
    "duplicate_types": _GROUPS,
    "duplicate_type_members": f"SELECT group_id, record_id FROM ({_TAGGED}) t JOIN ({_GROUPS}) g USING (dataset, duplicate_type, match_basis)",
    "issue_verdicts": """SELECT 'documents' AS dataset, coalesce(a.k, b.k) AS record_id, 'low_quality' AS issue_type, coalesce(declared, 0) AS declared, coalesce(found, 0) AS found, CASE WHEN b.k IS NULL THEN 'missed' WHEN a.k IS NULL THEN 'undeclared' ELSE 'found' END AS verdict
  FROM (SELECT doc_id::VARCHAR AS k, count(*) AS declared FROM labels WHERE quality = 0 GROUP BY 1) a FULL JOIN (SELECT doc_id::VARCHAR AS k, count(*) AS found FROM documents WHERE n_chars < 500 GROUP BY 1) b ON a.k = b.k""",
    "intentional_detection": f"SELECT 'orders' AS dataset, o_orderkey::VARCHAR AS record_id, 'urgent_open' AS issue_type, record_status = 'accepted_with_warning' AS detected FROM ({reporting.ORACLE_SQL['classified_orders']}) JOIN orders USING (o_orderkey) WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'part', p_partkey::VARCHAR, 'duplicate_label', EXISTS (SELECT 1 FROM ({_GROUPS}) WHERE dataset = 'part') FROM part WHERE p_size = 1",
    "lineage_closure": f"{_WAYS} SELECT c.run, upstream, depth, n_rows FROM c LEFT JOIN n ON upstream = n.run",
    "lineage_errors": f"{_WAYS} SELECT c.run, upstream, 'missing_upstream' AS error FROM c LEFT JOIN n ON upstream = n.run WHERE n.run IS NULL",
    "run_chain": _chain(),
    "banded_events": _BANDED.format(r("sum(value::DECIMAL(18,2))::DOUBLE", 2), ", ".join(f"('{n}', {a}, {b})" for n, a, b in BANDS)),
    "top_units_by_service": "SELECT c_mktsegment, region, s_suppkey, s_acctbal, CASE WHEN s_acctbal < 0 THEN 'inactive' WHEN s_acctbal < customers THEN 'too_small' ELSE 'compatible' END AS status FROM (SELECT c_mktsegment, n_regionkey AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) JOIN (SELECT s_suppkey, s_acctbal, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON region = n_regionkey AND k <= 12",
    "fallback_taken": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'",
    "fallback_unused": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
}
