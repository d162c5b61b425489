"""Wording of texts, forms of values, recurring cost by component, and checks over other results, over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..operators import assurance as a
from ..operators import costs as c
from ..operators import wording as w
from ..sources.tables import census, table
from . import quality, reporting, rules, utilisation
from .utilisation import r

PHRASES = [w.Phrase("license", ("mit license",)), w.Phrase("token ="), w.Phrase("under the", ("version 2.0", "mit")), w.Phrase("example.com")]
#: Replaced in this order.
REPLACED = {"released under": "offered under", "the apache license": "a permissive licence", "license": "licence", "token =": "value ="}
CLOSING = "End of text."
MARKS = [w.Mark("word", "todo"), w.Mark("word", "the"), w.Mark("term", "mit license"), w.Mark("term", "lorem ipsum"), w.Mark("pattern", r"(/home/|/Users/|[A-Z]:\\)"), w.Mark("pattern", r"[#$%&]{3}")]
LABELS = {"F": "Finished", "O": "Open"}
NAMED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
PREFERRED = ("p_name", "s_name", "c_name", "n_name", "r_name")
COMPONENTS = {"cleaning": "variable", "energy": "semi_variable", "rates": "fixed"}
CHECKS = a.catalogue(
    [
        a.Check("ASR-ING-001", "ingestion", "critical", least=1), a.Check("ASR-ING-002", "ingestion", least=5), a.Check("ASR-DQ-001", "data_quality", most=0.3), a.Check("ASR-REF-001", "references", "critical", most=0),
        a.Check("ASR-UTL-001", "utilisation", least=1), a.Check("ASR-COM-001", "wording", most=0), a.Check("ASR-DOC-001", "unfinished", most=0, least=0), a.Check("ASR-FIN-001", "recurring_cost", least=0, cautious=True), a.Check("ASR-REL-001", "release"),
    ]
)


def wording_findings(spark: SparkSession, d: str) -> DataFrame:
    return w.forbidden_phrases(table(spark, d, "documents"), ["doc_id"], "text", PHRASES)


def wording_controlled(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of every text after replacement, and whether anything but the closing words was new."""
    text = F.col("text")
    plain, whole = w.controlled(text, REPLACED), w.controlled(text, REPLACED, CLOSING)
    return table(spark, d, "documents").select("doc_id", F.char_length(whole).cast("long").alias("n_chars"), (plain != text).alias("changed"), F.md5(whole.cast("binary")).alias("digest"))


def unfinished_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("record_id"), "text")
    rows = rows.unionByName(table(spark, d, "conversations").select(F.lit("conversations").alias("origin"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), "text"))
    return w.unfinished(rows, ["origin", "record_id"], "text", MARKS)


def canonical_orders(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a line of a canonical file."""
    rows = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,4)")).withColumn("is_open", F.col("o_orderstatus") == "O")
    names = ("o_orderkey", "o_orderdate", "o_totalprice", "price", "is_open", "o_orderpriority")
    return rows.select("o_orderkey", F.concat_ws(",", *[display.canonical_value(rows, x) for x in names]).alias("line"))


def display_values(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", display.currency(x).alias("price"), display.number(x / 7).alias("share"), display.integer(F.when(x > 50_000, x)).alias("whole"), display.status_label(F.when(x > 20_000, F.col("o_orderstatus")), LABELS).alias("status"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of every entity; a table without a name column gives its first column."""
    own = lambda t, key: (lambda rows: rows.select(F.lit(t).alias("table_name"), F.col(key).cast("long").alias("entity"), display.display_name(rows, PREFERRED).alias("display_name")))(table(spark, d, t))
    return reduce(DataFrame.unionByName, [own(t, key) for t, key in NAMED.items()])


def recurring_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the cost of all nations, and what goes with the nations that lose a unit."""
    units = reporting.unit_actions(spark, d)
    cost = lambda x: F.sum(x.cast("decimal(18,2)")).cast("double")
    owed, owned = F.greatest(-F.col("s_acctbal"), F.lit(0.0)), F.greatest("s_acctbal", F.lit(0.0))
    parents = units.groupBy("s_nationkey").agg(cost(owned).alias("energy"), cost(owed).alias("cleaning"), (F.count(F.lit(1)) * 120.0).alias("rates"), F.max(F.col("action") != "retain").alias("released"))
    return c.recurring_components(parents, "released", COMPONENTS)


def assurance_results(spark: SparkSession, d: str) -> DataFrame:
    failed = F.sum("failed") / F.sum("checked")
    count = lambda rows: rows.agg(F.count(F.lit(1)).alias("observed"))
    measures = {
        "ingestion": lambda: census(spark, d, list(NAMED)).agg(F.min("n_rows").alias("observed")),
        "data_quality": lambda: rules.rule_results(spark, d).agg(failed.alias("observed")),
        "references": lambda: rules.reference_census(spark, d).agg(F.sum("orphans").alias("observed")),
        "utilisation": lambda: count(utilisation.QUERIES["unit_utilisation"](spark, d)),
        "wording": lambda: count(wording_findings(spark, d)),
        "unfinished": lambda: count(unfinished_texts(spark, d)),
        "recurring_cost": lambda: recurring_components(spark, d).agg(F.min("difference").alias("observed")),
    }
    return a.run_checks(spark, CHECKS, measures)


def assurance_verdict(spark: SparkSession, d: str) -> DataFrame:
    return a.verdict(assurance_results(spark, d))


QUERIES = {f.__name__: f for f in (wording_findings, wording_controlled, unfinished_texts, canonical_orders, display_values, display_names, recurring_components, assurance_results, assurance_verdict)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(p: w.Phrase) -> str:
    free = " AND ".join(f"NOT contains(low, {_q(x.lower())})" for x in p.allowed) or "true"
    return f"SELECT doc_id, {_q(p.phrase)} AS phrase, ((length(low) - length(replace(low, {_q(p.phrase.lower())}, ''))) // {len(p.phrase)})::BIGINT AS occurrences FROM (SELECT doc_id, lower(text) AS low FROM documents) WHERE contains(low, {_q(p.phrase.lower())}) AND {free}"


def _replaced() -> str:
    out = "text"
    for phrase, plain in REPLACED.items():
        for form in dict.fromkeys((phrase, phrase.title())):
            out = f"replace({out}, {_q(form)}, {_q(plain)})"
    return out


_TEXTS = "(SELECT 'documents' AS origin, doc_id::VARCHAR AS record_id, text FROM documents UNION ALL SELECT 'conversations', conv_id || ':' || turn, text FROM conversations)"
_FINDINGS = " UNION ALL ".join(map(_found, PHRASES))
_UNFINISHED = " UNION ALL ".join(f"SELECT origin, record_id, '{m.kind}' AS kind, {_q(m.text)} AS mark FROM {_TEXTS} WHERE regexp_matches(text, {_q(m.pattern)})" for m in MARKS)
_PARENTS = f"SELECT s_nationkey, sum(greatest(s_acctbal, 0.0)::DECIMAL(18,2))::DOUBLE AS energy, sum(greatest(-s_acctbal, 0.0)::DECIMAL(18,2))::DOUBLE AS cleaning, (count(*) * 120.0)::DOUBLE AS rates, bool_or(action <> 'retain') AS released FROM ({reporting.ORACLE_SQL['unit_actions']}) GROUP BY 1"
_COMPONENTS = " UNION ALL ".join(
    f"""SELECT '{k}' AS component, '{kind}' AS classification, {r('b')} AS baseline, {r('(b - x)')} AS case_amount, {r('x')} AS difference,
      CASE WHEN '{kind}' = 'variable' AND NOT s THEN 'kept_without_release' WHEN '{kind}' = 'semi_variable' AND s THEN 'removed_with_floor' WHEN x <> 0 THEN 'removed' ELSE 'retained' END AS treatment
      FROM (SELECT sum({k}) AS b, coalesce(sum({k}) FILTER (WHERE released), 0) AS x, bool_or(released) AS s FROM ({_PARENTS}))"""
    for k, kind in COMPONENTS.items()
)
_MEASURES = {
    "ingestion": "SELECT min(n) FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in NAMED) + ")",
    "data_quality": f"SELECT sum(failed) / sum(checked) FROM ({rules.ORACLE_SQL['rule_results']})",
    "references": f"SELECT sum(orphans) FROM ({rules.ORACLE_SQL['reference_census']})",
    "utilisation": f"SELECT count(*) FROM ({utilisation.ORACLE_SQL['unit_utilisation']})",
    "wording": f"SELECT count(*) FROM ({_FINDINGS})",
    "unfinished": f"SELECT count(*) FROM ({_UNFINISHED})",
    "recurring_cost": f"SELECT min(difference) FROM ({_COMPONENTS})",
}


def _checked(x: a.Check) -> str:
    seen = f"({_MEASURES[x.category]})::DOUBLE" if x.category in _MEASURES else "NULL::DOUBLE"
    holds = " AND ".join(["observed IS NOT NULL", *([f"observed >= {x.least}"] if x.least is not None else []), *([f"observed <= {x.most}"] if x.most is not None else [])])
    return f"SELECT '{x.check_id}' AS check_id, '{x.category}' AS category, '{x.severity}' AS severity, CASE WHEN {holds} THEN '{'pass_with_warnings' if x.cautious else 'pass'}' ELSE 'fail' END AS status, observed FROM (SELECT {seen} AS observed)"


_RESULTS = " UNION ALL ".join(map(_checked, CHECKS.values()))
_LINE = f"""o_orderkey || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ',' || regexp_replace(printf('%.4f', {r('o_totalprice')}), '\\.?0+$', '') || ',' || round(o_totalprice::DECIMAL(18,4), 2)::DECIMAL(38,2) || ',' || (o_orderstatus = 'O') || ',' || o_orderpriority"""
ORACLE_SQL = {
    "wording_findings": _FINDINGS,
    "wording_controlled": f"SELECT doc_id, length(whole) AS n_chars, plain <> text AS changed, md5(whole) AS digest FROM (SELECT doc_id, text, plain, CASE WHEN contains(plain, {_q(CLOSING)}) THEN plain ELSE plain || ' ' || {_q(CLOSING)} END AS whole FROM (SELECT doc_id, text, {_replaced()} AS plain FROM documents))",
    "unfinished_texts": _UNFINISHED,
    "canonical_orders": f"SELECT o_orderkey, {_LINE} AS line FROM orders",
    "display_values": f"""SELECT o_orderkey, format('GBP {{:,.0f}}', {r('o_totalprice', 0)}) AS price, format('{{:,.1f}}', {r('(o_totalprice / 7)', 1)}) AS share, CASE WHEN o_totalprice > 50000 THEN format('{{:,}}', trunc(o_totalprice)::BIGINT) ELSE 'n/a' END AS whole,
      CASE WHEN o_totalprice > 20000 THEN CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END ELSE 'Insufficient Evidence' END AS status FROM orders""",
    "display_names": " UNION ALL ".join(f"SELECT '{t}' AS table_name, {key}::BIGINT AS entity, {key if t == 'orders' else key[0] + '_name'}::VARCHAR AS display_name FROM {t}" for t, key in NAMED.items()),
    "recurring_components": _COMPONENTS,
    "assurance_results": _RESULTS,
    "assurance_verdict": f"""SELECT *, CASE WHEN blocking > 0 THEN 'blocked' WHEN failed > 0 THEN 'review_required' WHEN warned > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS readiness
      FROM (SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'pass_with_warnings') AS warned, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'fail' AND severity = 'critical') AS blocking FROM ({_RESULTS}))""",
}
