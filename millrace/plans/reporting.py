"""Reporting operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import key_digest, round_half_away, safe_ratio
from ..operators import reporting as p
from ..sources.tables import table
from . import finance, forecast, quality, scenario, utilisation
from .utilisation import r

UPLIFT = {"hybrid": 0.93, "light": 1.0, "site": 1.03}
REASONS = {"1-URGENT": ["late", "staff"], "2-HIGH": ["staff"], "5-LOW": ["cost"]}
TRIGGERS = ["cost", "late"]
METRICS = ["mae", "rmse", "wape", "bias", "smape"]


def classified_orders(spark: SparkSession, d: str) -> DataFrame:
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    out = p.classify(table(spark, d, "orders"), [("price_negative", price < 0), ("customer_missing", F.col("o_custkey").isNull())], [("price_small", price < 20_000), ("urgent_open", (priority == "1-URGENT") & (F.col("o_orderstatus") == "O"))])
    return out.select("o_orderkey", "record_status", "warning_reason")


def curated_orders(spark: SparkSession, d: str) -> DataFrame:
    return p.curated(classified_orders(spark, d)).groupBy("record_status", "warning_reason").agg(F.count(F.lit(1)).alias("n"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return p.review_queue(quality.dq_issues(spark, d), ["medium"]).select("queue_id", "record_id", "rule")


def linkage(spark: SparkSession, d: str) -> DataFrame:
    return p.self_links(table(spark, d, "customer"), F.col("c_custkey"), F.col("c_acctbal") < 0)


def linkage_summary(spark: SparkSession, d: str) -> DataFrame:
    return linkage(spark, d).groupBy("method", "status").agg(F.count(F.lit(1)).alias("links"))


def match_bands(spark: SparkSession, d: str) -> DataFrame:
    score = round_half_away(safe_ratio(F.col("c_acctbal"), F.lit(10_000.0)))
    return table(spark, d, "customer").select("c_custkey", score.alias("score")).withColumn("band", p.match_band(F.col("score")))


def feasibility(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("debt"), F.min("c_acctbal").alias("low"))
    state = lambda fail, warn: F.when(fail, "fail").when(warn, "warning").otherwise("pass")
    rules = F.array(
        F.struct(F.lit(True).alias("critical"), state(F.col("n") < 2, F.col("n") < 8).alias("status")),
        F.struct(F.lit(True).alias("critical"), state(F.col("debt") > 9, F.col("debt") > 6).alias("status")),
        F.struct(F.lit(False).alias("critical"), state(F.col("low") < -990, F.col("low") < -900).alias("status")),
    )
    rows = c.select("nation", F.explode(rules).alias("x")).select("nation", "x.critical", "x.status")
    return p.feasibility(rows, ["nation"])


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Net present value with a cap by risk, and a confidence that loses points for each open question."""
    rows = finance.npv(spark, d)
    cap = F.when(F.col("payback_year").isNull(), 0.5).when(F.col("discounted_payback_year").isNull(), 0.75).otherwise(1.0)
    confidence = F.greatest(F.lit(0.0), 0.82 - F.when(F.col("payback_year").isNull(), 0.3).otherwise(0.0) - F.when(F.col("net_1y") < -5000, 0.1).otherwise(0.0))
    out = rows.select("case_id", "npv", cap.alias("cap"), round_half_away(F.col("npv") * cap, 2).alias("risk_adjusted"), round_half_away(confidence).alias("confidence"))
    return out.withColumn("state", F.when(F.col("confidence") >= 0.8, "ready").when(F.col("confidence") >= 0.6, "ready_with_conditions").otherwise("not_ready"))


def best_option(spark: SparkSession, d: str) -> DataFrame:
    rows = finance.npv(spark, d).join(table(spark, d, "nation"), F.col("case_id") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.max_by("case_id", F.struct("npv", -F.col("case_id"))).alias("case_id"), F.max("npv").alias("npv"))


def top_impacts(spark: SparkSession, d: str) -> DataFrame:
    return finance.tornado(spark, d).orderBy(F.desc(F.abs("impact")), "case_id", "parameter").limit(20).select("case_id", "parameter", "impact")


def series_scale(spark: SparkSession, d: str) -> DataFrame:
    return p.first_differences(forecast.series_monthly(spark, d), "series_id", "period", "value")


def sampled_events(spark: SparkSession, d: str) -> DataFrame:
    """The first ten events of each type."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("place", place).where("place <= 10").select("event_type", "place", "event_id")


def allocation_first_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = scenario.allocation(spark, d).withColumn("fixed", F.lit(100.0))
    return p.first_rows_only(rows, ["c_nationkey", "c_custkey"], ["s_suppkey"], ["fixed"])


def allocation_totals(spark: SparkSession, d: str) -> DataFrame:
    """Served and unmet need of each group."""
    need = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.sum(F.floor("c_acctbal")).cast("double").alias("need"))
    served = scenario.allocation(spark, d).groupBy(F.col("c_nationkey").alias("g")).agg(F.sum("amount").alias("a"))
    out = need.join(served, F.col("c_nationkey") == F.col("g"), "left").select("c_nationkey", "need", F.coalesce("a", F.lit(0.0)).alias("served"))
    return out.withColumn("unmet", F.col("need") - F.col("served")).withColumn("status", F.when(F.col("unmet") > 1e-6, "feasible_with_slack").otherwise("optimal"))


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    short = allocation_totals(spark, d).where("unmet > 0").select("c_nationkey", "unmet")
    return p.numbered(short, ["c_nationkey"], "DIAG-%04d", "diagnostic_id")


def planned_demand(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("factor")) for k, v in UPLIFT.items()]))
    return rows.select("o_orderpriority", "n", each.alias("x")).select("o_orderpriority", "x.kind", round_half_away(F.col("n") * F.col("x.factor")).alias("demand"))


def unit_actions(spark: SparkSession, d: str) -> DataFrame:
    released = scenario.top_release_candidates(spark, d).where("kind = 'hybrid'")
    return p.actions(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), released, "s_suppkey")


def recurring_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of the parents that still have a retained unit, and of all."""
    parents = unit_actions(spark, d).groupBy("s_nationkey").agg(round_half_away(F.sum(F.greatest("s_acctbal", F.lit(0.0))), 2).alias("cost"), F.max(F.when(F.col("action") == "retain", 1).otherwise(0)).alias("kept"))
    return parents.agg(round_half_away(F.sum("cost"), 2).alias("baseline"), round_half_away(F.sum(F.when(F.col("kept") == 1, F.col("cost")).otherwise(0.0)), 2).alias("retained"))


def unit_monthly_cost(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "supplier")
    parents = units.groupBy(F.col("s_nationkey").alias("n")).agg(round_half_away(F.sum(F.greatest("s_acctbal", F.lit(0.0))), 2).alias("cost"), F.count(F.lit(1)).alias("units"))
    return units.join(parents, F.col("s_nationkey") == F.col("n")).select("s_suppkey", round_half_away(F.col("cost") / 12 / F.col("units"), 2).alias("monthly_cost"))


def accuracy_rows(spark: SparkSession, d: str) -> DataFrame:
    return p.unpivot_metrics(forecast.backtest_metrics(spark, d), ["series_id", "model"], METRICS)


def model_eligibility(spark: SparkSession, d: str) -> DataFrame:
    needs = {"naive": 1, "seasonal_naive": 12, "moving_average": 3, "drift": 2, "ses": 3, "holt": 4, "holt_winters": 48}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.lit(v).alias("needs")) for k, v in needs.items()]))
    rows = forecast.series_eligibility(spark, d).select("series_id", "periods", "status", each.alias("m")).select("series_id", "m.model", "m.needs", "periods", "status")
    reason = F.when(F.col("status").isin("insufficient_history", "inactive_series"), F.col("status")).when(F.col("periods") < F.col("needs"), "short_history").when((F.col("status") == "baseline_only") & F.col("model").isin("ses", "holt", "holt_winters"), "baseline_only")
    return rows.select("series_id", "model", F.coalesce(reason, F.lit("eligible")).alias("reason"))


def final_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """The chosen model over the whole series, with its 80 % bounds."""
    chosen = forecast.model_selection(spark, d).select("series_id", "model")
    points = forecast.model_forecasts(spark, d).join(chosen, ["series_id", "model"])
    return p.with_interval(points, forecast.intervals(spark, d), ["series_id", "model"], 0.8)


def assumptions(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, level, float(x)) for k, v in finance.PARAMETERS.items() for level, x in zip(("low", "base", "high"), v)]
    return spark.createDataFrame(rows, "parameter string, level string, value double")


def mitigations(spark: SparkSession, d: str) -> DataFrame:
    """Failures of each priority that call for mitigation."""
    found = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    hit = F.array_intersect(F.coalesce(found[F.col("o_orderpriority")], F.array().cast("array<string>")), F.array(*map(F.lit, TRIGGERS)))
    return rows.select("o_orderpriority", F.concat_ws(",", F.sort_array(hit)).alias("failures"), (F.size(hit) * 100.0).alias("cost"))


def display_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", p.percent(F.col("s_suppkey") / 1000).alias("share"), p.title_case(F.concat(F.lit("READY_with_"), F.col("s_name"))).alias("label"))


def forbidden_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source with a secret's shape or a guarantee."""
    t = F.col("text")
    secret, promise = t.rlike("(?i)(api[_-]?key|secret|token)[\"']?\\s*[:=]"), t.rlike("(?i)guarantee")
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.when(secret, 1).otherwise(0)).alias("secrets"), F.sum(F.when(promise, 1).otherwise(0)).alias("promises"))


def site_access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), round_half_away(F.avg(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("mean"), F.max("c_acctbal").alias("top"), p.share_true(F.col("c_acctbal") > 5000).alias("share"))


def balance_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Available against planned by segment and nation."""
    rows = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum(F.floor("c_acctbal")).alias("available"), (F.count(F.lit(1)) * 5000).alias("planned"))
    return rows.withColumn("ratio", round_half_away(safe_ratio(F.col("available"), F.col("planned"))))


def run_identifier(spark: SparkSession, d: str) -> DataFrame:
    """A content id of the inputs' counts: the same inputs give the same run."""
    census = quality.table_census(spark, d)
    parts = F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws("=", "table_name", F.col("n_rows").cast("string")))))
    return census.agg(parts.alias("inputs")).select("inputs", key_digest("RUN-", 16, F.lit("v1"), F.col("inputs")).alias("run_id"))


QUERIES = {
    f.__name__: f
    for f in (
        classified_orders, curated_orders, review_queue, linkage, linkage_summary, match_bands, feasibility, readiness, best_option, top_impacts, series_scale, sampled_events, allocation_first_rows, allocation_totals,
        diagnostics, planned_demand, unit_actions, recurring_cost, unit_monthly_cost, accuracy_rows, model_eligibility, final_forecasts, assumptions, mitigations, display_forms, forbidden_phrases, site_access, balance_ratio, run_identifier,
    )
}

_F, _S, _V = forecast.ORACLE_SQL, scenario.ORACLE_SQL, finance.ORACLE_SQL
_CLASS = """SELECT o_orderkey, CASE WHEN o_totalprice < 0 OR o_custkey IS NULL THEN 'rejected' WHEN o_totalprice < 20000 OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') THEN 'accepted_with_warning' ELSE 'accepted' END AS record_status,
  CASE WHEN o_totalprice < 0 THEN 'price_negative' WHEN o_custkey IS NULL THEN 'customer_missing' WHEN o_totalprice < 20000 THEN 'price_small' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'urgent_open' END AS warning_reason FROM orders"""
_LINKS = "SELECT c_custkey::VARCHAR AS entity_id, 'exact_identifier' AS method, 1.0::DOUBLE AS score, CASE WHEN c_acctbal < 0 THEN 'matched_with_warning' ELSE 'matched' END AS status FROM customer"
_TOTALS = f"""SELECT *, CASE WHEN unmet > 1e-6 THEN 'feasible_with_slack' ELSE 'optimal' END AS status FROM (SELECT n.c_nationkey, need, coalesce(a, 0.0) AS served, need - coalesce(a, 0.0) AS unmet FROM (SELECT c_nationkey, sum(floor(c_acctbal))::DOUBLE AS need FROM customer WHERE c_acctbal > 0 GROUP BY 1) n
  LEFT JOIN (SELECT c_nationkey, sum(amount) AS a FROM ({_S['allocation']}) GROUP BY 1) s ON n.c_nationkey = s.c_nationkey)"""
_PARENT = f"SELECT s_nationkey AS n, {r('sum(greatest(s_acctbal, 0.0))', 2)} AS cost, count(*) AS units FROM supplier GROUP BY 1"
_ACTIONS = f"SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM ({_S['top_release_candidates']}) WHERE kind = 'hybrid') THEN 'deactivate_candidate' ELSE 'retain' END AS action FROM supplier"
_NEEDS = "(VALUES ('naive', 1), ('seasonal_naive', 12), ('moving_average', 3), ('drift', 2), ('ses', 3), ('holt', 4), ('holt_winters', 48)) m(model, needs)"
_LEVELS = ", ".join(f"('{k}', '{level}', {float(x)}::DOUBLE)" for k, v in finance.PARAMETERS.items() for level, x in zip(("low", "base", "high"), v))
_CAP = "(CASE WHEN payback_year IS NULL THEN 0.5::DOUBLE WHEN discounted_payback_year IS NULL THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END)"
_CONFIDENCE = r("greatest(0.0::DOUBLE, 0.82::DOUBLE - CASE WHEN payback_year IS NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN net_1y < -5000 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)")
ORACLE_SQL = {
    "classified_orders": _CLASS,
    "curated_orders": f"SELECT record_status, warning_reason, count(*) AS n FROM ({_CLASS}) WHERE record_status LIKE 'accepted%' GROUP BY 1, 2",
    "review_queue": f"SELECT 'REV-' || substr(sha256(rule || '|' || record_id), 1, 16) AS queue_id, record_id, rule FROM ({quality.ORACLE_SQL['dq_issues']}) WHERE severity = 'medium'",
    "linkage": _LINKS,
    "linkage_summary": f"SELECT method, status, count(*) AS links FROM ({_LINKS}) GROUP BY 1, 2",
    "match_bands": f"SELECT *, CASE WHEN score >= 0.85 THEN 'matched' WHEN score >= 0.7 THEN 'manual_review' ELSE 'unmatched' END AS band FROM (SELECT c_custkey, {r('(c_acctbal / 10000.0::DOUBLE)')} AS score FROM customer)",
    "feasibility": """SELECT nation, 3::BIGINT AS checks, CASE WHEN n < 2 OR debt > 9 THEN 'infeasible' WHEN n < 8 OR debt > 6 OR low < -900 THEN 'feasible_with_warnings' ELSE 'feasible' END AS feasibility
      FROM (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS debt, min(c_acctbal) AS low FROM customer GROUP BY 1)""",
    "readiness": f"SELECT *, CASE WHEN confidence >= 0.8 THEN 'ready' WHEN confidence >= 0.6 THEN 'ready_with_conditions' ELSE 'not_ready' END AS state FROM (SELECT case_id, npv, {_CAP} AS cap, {r(f'(npv * {_CAP})', 2)} AS risk_adjusted, {_CONFIDENCE} AS confidence FROM ({_V['npv']}))",
    "best_option": f"SELECT n_regionkey AS region, case_id, npv FROM ({_V['npv']}) JOIN nation ON case_id = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY npv DESC, case_id) = 1",
    "top_impacts": f"SELECT case_id, parameter, impact FROM ({_V['tornado']}) ORDER BY abs(impact) DESC, case_id, parameter LIMIT 20",
    "series_scale": f"SELECT series_id, {r('avg(d)')} AS scale FROM (SELECT series_id, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY period)) AS d FROM ({_F['series_monthly']})) GROUP BY 1",
    "sampled_events": "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INTEGER AS place, event_id FROM events QUALIFY place <= 10",
    "allocation_first_rows": f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_custkey ORDER BY s_suppkey) = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS fixed FROM ({_S['allocation']})",
    "allocation_totals": _TOTALS,
    "diagnostics": f"SELECT c_nationkey, unmet, format('DIAG-{{:04d}}', row_number() OVER (ORDER BY c_nationkey)) AS diagnostic_id FROM ({_TOTALS}) WHERE unmet > 0",
    "planned_demand": f"SELECT o_orderpriority, kind, {r('(n * factor)')} AS demand FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (VALUES ('hybrid', 0.93::DOUBLE), ('light', 1.0::DOUBLE), ('site', 1.03::DOUBLE)) u(kind, factor)",
    "unit_actions": _ACTIONS,
    "recurring_cost": f"SELECT {r('sum(cost)', 2)} AS baseline, {r('sum(CASE WHEN kept THEN cost ELSE 0.0 END)', 2)} AS retained FROM (SELECT s_nationkey, {r('sum(greatest(s_acctbal, 0.0))', 2)} AS cost, bool_or(action = 'retain') AS kept FROM ({_ACTIONS}) GROUP BY 1)",
    "unit_monthly_cost": f"SELECT s_suppkey, {r('(cost / 12 / units)', 2)} AS monthly_cost FROM supplier JOIN ({_PARENT}) ON s_nationkey = n",
    "accuracy_rows": " UNION ALL ".join(f"SELECT series_id, model, '{m}' AS metric, {m}::DOUBLE AS value, CASE WHEN {m} IS NULL THEN 'not_applicable' ELSE 'defined' END AS state FROM ({_F['backtest_metrics']})" for m in METRICS),
    "model_eligibility": f"SELECT series_id, model, CASE WHEN status IN ('insufficient_history', 'inactive_series') THEN status WHEN periods < needs THEN 'short_history' WHEN status = 'baseline_only' AND model IN ('ses', 'holt', 'holt_winters') THEN 'baseline_only' ELSE 'eligible' END AS reason FROM ({_F['series_eligibility']}), {_NEEDS}",
    "final_forecasts": f"SELECT f.series_id, f.model, h, forecast, {r('greatest(0.0, forecast - coalesce(width, 0.0))')} AS lower, {r('(forecast + coalesce(width, 0.0))')} AS upper FROM ({_F['model_forecasts']}) f JOIN ({_F['model_selection']}) c ON f.series_id = c.series_id AND f.model = c.model LEFT JOIN ({_F['intervals']}) w ON w.series_id = f.series_id AND w.model = f.model AND level = 0.8::DOUBLE",
    "assumptions": f"SELECT * FROM (VALUES {_LEVELS}) a(parameter, level, value)",
    "mitigations": "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'late' WHEN '5-LOW' THEN 'cost' ELSE '' END AS failures, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM (SELECT DISTINCT o_orderpriority FROM orders)",
    "display_forms": f"SELECT s_suppkey, format('{{:.1f}}%', {r('(s_suppkey / 1000.0::DOUBLE * 100)', 1)}) AS share, array_to_string(list_transform(string_split(lower('READY with ' || s_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM supplier",
    "forbidden_phrases": """SELECT source, (count(*) FILTER (WHERE regexp_matches(text, '(?i)(api[_-]?key|secret|token)["'']?\\s*[:=]')))::BIGINT AS secrets, (count(*) FILTER (WHERE regexp_matches(text, '(?i)guarantee')))::BIGINT AS promises FROM documents GROUP BY 1""",
    "site_access": f"SELECT c_nationkey, count(*) AS n, {r('(round(sum(c_acctbal::DECIMAL(18,2))::DECIMAL(30,6) / count(*), 6)::DOUBLE)', 2)} AS mean, max(c_acctbal) AS top, {r('(count(*) FILTER (WHERE c_acctbal > 5000) / count(*))')} AS share FROM customer GROUP BY 1",
    "balance_ratio": f"SELECT *, {r('(available / planned)')} AS ratio FROM (SELECT c_mktsegment, c_nationkey, sum(floor(c_acctbal))::BIGINT AS available, count(*) * 5000 AS planned FROM customer GROUP BY 1, 2)",
    "run_identifier": f"SELECT inputs, 'RUN-' || substr(sha256('v1|' || inputs), 1, 16) AS run_id FROM (SELECT string_agg(table_name || '=' || n_rows, ';' ORDER BY table_name || '=' || n_rows) AS inputs FROM ({quality.ORACLE_SQL['table_census']}))",
}
