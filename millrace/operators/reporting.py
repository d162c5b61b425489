"""Classification, linkage, readiness, stable ids, actions, costs by parts and display forms for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import key_digest, round_half_away, safe_ratio
from .prefix import numbered_rows


def classify(frame: DataFrame, rejects: list[tuple[str, Column]], warns: list[tuple[str, Column]]) -> DataFrame:
    """``record_status`` and ``warning_reason``: the first rule that holds, rejections first, else accepted."""
    status, reason = F.lit("accepted"), F.lit(None).cast("string")
    for rules, label in ((warns, "accepted_with_warning"), (rejects, "rejected")):
        for name, holds in reversed(rules):
            status, reason = F.when(holds, label).otherwise(status), F.when(holds, name).otherwise(reason)
    return frame.withColumns({"record_status": status, "warning_reason": reason})


def curated(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("record_status").like("accepted%"))


def review_queue(issues: DataFrame, severities: list[str]) -> DataFrame:
    """Issues that people must see, each with a stable id."""
    return issues.where(F.col("severity").isin(*severities)).withColumn("queue_id", key_digest("REV-", 16, F.col("rule"), F.col("record_id")))


def self_links(frame: DataFrame, key: Column, warned: Column) -> DataFrame:
    """Every entity linked to itself by its identifier; those with a warning keep a mark."""
    return frame.select(key.cast("string").alias("entity_id"), F.lit("exact_identifier").alias("method"), F.lit(1.0).alias("score"), F.when(warned, "matched_with_warning").otherwise("matched").alias("status"))


def match_band(score: Column) -> Column:
    return F.when(score >= 0.85, "matched").when(score >= 0.7, "manual_review").otherwise("unmatched")


def feasibility(rows: DataFrame, by: list[str]) -> DataFrame:
    """Any critical failure is infeasible, any other failure or warning leaves a warning."""
    bad = F.max(F.when((F.col("status") == "fail") & F.col("critical"), 2).when(F.col("status") != "pass", 1).otherwise(0))
    return rows.groupBy(*by).agg(bad.alias("_b"), F.count(F.lit(1)).alias("checks")).select(*by, "checks", F.when(F.col("_b") == 2, "infeasible").when(F.col("_b") == 1, "feasible_with_warnings").otherwise("feasible").alias("feasibility"))


def numbered(frame: DataFrame, order: list[str], pattern: str, name: str) -> DataFrame:
    """Stable ids by place in the whole table, numbered in two levels."""
    return numbered_rows(frame, [], order, name).withColumn(name, F.format_string(pattern, F.col(name)))


def first_rows_only(frame: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Amounts of the group on its first row, zero on the others."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    marked = frame.withColumn("_first", first)
    return marked.withColumns({c: F.when(F.col("_first"), F.col(c)).otherwise(0.0) for c in columns}).drop("_first")


def actions(units: DataFrame, released: DataFrame, key: str) -> DataFrame:
    """retain, or deactivate_candidate where the unit was chosen for release."""
    chosen = released.select(F.col(key).alias("_r")).distinct()
    return units.join(chosen, units[key] == F.col("_r"), "left").withColumn("action", F.when(F.col("_r").isNotNull(), "deactivate_candidate").otherwise("retain")).drop("_r")


def unpivot_metrics(frame: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """A row for each metric; a null one is not applicable."""
    long = frame.unpivot([*map(F.col, ids)], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.withColumn("state", F.when(F.col("value").isNull(), "not_applicable").otherwise("defined"))


def first_differences(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean absolute first difference of each series, the scale of MASE; null for a single value."""
    w = Window.partitionBy(by).orderBy(order)
    steps = series.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    return steps.groupBy(by).agg(round_half_away(F.avg("_d")).alias("scale"))


def with_interval(points: DataFrame, widths: DataFrame, on: list[str], level: float) -> DataFrame:
    """Bounds of one level next to each point; without a width, both are the point itself."""
    own = widths.where(F.col("level") == level).select(*on, "width")
    joined = points.join(own, on, "left")
    return joined.withColumns({"lower": round_half_away(F.greatest(F.lit(0.0), F.col("forecast") - F.coalesce("width", F.lit(0.0)))), "upper": round_half_away(F.col("forecast") + F.coalesce("width", F.lit(0.0)))}).drop("width")


def share_true(condition: Column) -> Column:
    return round_half_away(safe_ratio(F.sum(F.when(condition, 1).otherwise(0)), F.count(F.lit(1))))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", round_half_away(x * 100, 1))


def title_case(x: Column) -> Column:
    return F.initcap(F.lower(F.replace(x, F.lit("_"), F.lit(" "))))
