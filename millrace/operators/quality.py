"""Data-quality rules, duplicates, orphans, populations, scores and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.scalar import band, key_digest, round_half_away, safe_ratio

#: Floors of the score bands.
SCORE_BANDS = [(95.0, "pass"), (85.0, "pass_with_warnings"), (70.0, "manual_review_required")]
#: Severity of gate states, mildest first.
GATE_ORDER = ["pass", "pass_with_warnings", "manual_review_required", "fail"]


@dataclass(frozen=True)
class Rule:
    """A predicate that holds for rows that break the rule."""

    name: str
    dataset: str
    dimension: str
    severity: str
    broken: Column


def check_rows(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    """A result row for each rule over one dataset; all rules of a dataset are one pass."""
    sums = frame.agg(F.count(F.lit(1)).alias("checked"), *[F.coalesce(F.sum(F.when(r.broken, 1).otherwise(0)), F.lit(0)).alias(r.name) for r in rules])
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.dataset).alias("dataset"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.col(r.name).cast("long").alias("failed")) for r in rules]))
    rows = sums.select("checked", each.alias("r")).select("r.rule", "r.dataset", "r.dimension", "r.severity", "checked", "r.failed")
    return rows.withColumn("status", F.when(F.col("failed") == 0, "pass").otherwise("fail"))


def issue_rows(frame: DataFrame, key: Column, rules: list[Rule]) -> DataFrame:
    """A row for each record and rule it breaks, with a stable evidence key."""
    broken = F.filter(F.array(*[F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.dataset).alias("dataset"), F.lit(r.severity).alias("severity"))) for r in rules]), lambda x: x.isNotNull())
    rows = frame.select(key.cast("string").alias("record_id"), F.explode(broken).alias("r")).select("record_id", "r.rule", "r.dataset", "r.severity")
    return rows.withColumn("evidence_key", key_digest("", 24, F.col("dataset"), F.col("rule"), F.col("record_id")))


def duplicate_members(frame: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """Every row of a group of two or more, with its place; null keys are no group."""
    named, cols = frame, []
    for k, c in enumerate(keys):
        cols.append(free_name(f"key_{k}", named))
        named = named.withColumn(cols[-1], c)
    for c in cols:
        named = named.where(F.col(c).isNotNull())
    w = Window.partitionBy(*cols)
    return named.withColumn("group_size", F.count(F.lit(1)).over(w)).where("group_size > 1").withColumn("place", F.row_number().over(w.orderBy(order))).drop(*cols)


def duplicate_groups(frame: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """Groups of two or more: size, stable id, and how the members are named in order."""
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_set(member.cast("long"))), lambda x: x.cast("string")))
    out = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), ids.alias("record_identifiers")).where("members > 1")
    return out.withColumn("group_id", key_digest("DUP-", 12, *[F.col(k).cast("string") for k in keys]))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def linked(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent, child[child_key] == parent[parent_key], "left_semi")


def scores(results: DataFrame) -> DataFrame:
    """Pass share by dataset and dimension, by dataset, and their mean, each with its band."""
    passed = F.avg(F.when(F.col("status") == "pass", 100.0).otherwise(0.0))
    fine = results.groupBy("dataset", "dimension").agg(round_half_away(passed, 2).alias("score"))
    coarse = results.groupBy("dataset").agg(round_half_away(passed, 2).alias("score"))
    total = coarse.agg(round_half_away(F.avg("score"), 2).alias("score"))
    every = fine.unionByName(coarse.withColumn("dimension", F.lit("all"))).unionByName(total.withColumns({"dataset": F.lit("all"), "dimension": F.lit("all")}))
    return every.withColumn("status", band(F.col("score"), SCORE_BANDS, "fail"))


def population(frame: DataFrame, key: str, issues: DataFrame, policy: dict[str, str], allowed: Column) -> DataFrame:
    """Rows that count, and why others do not: issues by severity first, then the status."""
    excluded = F.lit(False)
    for severity, action in policy.items():
        excluded = F.when(F.col("severity") == severity, F.lit(action == "exclude")).otherwise(excluded)
    bad = issues.where(excluded).select(F.col("record_id").alias("_bad")).distinct()
    joined = frame.join(bad, frame[key].cast("string") == bad["_bad"], "left")
    reason = F.when(F.col("_bad").isNotNull(), "quality_issue").when(~allowed, "status_not_allowed")
    return joined.withColumn("reason", reason).withColumn("included", F.col("reason").isNull()).drop("_bad")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children of excluded parents, with the reason."""
    return children.join(parents.where(~F.col("included")).select(F.col(parent_key).alias("_p")), children[child_key] == F.col("_p"), "left_semi").withColumn("reason", F.lit("parent_excluded"))


def reconcile(layers: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Counts of each dataset by layer; they pass where all agree.  One aggregation of a tagged union."""
    out, names = None, []
    for dataset, by in layers.items():
        names = list(by)
        for layer, frame in by.items():
            part = frame.select(F.lit(dataset).alias("dataset"), F.lit(layer).alias("layer"))
            out = part if out is None else out.unionByName(part)
    counts = out.groupBy("dataset").agg(*[F.sum(F.when(F.col("layer") == x, 1).otherwise(0)).alias(x) for x in names])
    same = F.lit(True)
    for x in names[1:]:
        same &= F.col(x) == F.col(names[0])
    return counts.withColumn("status", F.when(same, "pass").otherwise("warning"))


def worst(frame: DataFrame, by: list[str], status: str) -> DataFrame:
    """The most severe state of each group."""
    place = F.array_position(F.array(*map(F.lit, GATE_ORDER)), F.col(status))
    return frame.groupBy(*by).agg(F.max(place).alias("_p"), F.count(F.lit(1)).alias("checks")).withColumn("gate", F.element_at(F.array(*map(F.lit, GATE_ORDER)), F.col("_p").cast("int"))).drop("_p")


def share(top: Column, bottom: Column) -> Column:
    return round_half_away(100 * safe_ratio(top, bottom), 2)


def reference_counts(name: str, child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: how many rows of ``child`` there are, how many refer to nothing in ``parent``, and how many have no key.

    Rows are counted by key before they meet the parents, so a key with very
    many rows moves as one.  No rows count as 0.
    """
    keys = child.groupBy(F.col(child_key).alias("child_key")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("parent_key")).distinct()
    joined = keys.join(known, F.col("child_key") == F.col("parent_key"), "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    lost = F.when(F.col("parent_key").isNull() & F.col("child_key").isNotNull(), F.col("n"))
    return joined.agg(total(F.col("n")).alias("n_rows"), total(lost).alias("orphans"), total(F.when(F.col("child_key").isNull(), F.col("n"))).alias("unset")).select(F.lit(name).alias("spec"), "n_rows", "orphans", "unset")


def verdicts(results: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """Whether all rows of a group pass and whether any fails; an unknown outcome is neither."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("checks"), F.min(F.coalesce(~failed, F.lit(False))).alias("all_pass"), F.max(F.coalesce(failed, F.lit(False))).alias("any_fail"))
