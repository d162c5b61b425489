"""Checks over other results: a catalogue by id, each evaluated by its category, and the verdict over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``category`` names the measure; it passes between ``least`` and ``most``.  A cautious check never does better than ``pass_with_warnings``."""

    check_id: str
    category: str
    severity: str = "major"
    least: float | None = None
    most: float | None = None
    cautious: bool = False


def catalogue(checks: Iterable[Check]) -> dict[str, Check]:
    """Checks by id; two of one id are an error."""
    out: dict[str, Check] = {}
    for c in checks:
        if c.check_id in out:
            raise ValueError(f"two checks have the id {c.check_id}")
        out[c.check_id] = c
    return out


def run_checks(spark: SparkSession, known: Mapping[str, Check], measures: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """check_id, category, severity, status, observed: a row for each check.

    ``measures`` give one row with the number ``observed`` for a category;
    each is computed once, however many checks look at it.  A category without
    a measure fails and says so by a null ``observed``; so does a measure that
    is null.
    """
    limit = lambda x: None if x is None else float(x)
    rows = [(c.check_id, c.category, c.severity, limit(c.least), limit(c.most), c.cautious) for c in known.values()]
    checks = spark.createDataFrame(rows, "check_id string, category string, severity string, least double, most double, cautious boolean")
    used = [k for k in dict.fromkeys(c.category for c in known.values()) if k in measures]
    none = spark.createDataFrame([], "measured string, observed double")
    seen = reduce(DataFrame.unionByName, [measures[k]().select(F.lit(k).alias("measured"), F.col("observed").cast("double").alias("observed")) for k in used], none)
    x = F.col("observed")
    holds = x.isNotNull() & F.coalesce(x >= F.col("least"), F.lit(True)) & F.coalesce(x <= F.col("most"), F.lit(True))
    status = F.when(~holds, "fail").when(F.col("cautious"), "pass_with_warnings").otherwise("pass")
    return checks.join(seen, F.col("category") == F.col("measured"), "left").select("check_id", "category", "severity", status.alias("status"), "observed")


def verdict(results: DataFrame) -> DataFrame:
    """One row: checks, passed, warned, failed, and readiness.  A failed critical check blocks, any other failure wants review."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    failed = F.col("status") == "fail"
    out = results.agg(
        F.count(F.lit(1)).alias("checks"), n(F.col("status") == "pass").alias("passed"), n(F.col("status") == "pass_with_warnings").alias("warned"), n(failed).alias("failed"), n(failed & (F.col("severity") == "critical")).alias("blocking")
    )
    state = F.when(F.col("blocking") > 0, "blocked").when(F.col("failed") > 0, "review_required").when(F.col("warned") > 0, "ready_with_warnings").otherwise("ready")
    return out.withColumn("readiness", state)
