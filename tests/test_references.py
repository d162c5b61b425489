"""References on odd keys, and how many tasks share the keys."""

import datetime

from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.operators.rules import Reference, orphan_keys, reference_keys, reference_totals
from millrace.plans import assurance


def test_keys_are_shared_by_many_tasks_and_joined_with_nothing(spark):
    child = spark.range(5000).select((F.col("id") % 700).alias("k"))
    keys = reference_keys({"c": child, "p": spark.range(600).select(F.col("id").alias("k"))}.__getitem__, [Reference("c", "k", "p", "k")])
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {rules.PARTS}), REPARTITION_BY_NUM") == 2 and "Join" not in plan and "Sort" not in plan, plan
    assert (keys.count(), orphan_keys(keys).count()) == (700, 100)


def test_odd_keys(spark):
    day = datetime.date(2020, 1, 1)
    tables = {
        "c": spark.createDataFrame([(1, 1, "1", day, 5)] * 400 + [(2, 2, "x", None, 1), (-1, 3, " 1", day, None), (None, None, None, None, 9)], "a int, b long, s string, d date, up int").repartition(7),
        "p": spark.createDataFrame([(1, "1", day), (1, "1", day), (None, None, None), (3, "2", None)], "a long, s string, d date"),
        "none": spark.createDataFrame([], "a long"),
    }
    specs = [Reference("c", "a", "p", "a"), Reference("c", "b", "p", "s"), Reference("c", "s", "p", "a"), Reference("c", "d", "p", "d"), Reference("c", "up", "c", "a"), Reference("c", "b", "none", "a"), Reference("none", "a", "c", "a")]
    keys = reference_keys(tables.__getitem__, specs[:5])
    assert dict(keys.dtypes) == {"spec": "string", "key": "string", "n": "bigint", "known": "boolean"}
    assert {tuple(r) for r in reference_totals(keys, specs[:5]).collect()} == {("c.a", 403, 2, 1), ("c.b", 403, 1, 1), ("c.s", 403, 2, 1), ("c.d", 403, 0, 2), ("c.up", 403, 401, 1)}
    assert {tuple(r) for r in orphan_keys(keys).collect()} == {("c.a", "2", 1), ("c.a", "-1", 1), ("c.b", "3", 1), ("c.s", "x", 1), ("c.s", " 1", 1), ("c.up", "5", 400), ("c.up", "9", 1)}
    assert {tuple(r) for r in reference_totals(reference_keys(tables.__getitem__, specs[5:]), specs[5:]).collect()} == {("c.b", 403, 402, 1), ("none.a", 0, 0, 0)}


def test_assurance_counts_keys_in_shares(spark, sf_dir):
    plan = assurance.assurance_results(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {rules.PARTS}), REPARTITION_BY_NUM") == 2


def test_verdict_counts_keys_in_shares(spark, sf_dir):
    plan = assurance.assurance_verdict(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {rules.PARTS}), REPARTITION_BY_NUM") == 2
