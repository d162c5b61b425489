"""The rule catalogue, references in one pass, limits by direction."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.scalar import direction_holds
from millrace.operators.quality import duplicate_members
from millrace.operators.rules import Entry, Reference, catalogue, orphan_keys, reference_keys, reference_totals, run_rules


def test_rules_run_by_id(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, " ", None), (3, "c", 50.0), (None, "d", 7.0)], "k int, name string, x double")
    known = catalogue([Entry("R1", "t", "d", "high", "required", ("k",)), Entry("R2", "t", "d", "low", "filled", ("name",)), Entry("R3", "t", "d", "low", "range", ("x", 0, 10)), Entry("R4", "t", "d", "low", "domain", ("name", "a", "it's")), Entry("R5", "t", "d", "low", "conditional", ("k > 1", "x > 100")), Entry("R6", "t", "d", "low", "order", ("k", "x"))])
    got = {r.rule: (r.failed, r.status) for r in run_rules(known, lambda _: rows).collect()}
    assert got == {"R1": (1, "fail"), "R2": (1, "fail"), "R3": (1, "fail"), "R4": (3, "fail"), "R5": (1, "fail"), "R6": (0, "pass")}
    assert [r.rule for r in run_rules(known, lambda _: rows, ["R3"]).collect()] == ["R3"]
    with pytest.raises(ValueError, match="R9"):
        run_rules(known, lambda _: rows, ["R1", "R9"])
    with pytest.raises(ValueError):
        catalogue([known["R1"], known["R1"]])
    with pytest.raises(ValueError, match="no known kind"):
        Entry("R7", "t", "d", "low", "other", ()).broken


def test_references_in_one_pass(spark):
    tables = {"c": spark.createDataFrame([(1, "x"), (1, "y"), (7, "x"), (None, "z")], "a int, b string"), "p": spark.createDataFrame([(1,), (1,), (2,)], "a int"), "q": spark.createDataFrame([("x",)], "b string"), "e": spark.createDataFrame([], "a int")}
    specs = [Reference("c", "a", "p", "a"), Reference("c", "b", "q", "b"), Reference("e", "a", "p", "a")]
    keys = reference_keys(tables.__getitem__, specs)
    assert {tuple(r) for r in reference_totals(keys, specs).collect()} == {("c.a", 4, 1, 1), ("c.b", 4, 2, 0), ("e.a", 0, 0, 0)}
    assert {tuple(r) for r in orphan_keys(keys).collect()} == {("c.a", "7", 1), ("c.b", "y", 1), ("c.b", "z", 1)}


def test_limits_by_direction(spark):
    rows = spark.createDataFrame([("minimum_x", 5.0, 5.0), ("minimum_x", 4.9, 5.0), ("maximum_x", 5.0, 5.0), ("other", 5.1, 5.0), ("minimum_x", None, 5.0)], "name string, v double, l double")
    assert [r.h for r in rows.select(direction_holds(F.col("name"), F.col("v"), F.col("l")).alias("h")).collect()] == [True, False, True, False, None]


def test_helper_columns_never_clash(spark):
    rows = spark.createDataFrame([("a", 1, 9), ("a", 2, 8), ("b", 3, 7)], "key_0 string, key_1 int, _k0 int")
    got = duplicate_members(rows, [F.col("key_0")], F.col("key_1")).collect()
    assert sorted((r.key_0, r.key_1, r["_k0"], r.place) for r in got) == [("a", 1, 9, 1), ("a", 2, 8, 2)]
