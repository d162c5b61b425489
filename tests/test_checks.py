"""Strict casts, ordinals, references and verdicts on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.scalar import ordinal, strict_cast
from millrace.operators import quality as q


def test_strict_cast_keeps_null_and_stops_at_a_bad_value(spark):
    rows = spark.createDataFrame([("7",), (None,)], "x string")
    assert [r[0] for r in rows.select(strict_cast(F.col("x"), "int")).collect()] == [7, None]
    bad = spark.createDataFrame([("7",), ("seven",)], "x string")
    with pytest.raises(Exception, match="not a int: seven"):
        bad.select(strict_cast(F.col("x"), "int")).collect()


def test_ordinal(spark):
    rows = spark.createDataFrame([("b",), ("z",), (None,)], "x string")
    assert [r[0] for r in rows.select(ordinal(F.col("x"), ["a", "b"])).collect()] == [2, None, None]


def test_references_with_null_keys_repeated_parents_and_no_rows(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert tuple(q.reference_counts("c", child, parent, "k", "k").first()) == ("c", 4, 1, 1)
    assert tuple(q.reference_counts("c", child.limit(0), parent, "k", "k").first()) == ("c", 0, 0, 0)


def test_an_unknown_outcome_neither_passes_nor_fails(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", None)], "g string, bad boolean")
    got = {r.g: (r.checks, r.all_pass, r.any_fail) for r in q.verdicts(rows, ["g"], F.col("bad")).collect()}
    assert got == {"a": (2, False, True), "b": (1, True, False), "c": (1, False, False)}
