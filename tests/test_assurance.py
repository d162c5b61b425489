"""Wording rules, forms of values, components of cost, and checks over results, on small tables with awkward rows."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import display
from millrace.operators.assurance import Check, catalogue, run_checks, verdict
from millrace.operators.costs import recurring_components
from millrace.operators.wording import Mark, Phrase, controlled, forbidden_phrases, unfinished

TEXTS = [(1, "Guaranteed savings and GUARANTEED SAVINGS."), (2, "There are no guaranteed savings."), (3, "board approvedboard approved"), (4, None), (5, ""), (5, "must implement " * 20_000), (6, "a todo; nodo TODOS"), (7, "see /home/x/y lorem  ipsum")]


def test_phrases_with_contexts(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("occurrences", F.lit(1)).withColumn("phrase", F.lit("x"))
    got = forbidden_phrases(rows.select("doc_id", "text"), ["doc_id"], "text", [Phrase("guaranteed savings", ("no guaranteed savings",)), Phrase("Board approved"), Phrase("must implement")])
    assert sorted(map(tuple, got.collect())) == [(1, "guaranteed savings", 2), (3, "Board approved", 2), (5, "must implement", 20_000)]
    # columns of the same names beside the text do no harm
    assert forbidden_phrases(rows, ["doc_id"], "text", [Phrase("must implement")]).count() == 1


def test_controlled_wording(spark):
    rows = spark.createDataFrame([("saving, Saving, SAVING",), ("Guaranteed Saving!",), (None,), ("all said. The end.",)], "t string")
    got = [r[0] for r in rows.select(controlled(F.col("t"), {"guaranteed saving": "saving", "saving": "difference"}, "The end.")).collect()]
    assert got == ["difference, difference, SAVING The end.", "difference! The end.", None, "all said. The end."]


def test_unfinished_texts(spark):
    marks = [Mark("word", "TODO"), Mark("term", "lorem ipsum"), Mark("term", "LOREM"), Mark("pattern", "/home/"), Mark("pattern", "/HOME/")]
    got = unfinished(spark.createDataFrame(TEXTS, "doc_id long, text string"), ["doc_id"], "text", marks)
    assert sorted(map(tuple, got.collect())) == [(6, "word", "TODO"), (7, "pattern", "/home/"), (7, "term", "LOREM")]
    with pytest.raises(ValueError):
        Mark("odd", "x").pattern  # noqa: B018


def test_canonical_values(spark):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame(
        [(True, when.date(), when, 2.50, Decimal("1.005"), 7, "a"), (None,) * 7, (False, when.date(), when, 100.0, Decimal("3"), -1, ""), (False, when.date(), when, 0.12345, Decimal("3"), -1, "")],
        "b boolean, d date, t timestamp, x double, m decimal(10,3), n long, s string",
    )
    got = [tuple(r) for r in rows.select(*[display.canonical_value(rows, c).alias(c) for c in rows.columns]).collect()]
    assert got[0] == ("true", "2024-01-02", "2024-01-02T03:04:05", "2.5", "1.01", "7", "a")
    assert got[1] == ("",) * 7
    assert got[2][3] == "100" and got[2][4] == "3.00" and got[3][3] == "0.1235"


def test_shown_values(spark):
    rows = spark.createDataFrame([(1234567.5, "not_ready"), (None, None), (float("nan"), ""), (-0.25, "optimal")], "x double, s string")
    x = F.col("x")
    got = rows.select(display.currency(x), display.number(x), display.integer(x), display.status_label(F.col("s"), {"optimal": "Best"})).collect()
    assert [tuple(r) for r in got] == [("GBP 1,234,568", "1,234,567.5", "1,234,567", "Not Ready"), ("n/a", "n/a", "n/a", "Insufficient Evidence"), ("n/a", "n/a", "n/a", "Insufficient Evidence"), ("GBP -0", "-0.3", "0", "Best")]


def test_display_names(spark):
    rows = spark.createDataFrame([(1, "Hall"), (2, None)], "id long, Room_Name string")
    name = lambda *preferred: [r[0] for r in rows.select(display.display_name(rows, preferred)).collect()]
    assert name("building_name", "room_name") == ["Hall", ""] and name("building_name") == ["1", "2"]


def test_recurring_components(spark):
    classes = {"energy": "semi_variable", "rates": "fixed", "clean": "variable", "none": "fixed"}
    schema = "released boolean, energy double, rates double, clean double, none double"
    rows = [(True, 10.0, 5.0, None, None), (False, 1.0, 2.0, 3.0, None), (None, 1.0, 1.0, 1.0, None)]
    got = {r.component: tuple(r)[1:] for r in recurring_components(spark.createDataFrame(rows, schema), "released", classes).collect()}
    assert got == {"energy": ("semi_variable", 12.0, 2.0, 10.0, "removed_with_floor"), "rates": ("fixed", 8.0, 3.0, 5.0, "removed"), "clean": ("variable", 4.0, 4.0, 0.0, "retained"), "none": ("fixed", 0.0, 0.0, 0.0, "retained")}
    kept = {r.component: r.treatment for r in recurring_components(spark.createDataFrame(rows[1:], schema), "released", classes).collect()}
    assert kept == {"energy": "retained", "rates": "retained", "clean": "kept_without_release", "none": "retained"}
    assert [r.baseline for r in recurring_components(spark.createDataFrame([], schema), "released", classes).collect()] == [0.0] * 4


def test_checks_by_category(spark):
    one = lambda x: lambda: spark.createDataFrame([(x,)], "observed double")
    known = catalogue([Check("A", "rows", "critical", least=1), Check("B", "rows", most=4), Check("C", "none", most=1), Check("D", "unknown", "critical"), Check("E", "share", cautious=True)])
    results = run_checks(spark, known, {"rows": one(5.0), "none": one(None), "share": one(0.5), "unused": one(1.0)})
    assert {r.check_id: (r.status, r.observed) for r in results.collect()} == {"A": ("pass", 5.0), "B": ("fail", 5.0), "C": ("fail", None), "D": ("fail", None), "E": ("pass_with_warnings", 0.5)}
    assert tuple(verdict(results).first()) == (5, 1, 1, 3, 1, "blocked")
    assert verdict(results.where("check_id IN ('A', 'B')")).first().readiness == "review_required"
    assert verdict(results.where("check_id IN ('A', 'E')")).first().readiness == "ready_with_warnings"
    assert tuple(verdict(results.limit(0)).first()) == (0, 0, 0, 0, 0, "ready")
    with pytest.raises(ValueError):
        catalogue([Check("A", "x"), Check("A", "y")])
