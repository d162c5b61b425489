"""Series states in their order, and scenarios with their risks, on small tables."""

import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators.definitions import Definition, Scenario, assessed, composite, dense, observed


def months(n):
    return [datetime.date(2020 + k // 12, k % 12 + 1, 1) for k in range(n)]


def test_each_state(spark):
    plain = [float(3 + k % 5) for k in range(24)]
    shapes = {
        "short": ("insufficient_history", plain[:17]), "gappy": ("quality_blocked", [None] * 6 + plain[6:]), "silent": ("inactive_series", plain[:21] + [0.0] * 3), "rare": ("too_sparse", [0.0] * 13 + plain[:11]),
        "flat": ("constant_series", [4.0] * 24), "bursts": ("baseline_only", [1.0, 0.0, 0.0] * 11 + [2.0, 1.0, 0.0]), "fine": ("eligible", plain), "one gap": ("eligible", [None] + plain[1:]),
    }
    rows = [("t", name, p, round((v or 0) * 100), "zero_filled" if v is None else "observed") for name, (_, values) in shapes.items() for p, v in zip(months(len(values)), values)]
    frame = spark.createDataFrame(rows, "target string, entity string, period date, cents long, imputation_flag string").withColumn("cents", F.col("cents").cast("decimal(38,0)"))
    got = {r.entity: r for r in assessed(frame.repartition(7)).collect()}
    assert {k: r.status for k, r in got.items()} == {k: v[0] for k, v in shapes.items()}
    for name, (_, values) in shapes.items():
        full = [v or 0.0 for v in values]
        some = [v for v in full if v > 0]
        at = [k for k, v in enumerate(full) if v]
        assert got[name].variance == pytest.approx(statistics.variance(full), abs=1e-6)
        assert got[name].squared_cv == pytest.approx((statistics.variance(some) ** 0.5 / statistics.mean(some)) ** 2, abs=1e-6)
        assert got[name].average_interval == pytest.approx(statistics.mean(b - a for a, b in zip(at, at[1:])), abs=1e-6)


def test_series_are_dense_and_one_pass(spark):
    facts = spark.createDataFrame([("a", datetime.date(2020, 1, 5), 1.25), ("a", datetime.date(2020, 4, 1), 2.0), ("b", datetime.date(2020, 2, 9), None), (None, datetime.date(2020, 9, 1), 1.0), ("a", None, 9.0)], "e string, d date, x double")
    found = observed(facts, "d", [Definition("n", F.col("e"), F.lit(1)), Definition("x", F.col("e"), F.col("x"), F.col("e") == "a")])
    assert str(found._jdf.queryExecution().executedPlan()).count("Exchange") == 1
    got = {(r.target, r.entity, r.period.month): (int(r.cents), r.imputation_flag) for r in dense(found).collect()}
    assert got["x", "a", 1] == (125, "observed") and got["x", "a", 2] == (0, "zero_filled") and got["n", "b", 2] == (100, "observed") and len(got) == 3 * 4


def test_scenarios(spark):
    units = spark.createDataFrame([(k, 10 * k, 100, 7) for k in range(1, 11)], "u int, used int, room int, cost int")
    rows = {(r.scenario, r.relation, r.item): (r.value, r.status) for r in composite(units, "u", "used", "room", "cost", [Scenario("keep", 1.0, 0), Scenario("cut", 1.0, 4), Scenario("more", 0.9, 1)]).collect()}
    assert rows["keep", "capacity", "headroom"] == (300.0, None) and rows["keep", "outcome", "feasibility"] == (0.0, "feasible") and rows["keep", "outcome", "confidence"][1] == "high"
    assert rows["cut", "capacity", "retained"][0] == 6 and rows["cut", "capacity", "headroom"][0] == -40 and rows["cut", "outcome", "feasibility"][1] == "infeasible"
    assert rows["cut", "risk", "capacity"][1] == "high" and rows["cut", "risk", "confidence"][1] == "medium" and rows["cut", "exposure", "transition"][0] == pytest.approx(28 * 0.15)
    assert rows["more", "constraint", "share"][1] == "warning" and rows["more", "outcome", "feasibility"] == (1.0, "feasible_with_warnings")
    assert len(rows) == 3 * 22
