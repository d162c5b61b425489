"""Formula costs, sensitivities against a plain loop, planning demand, objective parts."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.costs import BASE, Component, flow_sensitivity, formula_costs, objective_parts, planning_demand, ranked_parameters


def test_a_share_counts_what_comes_before_it(spark):
    cases = spark.createDataFrame([(1, 10.0), (2, 0.0)], "k int, x double")
    parts = [Component("zeta", "x", F.col("x"), 2), Component("alpha", "2x", F.col("x") * 2), Component("contingency", "share", None, 1, 0.5), Component("omega", "share again", None, 1, 0.1)]
    got = {(r.k, r.component): (r.amount, r.year) for r in formula_costs(cases, ["k"], parts).collect()}
    assert got == {(1, "alpha"): (20, 1), (1, "contingency"): (10, 1), (1, "omega"): (3, 1), (1, "zeta"): (10, 2), (2, "alpha"): (0, 1), (2, "contingency"): (0, 1), (2, "omega"): (0, 1), (2, "zeta"): (0, 2)}


def value(s, t, m, p, horizon, ramp_years):
    total = 0.0
    for y in range(1, horizon + 1):
        ramp = 0.0 if y <= p["building_release_timing"] else min(1.0, (y - p["building_release_timing"]) / ramp_years)
        gain = s * p["forecast_demand_basis"] * (1 + p["cost_escalation"]) ** (y - 1) * (1 + p["demand_growth"]) ** (y - 1) * min(1.0, ramp * p["benefit_ramp"]) * (1 - p["simulation_risk_adjustment"])
        paid = m * p["operational_mitigation_cost"] + (t * p["transition_cost"] * p["implementation_cost"] if y == 1 else 0.0)
        total += (gain - paid) / (1 + p["discount_rate"]) ** y
    return total


def test_sensitivity_of_each_parameter(spark):
    cases = spark.createDataFrame([("a", 100.0, 250.0, 5.0), ("b", 7.0, 90.0, 0.0)], "k string, s double, t double, m double")
    levels = {k: (v * 0.9 - 0.001, v, v * 1.2 + 0.01) for k, v in BASE.items()}
    rows = flow_sensitivity(cases, ["k"], "s", "t", "m", levels, 8, 3).collect()
    money = {"a": (100.0, 250.0, 5.0), "b": (7.0, 90.0, 0.0)}
    assert len(rows) == 2 * 10 * 3
    for r in rows:
        assert r.npv == pytest.approx(value(*money[r.k], BASE | {r.parameter: r.value}, 8, 3), abs=0.0051)
        assert r.level != "base" or r.change == 0
    ranks = [r.parameter for r in ranked_parameters(flow_sensitivity(cases, ["k"], "s", "t", "m", levels, 8, 3)).orderBy("rank").collect()]
    most = {p: max(abs(r.change) for r in rows if r.parameter == p) for p in BASE}
    assert ranks == sorted(BASE, key=lambda p: (-most[p], p))
    with pytest.raises(ValueError):
        flow_sensitivity(cases, ["k"], "s", "t", "m", {"other": (0.0, 0.0, 0.0)})


def test_planning_demand_falls_back(spark):
    points = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 11.0), ("u", 1, 5.0)], "e string, p int, v double")
    bounds, homes = spark.createDataFrame([("s", 1, 12.5)], "e string, p int, top double"), spark.createDataFrame([("s", "site-1")], "e string, site string")
    got = {(r.e, r.p): (r.point_demand, r.planning_demand, r.basis, r.site) for r in planning_demand(points, bounds, homes, "e", ["e", "p"], "v", "top", "site").collect()}
    assert got == {("s", 1): (10, 12.5, "upper_bound", "site-1"), ("s", 2): (11, 11, "point", "site-1"), ("u", 1): (5, 5, "point", "UNKNOWN")}


def test_parts_of_an_objective(spark):
    terms = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 4.0), ("other", 9.0)], "component string, quantity double")
    got = {r.component: (r.quantity, r.value, r.share) for r in objective_parts(terms, {"a": (1.0, 2.0), "b": (0.5, 1.0), "c": (1.0, 1.0)}).collect()}
    assert got == {"a": (3, 6, 0.75), "b": (4, 2, 0.25), "c": (0, 0, 0)}
