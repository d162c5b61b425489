"""Duplicates, declared issues, lineage, bands: small tables against plain Python or by hand."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.bands import band_join
from millrace.operators.duplicates import DuplicateType, candidate_members, duplicate_candidates, tagged_keys
from millrace.operators.issues import compared, detected, read_declared, with_intentional
from millrace.operators.lineage import closure, lineage_errors, run_ids


def test_four_types_of_duplicates(spark):
    rows = [("r1", "b1", "Room A"), ("r2", "b1", "room a"), ("r3", "b2", "ROOM A "), ("r3", "b2", "Hall"), ("r4", None, None), ("r5", "b3", None)]
    name = F.lower(F.trim("name"))
    types = [DuplicateType("duplicate_identifier", "high", F.col("id")), DuplicateType("within", "low", F.concat(F.col("b"), F.lit("|"), name)), DuplicateType("global", "low", name)]
    tagged = tagged_keys(spark.createDataFrame(rows, "id string, b string, name string"), "rooms", F.col("id"), types)
    groups = duplicate_candidates(tagged)
    got = {(r.duplicate_type, r.match_basis): (r.severity, r.members, r.group_id) for r in groups.collect()}
    assert {k: v[:2] for k, v in got.items()} == {("duplicate_identifier", "r3"): ("high", 2), ("within", "b1|room a"): ("low", 2), ("global", "room a"): ("low", 3)}
    members = sorted(map(tuple, candidate_members(tagged, groups).collect()))
    assert members == sorted([(got["duplicate_identifier", "r3"][2], "r3")] * 2 + [(got["within", "b1|room a"][2], r) for r in ("r1", "r2")] + [(got["global", "room a"][2], r) for r in ("r1", "r2", "r3")])
    assert "SortMergeJoin" not in groups._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def manifest(tmp_path):
    issues = [("I1", "rooms", "r1", "duplicate_label", True), ("I2", "finance", "f1", "missing_optional_source_value", True), ("I3", "finance", "f2", "missing_optional_source_value", False), ("I4", "rooms", "gone", "duplicate_label", True), ("I5", "finance", "f1", "unknown_type", True)]
    names = ("issue_id", "dataset", "record_identifier", "issue_type", "intentional")
    (tmp_path / "issues.json").write_text(json.dumps({"metadata": {"seed": "1"}, "issues": [dict(zip(names, x)) | {"expected_detection_milestone": "m3"} for x in issues]}, indent=1))
    return str(tmp_path / "issues.json")


def test_declared_issues(spark, manifest, tmp_path):
    declared = read_declared(spark, manifest)
    assert declared.count() == 5 and {r.source_file_name for r in declared.collect()} == {"issues.json"}
    statuses = spark.createDataFrame([("rooms", "r1", "accepted"), ("finance", "f1", "accepted_with_warning"), ("finance", "f2", "accepted")], "dataset string, record_id string, record_status string")
    candidates = spark.createDataFrame([("rooms",), ("rooms",)], "dataset string")
    got = {r.issue_id: r.detected for r in detected(declared, statuses, candidates, ["missing_optional_source_value"], ["duplicate_label"]).collect()}
    assert got == {"I1": True, "I2": True, "I3": False, "I4": False, "I5": False}
    found = spark.createDataFrame([("finance", "f1", "missing_optional_source_value"), ("finance", "f1", "missing_optional_source_value"), ("x", None, "new")], "dataset string, record_id string, issue_type string")
    verdicts = {(r.dataset, r.record_id, r.issue_type): (r.declared, r.found, r.verdict) for r in compared(declared, found).collect()}
    assert verdicts["finance", "f1", "missing_optional_source_value"] == (1, 2, "found") and verdicts["x", None, "new"] == (0, 1, "undeclared")
    assert sum(v[2] == "missed" for v in verdicts.values()) == 4 and len(verdicts) == 6
    marked = {(r.dataset, r.record_id): r.intentional_issue_id for r in with_intentional(found, declared).collect()}
    assert marked == {("finance", "f1"): "I2", ("x", None): None}
    (tmp_path / "other.json").write_text('{"metadata": {}}')
    with pytest.raises(Exception, match="no issues in other.json"):
        read_declared(spark, str(tmp_path / "other.json")).collect()


EDGES = [("b", "a"), ("c", "a"), ("c", "b"), ("d", "c"), ("d", "b"), ("e", "x"), ("f", "e"), ("g", "h"), ("h", "g"), ("i", "g")]


def test_lineage(spark):
    edges = spark.createDataFrame(EDGES + EDGES[:2], "run string, upstream string")
    runs = spark.createDataFrame([(r, f"sum-{r}") for r in "abcdefghi"], "run string, checksum string")
    ways = {(r.run, r.upstream): r.depth for r in closure(edges).collect()}
    assert {k: v for k, v in ways.items() if k[0] in "bcd"} == {("b", "a"): 1, ("c", "a"): 2, ("c", "b"): 1, ("d", "c"): 1, ("d", "b"): 2, ("d", "a"): 3}
    errors = {tuple(r) for r in lineage_errors(runs, edges).collect()}
    assert errors == {("e", "x", "missing_upstream"), ("f", "x", "missing_upstream"), ("g", "g", "cycle"), ("h", "h", "cycle")}
    ids = {r.run: (r.level, r.run_id) for r in run_ids(runs, edges, "v1").collect()}
    assert [ids[r][0] for r in "abcd"] == [0, 1, 2, 3] and all(ids[r][1] for r in "abcd") and not any(ids[r][1] for r in "efghi")
    changed = runs.withColumn("checksum", F.when(F.col("run") == "b", "other").otherwise(F.col("checksum")))
    again = {r.run: r.run_id for r in run_ids(changed, edges, "v1").collect()}
    assert again["a"] == ids["a"][1] and all(again[r] != ids[r][1] for r in "bcd")


def test_bands(spark):
    bands = spark.createDataFrame([("night", 0, 420), ("early", 420, 421), ("day", 421, 1380), ("none", 5, 5)], "band string, start int, end int")
    rows = spark.createDataFrame([(x, 1) for x in (0, 5, 419, 420, 421, 1379)], "minute int, cell int")
    joined = band_join(rows, F.col("minute"), bands)
    assert {(r.minute, r.band) for r in joined.collect()} == {(0, "night"), (5, "night"), (419, "night"), (420, "early"), (421, "day"), (1379, "day")}
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    late = rows.union(spark.createDataFrame([(1380, 1), (None, 1)], "minute int, cell int"))
    assert {r.minute: r.band for r in band_join(late, F.col("minute"), bands, strict=False).collect()}[1380] is None
    with pytest.raises(Exception, match="no band covers 1380"):
        band_join(late.where("minute IS NOT NULL"), F.col("minute"), bands).count()


def test_top_units_are_cut_before_they_move(spark, sf_dir):
    from millrace.plans.evidence import top_units_by_service

    assert "WindowGroupLimit" in top_units_by_service(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
