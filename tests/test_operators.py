"""Hand-sized facts about the operators: nulls, zero denominators, ties, short series, header checks."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.scalar import band, benefit_ramp, bounded_ratio, clamp01, discount_factor, minutes_of_day, normalise_text, round_half_away, safe_ratio, weighted_score
from millrace.operators import finance, forecast, quality, reporting, scenario, simulation
from millrace.sources.tables import read_contract_csv, write_once


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_scalars(spark):
    lit = F.lit
    got = one(
        spark, a=safe_ratio(lit(3.0), lit(0.0)), b=safe_ratio(lit(3.0), lit(-1.0)), c=safe_ratio(lit(3.0), lit(None).cast("double")), d=bounded_ratio(lit(9.0), lit(3.0)), e=clamp01(lit(-0.5)),
        f=round_half_away(lit(0.00005)), g=round_half_away(lit(-0.00005)), h=round_half_away(lit(2.5), 0), i=minutes_of_day(lit("08:59")), j=minutes_of_day(lit("x")), k=normalise_text(lit("  Consultation  1! ")),
        m=band(lit(95.0), quality.SCORE_BANDS, "fail"), n=band(lit(69.99), quality.SCORE_BANDS, "fail"), o=discount_factor(lit(0.1), lit(1)), p=benefit_ramp(lit(2), lit(1), lit(4)), q=benefit_ramp(lit(1), lit(1), lit(0)),
    )
    assert [got[k] for k in "abcdefgh"] == [0, 0, 0, 1, 0, 0.0001, -0.0001, 3]
    assert got["i"] == 539 and got["j"] is None and got["k"] == "consultation 1" and (got["m"], got["n"]) == ("pass", "fail")
    assert round(got["o"], 4) == 0.9091 and got["p"] == 0.25 and got["q"] == 0


def test_weighted_score_counts_absent_parts_as_zero(spark):
    frame = spark.createDataFrame([(0.5, 1.0), (0.5, None), (7.0, 7.0)], "x double, y double")
    assert [round(r.s, 4) for r in frame.select(weighted_score({"x": 0.6, "y": 0.4}).alias("s")).collect()] == [0.7, 0.3, 1.0]


def test_duplicates_report_every_member(spark):
    rows = [("R1", "B1", "Consultation 1"), ("R2", "B1", " Consultation 1 "), ("R3", "B1", "Treatment 1"), ("R4", "B2", "Consultation 1"), ("R5", None, "Consultation 1"), ("R6", None, "Consultation 1")]
    frame = spark.createDataFrame(rows, "id string, parent string, name string")
    got = quality.duplicate_members(frame, [F.col("parent"), normalise_text(F.col("name"))], F.col("id")).collect()
    assert sorted((r.id, r.group_size, r.place) for r in got) == [("R1", 2, 1), ("R2", 2, 2)]


def test_quality_scores(spark):
    rows = [("a", "rooms", "completeness", "pass"), ("b", "rooms", "validity", "fail"), ("c", "bookings", "validity", "pass")]
    got = {(r.dataset, r.dimension): (r.score, r.status) for r in quality.scores(spark.createDataFrame(rows, "rule string, dataset string, dimension string, status string")).collect()}
    assert got["rooms", "all"] == (50.0, "fail") and got["all", "all"] == (75.0, "manual_review_required")


def series(spark, values, name="s"):
    rows = [(name, f"{2000 + k // 12}-{k % 12 + 1:02d}", float(v), False) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, period string, value double, filled boolean")


def test_folds(spark):
    got = forecast.folds(series(spark, range(12)), 6, 2, 2).orderBy("fold").collect()
    assert [(r.train_end, r.validation_end) for r in got] == [(6, 8), (8, 10), (10, 12)]
    assert forecast.folds(series(spark, range(7)), 6, 2, 2).count() == 0


def test_error_metrics(spark):
    pairs = spark.createDataFrame([("a", 10.0, 8.0), ("a", 20.0, 23.0), ("z", 0.0, 0.0)], "k string, actual double, forecast double")
    got = {r.k: r for r in forecast.error_metrics(pairs, ["k"]).collect()}
    assert (got["a"].mae, got["a"].rmse, got["a"].wape, got["a"].bias) == (2.5, 2.5495, 0.1667, 0.5)
    assert got["z"].wape is None and got["z"].smape == 0


@pytest.mark.parametrize(("values", "status"), [(range(1, 12), "insufficient_history"), ([1] * 20 + [0] * 3, "inactive_series"), ([0, 0, 1] * 10, "too_sparse"), ([5] * 30, "constant_series"), (range(1, 20), "baseline_only"), (range(1, 30), "eligible")])
def test_eligibility(spark, values, status):
    assert forecast.eligibility(series(spark, values)).first().status == status


def test_models_on_short_series(spark):
    for values in ([4.0], [4.0, 6.0], [0.0] * 5):
        got = forecast.model_forecasts(forecast.histories(series(spark, values)), 3).collect()
        assert len(got) == 18 and all(r.forecast >= 0 for r in got)
    assert forecast.holt_winters(series(spark, range(23)), 3).count() == 0
    got = forecast.holt_winters(series(spark, [10, 11] * 12), 4).orderBy("h").collect()
    assert [round(r.forecast) for r in got] == [10, 11, 10, 11]


def test_cash_flow(spark):
    case = spark.createDataFrame([(1, 110.0, 0.0), (2, 1.0, 1000.0)], "case_id int, saving double, transition double")
    flows = finance.cash_flows(case, 1, F.col("saving"), F.col("transition"), F.lit(0.1), F.lit(0.0), F.lit(0), F.lit(1)).drop("saving", "transition")
    got = {r.case_id: r for r in finance.net_present_value(flows, ["case_id"]).collect()}
    assert abs(got[1].npv - 100) < 0.01 and got[1].payback_year == 1 and got[2].payback_year is None


def test_contingency_covers_what_sorts_before_it(spark):
    rows = spark.createDataFrame([(1, "change", 100.0), (1, "contingency_cost", 0.0), (1, "exit", 900.0)], "case_id int, component string, amount double")
    assert {r.component: r.amount for r in finance.running_contingency(rows, ["case_id"], 0.1).collect()} == {"change": 100, "contingency_cost": 10, "exit": 900}


def test_allocation_meets_need_and_offer(spark):
    need = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("h", 3, 5.0)], "g string, k int, need double")
    offer = spark.createDataFrame([("g", 1, 3.0), ("g", 2, 4.0), ("i", 9, 1.0)], "g string, k int, offer double")
    got = scenario.allocate(need, offer, "g", "need", ["k"], "offer", ["k"])
    assert sorted((r.d.k, r.s.k, r.amount) for r in got.collect()) == [(1, 1, 3), (1, 2, 2), (2, 2, 2)]


def test_rules_in_order(spark):
    frame = spark.createDataFrame([(1, 1), (5, 1), (5, 9)], "a int, b int")
    rules = [("small", F.col("a") < 3), ("low", F.col("b") < 3)]
    assert [tuple(r) for r in frame.select(scenario.first_failing(rules), scenario.all_failing(rules)).collect()] == [("small", "small;low"), ("low", "low"), ("compatible", "")]
    got = reporting.classify(frame, [("r", F.col("a") < 3)], [("w", F.col("b") > 3)]).collect()
    assert [(r.record_status, r.warning_reason) for r in got] == [("rejected", "r"), ("accepted", None), ("accepted_with_warning", "w")]


def test_queue_does_not_depend_on_partitions(spark):
    rows = [("r1", i, 500 + i // 3) for i in range(30)] + [("r2", 99, 10)]
    frame = spark.createDataFrame(rows, "resource string, contact long, minute int")
    runs = [sorted(map(tuple, simulation.replicate(frame.repartition(n), 3, 480.0, 540.0, (1.0, 2.0, 9.0)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 93
    assert all(start >= max(arrival, 480) and end > start for _, _, _, arrival, start, end, _, _ in runs[0])


def test_contract_csv(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType())])
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("id,n,d\n a ,1,2024-04-01\n,x,\n")
    got = read_contract_csv(spark, path, schema, "run").orderBy("source_row_number").collect()
    assert [(r.id, r.n, r.d, r.source_row_number, r.source_file_name) for r in got] == [("a", 1, datetime.date(2024, 4, 1), 2, "t.csv"), (None, None, None, 3, "t.csv")]
    with open(path, "w") as f:
        f.write("id,m\n")
    with pytest.raises(ValueError):
        read_contract_csv(spark, path, schema, "run")


def test_output_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "out")
    write_once(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_once(spark.range(3), path)
    write_once(spark.range(4), path, rebuild=True)
    assert spark.read.parquet(path).count() == 4


def test_text_functions(spark):
    from millrace.functions.text import normalise_unicode, similarity

    frame = spark.createDataFrame([("Ｒｏｏｍ ①", "room 1"), ("abcd", "bcde"), (None, "x")], "a string, b string")
    got = frame.select(normalise_unicode(F.col("a")).alias("n"), similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("room 1", 1.0), ("abcd", 0.75), (None, None)]


def test_manifest(spark, tmp_path):
    import hashlib

    from millrace.sources.tables import manifest_errors

    for name in ("a.csv", "b.csv", "c.csv"):
        (tmp_path / name).write_bytes(name.encode())
    digest = lambda x: hashlib.sha256(x).hexdigest()
    listed = spark.createDataFrame([("a.csv", digest(b"a.csv")), ("b.csv", digest(b"other")), ("d.csv", digest(b"d"))], "name string, sha256 string")
    assert sorted(map(tuple, manifest_errors(spark, str(tmp_path), listed, "*.csv").collect())) == [("b.csv", "changed"), ("c.csv", "not_listed"), ("d.csv", "missing")]


def test_read_only_sql(spark, sf_dir):
    from millrace.sources.tables import columns_of, read_only_sql, register

    register(spark, sf_dir, ["region", "nation"])
    assert read_only_sql(spark, "SELECT n_name FROM nation WHERE n_regionkey = :k", k=1).count() == 5
    assert columns_of(spark, ["region"]).count() == 2
    assert read_only_sql(spark, "SELECT 'drop; table' AS x").first().x == "drop; table"
    for bad in ("DROP VIEW nation", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x", "SET a = 1"):
        with pytest.raises(ValueError):
            read_only_sql(spark, bad)


def test_exports(spark, tmp_path):
    from millrace.sources.tables import export_csv, export_json

    frame = spark.createDataFrame([(2, "b"), (1, "a,c")], "k int, a string")
    export_csv(frame, str(tmp_path / "c"), ["k"])
    export_json(frame, str(tmp_path / "j"), ["k"])
    text = lambda d: next((tmp_path / d).glob("part-*")).read_text()
    assert text("c") == 'k,a\n1,"a,c"\n2,b\n' and text("j") == '{"a":"a,c","k":1}\n{"a":"b","k":2}\n'
