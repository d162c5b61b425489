"""Appending by column intersection, and sessions and repeats on streams against the same on tables."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.append import aligned, append_run, layer_schema
from millrace.streaming.events import event_stream, run_told, session_counts, without_repeats

TARGET = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("Name", T.StringType()), T.StructField("amount", T.DecimalType(8, 2)), T.StructField("run_id", T.StringType())])


def test_a_run_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, "x")], "id int, name string, extra int, run_id string")
    assert append_run(one, path, ["run_id"], TARGET) == {"dropped": ["extra"], "missing": ["amount"]}
    two = spark.createDataFrame([("3", "1.50", "r2")], "ID string, amount string, run_id string")
    assert append_run(two, path, ["run_id"])["missing"] == ["Name"]
    read = lambda: sorted((r.id, r.Name, None if r.amount is None else float(r.amount), r.run_id) for r in spark.read.parquet(path).collect())
    want = [(1, "a", None, "x"), (2, "b", None, "x"), (3, None, 1.5, "r2")]
    assert read() == want
    append_run(one, path, ["run_id"])
    assert read() == want
    append_run(one.where("id = 2"), path, ["run_id"])
    assert read() == want[1:]


def test_values_that_do_not_fit_stop_the_query(spark):
    for bad, text in (([("x", "r")], "not a bigint"), ([(None, "r")], "id is null")):
        with pytest.raises(Exception, match=text):
            aligned(spark.createDataFrame(bad, "id string, run_id string"), TARGET).collect()
    with pytest.raises(ValueError, match="may not be null"):
        aligned(spark.createDataFrame([("r",)], "run_id string"), TARGET)


def test_layers():
    contract = T.StructType([T.StructField("id", T.LongType(), False)])
    assert layer_schema(contract, "source").simpleString().startswith("struct<id:string,source_file_name")
    assert "record_status" in layer_schema(contract, "staging").names and layer_schema(contract, "curated")["id"].dataType == T.LongType()
    with pytest.raises(ValueError):
        layer_schema(contract, "other")


def test_sessions_and_repeats_of_a_stream_are_those_of_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("value").cast("decimal(18,2)").alias("value"))
    last = events.agg(F.max("ts")).first()[0]
    flush = spark.createDataFrame([(-1, last + datetime.timedelta(days=9), -1, None), (-2, last + datetime.timedelta(days=30), -1, None)], events.schema)
    late = spark.createDataFrame([(-3, last - datetime.timedelta(days=3), -7, None)], events.schema)
    folder = str(tmp_path / "in")
    for week in range(5):  # one file after the other, as a stream takes them by when they were written
        events.where(F.floor((F.dayofmonth("ts") - 1) / 7) == week).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: event_stream(spark, folder, files_at_once=1)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    told = run_told(session_counts(stream(), "ts", "user_id", "value", "30 minutes", "1 hour"), out, mark)
    assert told["read"] == events.count() and told["late"] == 0 and told["in_state"] > 0
    for extra in (flush.where("event_id = -1"), late, flush.where("event_id = -2")):
        extra.write.mode("append").parquet(folder)
        told = run_told(session_counts(stream(), "ts", "user_id", "value", "30 minutes", "1 hour"), out, mark)
        assert told["late"] == (1 if extra is late else 0)
    rows = lambda df: sorted(map(tuple, df.where("user_id >= 0").collect()))
    assert rows(spark.read.parquet(out)) == rows(session_counts(events, "ts", "user_id", "value"))

    twice = str(tmp_path / "twice")
    events.limit(500).union(events.limit(300)).coalesce(1).write.parquet(twice)
    once = str(tmp_path / "once")
    run_told(without_repeats(event_stream(spark, twice), "ts", ["event_id"], "60 days"), once, str(tmp_path / "mark2"))
    assert spark.read.parquet(once).count() == 500
