from pyspark.sql import functions as F

from millrace.streaming.events import event_stream, run_once, windowed_counts


def test_stream_equals_batch_for_closed_windows(spark, sf_dir, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    last = events.agg(F.max("day")).first()[0]
    events.where(F.dayofmonth("ts") <= 15).drop("day").coalesce(1).write.parquet(source)
    counts = lambda: windowed_counts(event_stream(spark, source), "ts", "event_type", "value")
    run_once(counts(), out, mark)
    events.where(F.dayofmonth("ts") > 15).drop("day").coalesce(1).write.mode("append").parquet(source)
    run_once(counts(), out, mark)
    want = {(str(r.day), r.event_type): r.n for r in events.where(F.col("day") < last).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(str(r.window_start.date()), r.event_type): r.n for r in spark.read.parquet(out).collect()}
    assert got == want
