"""All events are simulated, each type on each day as a queue of its own."""

from pyspark.sql import functions as F

from millrace.plans import views


def test_every_event_is_simulated(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null")
    got = views.sim_events(spark, sf_dir)
    assert got.count() == 5 * events.count()
    assert got.select("contact").distinct().count() == events.select("event_id").distinct().count()


def test_a_queue_is_one_day(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null")
    queues = events.select("event_type", F.to_date("ts")).distinct().count()
    measures = views.sim_metrics(spark, sf_dir)
    assert measures.count() == 5 * queues and measures.agg(F.sum("contacts")).first()[0] == 5 * events.count()
    for made in (views.sim_resilience(spark, sf_dir), views.sim_means(spark, sf_dir)):
        assert made.count() == queues and {r.replications for r in made.collect()} == {5}
