"""The spine of months follows the dates; no row is lost between the series and what lies outside."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import forecast
from millrace.plans import forecast as plans


@pytest.mark.parametrize(("last", "end"), [("2010-02-27", "2010-01"), ("2010-02-28", "2010-02"), ("2010-03-01", "2010-02"), ("2009-11-20", "2009-11")])
def test_spine_and_rest(spark, last, end):
    day = datetime.date.fromisoformat
    frame = spark.createDataFrame([("a", day("2009-11-10")), ("b", day("2009-11-12")), ("a", day(last)), ("b", None)], "s string, d date")
    at = (frame, F.col("s"), F.col("d"), F.lit(1))
    dense, rest = forecast.dense_series(*at), forecast.outside_series(*at)
    months = [r.period for r in dense.select("period").distinct().orderBy("period").collect()]
    assert months[0] == "2009-11" and months[-1] == end and dense.count() == 2 * len(months)
    assert sum(r.value for r in dense.collect()) + sum(r.value for r in rest.collect()) == 4


def test_all_orders_are_told(spark, sf_dir):
    total = lambda x: x.agg(F.sum("value")).first()[0] or 0
    outside = plans.series_outside(spark, sf_dir)
    assert {r.period for r in outside.collect()} == {"2001-08"}
    assert total(plans.series_monthly(spark, sf_dir)) + total(outside) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
