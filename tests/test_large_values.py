"""Values beyond what a long holds."""

import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions.scalar import round_half_away
from millrace.operators.definitions import assessed


def test_rounding_has_no_largest_value(spark):
    values = [9.2e12, 9.3e12, -9.3e12, 3.75939416e14, 1e18, 2.0**63, 1e300, float("inf"), float("-inf"), 0.0, -0.5, 2.0**53 + 2, 2.0**52 + 1, 0.0000005, 1.0000015, 12345678.1234565, -12345678.1234565]
    want = [math.copysign(1, v) * (math.floor(y) if math.isfinite(y) else y) / 1e6 for v in values for y in [abs(v) * 1e6 + 0.5]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r.x for r in rows.select("k", round_half_away(F.col("v"), 6).alias("x")).orderBy("k").collect()]
    assert got == want
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(round_half_away(F.col("v"), 6).alias("x")).collect()
    assert math.isnan(odd[0].x) and odd[1].x is None


def test_variance_of_large_series(spark):
    values = [1e9 + 2e7 * (k % 7) for k in range(24)]
    rows = [("t", "e", datetime.date(2020 + k // 12, k % 12 + 1, 1), round(v * 100), "observed") for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "target string, entity string, period date, cents long, imputation_flag string").withColumn("cents", F.col("cents").cast("decimal(38,0)"))
    (row,) = assessed(frame).collect()
    assert row.variance == pytest.approx(statistics.variance(values), rel=1e-12) and row.variance > 2.0**63 / 1e6 and row.status == "eligible"
