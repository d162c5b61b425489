"""Holt-Winters is back-tested and can be chosen; a series without folds gets naive."""

import random

from millrace.operators import forecast
from tests.test_operators import series


def chosen(frame):
    pairs = forecast.backtest_all(frame, 60, 6, 6)
    best = forecast.with_fallback(forecast.choose_model(forecast.error_metrics(pairs, ["series_id", "model"])), frame)
    return pairs, best, forecast.interval_widths(pairs, ["series_id", "model"], [0.8, 0.95])


def test_holt_winters_is_chosen_where_it_is_best(spark):
    rng = random.Random(0)
    values = [100 + [0, 40, 5, 60, 10, 0, 25, 70, 3, 9, 33, 51][k % 12] + rng.randrange(-15, 16) for k in range(79)]
    frame = series(spark, values)
    pairs, best, widths = chosen(frame)
    assert pairs.where("model = 'holt_winters'").count() == 18 and pairs.count() == 18 * 7
    assert [tuple(r)[:2] for r in best.collect()] == [("s", "holt_winters")]
    got = forecast.final_forecasts(frame, best, widths, 6).collect()
    alone = {r.h: r.forecast for r in forecast.holt_winters(frame, 6).collect()}
    assert len(got) == 12 and all(r.forecast == alone[r.h] and r.low <= r.forecast <= r.high for r in got)


def test_training_windows_do_not_see_what_follows(spark):
    values = [float(k % 12) for k in range(79)]
    changed = values[:66] + [v + 500 for v in values[66:]]
    at = lambda v: {(r.model, r.h): r.forecast for r in forecast.backtest_all(series(spark, v), 60, 6, 6).where("fold = 1").collect()}
    assert at(values) == at(changed)


def test_naive_where_no_model_was_evaluated(spark):
    frame = series(spark, range(1, 64), "short").unionByName(series(spark, range(1, 31), "shorter"))
    pairs, best, widths = chosen(frame)
    assert sorted((r.series_id, r.model, r.h, r.forecast, r.actual) for r in pairs.collect()) == [("short", "naive", h, 60, 60 + h) for h in (1, 2, 3)]
    assert sorted((r.series_id, r.model) for r in best.collect()) == [("short", "naive"), ("shorter", "naive")]
    got = forecast.final_forecasts(frame, best, widths, 6)
    assert got.where("series_id = 'short'").count() == 12 and got.where("series_id = 'shorter' AND level IS NULL AND forecast = 30").count() == 6
