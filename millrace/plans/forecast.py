"""Forecasting over the test tables: orders by priority are the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast as f
from ..sources.tables import table
from .utilisation import r

#: First and last whole month of the test tables, for the SQL; the operators find theirs in the dates.
FIRST, LAST = "1995-01-01", "2001-07-01"
INITIAL, HORIZON, STEP = 60, 6, 6


def series_monthly(spark: SparkSession, d: str) -> DataFrame:
    return f.dense_series(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.lit(1))


def series_outside(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the month in progress, and those without a date."""
    return f.outside_series(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.lit(1))


def series_two_grain(spark: SparkSession, d: str) -> DataFrame:
    return f.two_grain_series(table(spark, d, "orders"), "o_orderstatus", F.col("o_orderdate"), F.lit(1))


def series_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return f.eligibility(series_monthly(spark, d))


def folds(spark: SparkSession, d: str) -> DataFrame:
    return f.folds(series_monthly(spark, d), INITIAL, HORIZON, STEP)


def model_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return f.model_forecasts(f.histories(series_monthly(spark, d)), HORIZON)


def _of(model: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return model_forecasts(spark, d).where(F.col("model") == model).select("series_id", "h", "forecast")

    return run


def fc_holt_winters(spark: SparkSession, d: str) -> DataFrame:
    return f.holt_winters(series_monthly(spark, d), HORIZON)


def backtest(spark: SparkSession, d: str) -> DataFrame:
    return f.backtest(series_monthly(spark, d), INITIAL, HORIZON, STEP)


def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return f.error_metrics(backtest(spark, d), ["series_id", "model"])


def model_selection(spark: SparkSession, d: str) -> DataFrame:
    return f.choose_model(backtest_metrics(spark, d))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return f.interval_widths(backtest(spark, d), ["series_id", "model"], [0.8, 0.95])


def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    pairs = backtest(spark, d)
    return f.coverage(pairs, f.interval_widths(pairs, ["series_id", "model"], [0.8, 0.95]), ["series_id", "model"])


def backtest_all(spark: SparkSession, d: str) -> DataFrame:
    return f.backtest_all(series_monthly(spark, d), INITIAL, HORIZON, STEP)


def backtest_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    return f.error_metrics(backtest_all(spark, d), ["series_id", "model"])


def model_selection_all(spark: SparkSession, d: str) -> DataFrame:
    return f.with_fallback(f.choose_model(backtest_all_metrics(spark, d)), series_monthly(spark, d))


def intervals_all(spark: SparkSession, d: str) -> DataFrame:
    return f.interval_widths(backtest_all(spark, d), ["series_id", "model"], [0.8, 0.95])


def final_forecasts_all(spark: SparkSession, d: str) -> DataFrame:
    return f.final_forecasts(series_monthly(spark, d), model_selection_all(spark, d), intervals_all(spark, d), HORIZON)


MODELS = ["naive", "seasonal_naive", "moving_average", "drift", "ses", "holt"]
QUERIES = {x.__name__: x for x in (series_monthly, series_outside, series_two_grain, series_eligibility, folds, model_forecasts, fc_holt_winters, backtest, backtest_metrics, model_selection, intervals, interval_coverage, backtest_all, backtest_all_metrics, model_selection_all, intervals_all, final_forecasts_all)}
QUERIES |= {f"fc_{m}": _of(m) for m in MODELS}

_SERIES = f"""SELECT s AS series_id, strftime(m, '%Y-%m') AS period, coalesce(v, 0)::DOUBLE AS value, v IS NULL AS filled
  FROM (SELECT DISTINCT o_orderpriority AS s FROM orders) CROSS JOIN (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 MONTH)) AS m)
  LEFT JOIN (SELECT o_orderpriority AS s2, strftime(o_orderdate, '%Y-%m') AS p, count(*) AS v FROM orders GROUP BY 1, 2) ON s = s2 AND p = strftime(m, '%Y-%m')"""
_Y = f"SELECT series_id, list(value ORDER BY period) AS y, count(*) AS n FROM ({_SERIES}) GROUP BY 1"
_FOLDS = f"SELECT series_id, (k / {STEP})::INTEGER AS fold, ({INITIAL} + k)::INTEGER AS train_end, ({INITIAL} + k + {HORIZON})::INTEGER AS validation_end FROM ({_Y}), (SELECT unnest(range(0, 1000, {STEP})) AS k) WHERE {INITIAL} + k + {HORIZON} <= n"
_HOLT = "list_reduce(list_prepend([y[1], y[2] - y[1]], list_transform(y[2:], lambda v: [v])), lambda a, v: [0.4::DOUBLE * v[1] + 0.6::DOUBLE * (a[1] + a[2]), 0.2::DOUBLE * ((0.4::DOUBLE * v[1] + 0.6::DOUBLE * (a[1] + a[2])) - a[1]) + 0.8::DOUBLE * a[2]])"


def _forecasts(source: str, keys: str) -> str:
    models = {
        "naive": "y[-1]",
        "seasonal_naive": "CASE WHEN len(y) >= 12 THEN y[len(y) - 12 + (h - 1) % 12 + 1] ELSE y[-1] END",
        "moving_average": "(y[-1] + y[-2] + y[-3]) / 3",
        "drift": "y[-1] + (y[-1] - y[1]) / (len(y) - 1) * h",
        "ses": "list_reduce(y, lambda a, v: 0.4::DOUBLE * v + 0.6::DOUBLE * a)",
        "holt": f"({_HOLT})[1] + ({_HOLT})[2] * h",
    }
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS model, h::INTEGER AS h, {r(f'greatest(0.0, {e})')} AS forecast FROM ({source}), (SELECT unnest(range(1, {HORIZON + 1})) AS h)" for m, e in models.items())


_ALL = _forecasts(_Y, "series_id")
_CUT = f"SELECT a.series_id, fold, y[1:train_end] AS y, y[train_end + 1:train_end + {HORIZON}] AS next FROM ({_Y}) a JOIN ({_FOLDS}) b ON a.series_id = b.series_id"
_BACK = f"SELECT f.series_id, f.fold, f.model, f.h, forecast, next[f.h] AS actual FROM ({_forecasts(_CUT, 'series_id, fold')}) f JOIN ({_CUT}) c ON f.series_id = c.series_id AND f.fold = c.fold"
_E = "(forecast - actual)"
_X = f"{_E}::DECIMAL(20,4)"
_METRICS = f"""SELECT series_id, model, count(*) AS n, {r(f'(sum(abs({_X}))::DOUBLE / count(*))')} AS mae, {r(f'sqrt(sum({_X} * {_X})::DOUBLE / count(*))')} AS rmse, CASE WHEN sum(abs(actual)) > 0 THEN {r(f'(sum(abs({_X}))::DOUBLE / sum(abs(actual)))')} END AS wape,
  {r(f'(sum({_X})::DOUBLE / count(*))')} AS bias, {r(f'avg(CASE WHEN abs(actual) + abs(forecast) = 0 THEN 0.0 ELSE 2 * abs{_E} / (abs(actual) + abs(forecast)) END)')} AS smape FROM ({_BACK}) GROUP BY 1, 2"""
_RANK = "list_position(['naive', 'seasonal_naive', 'moving_average', 'drift', 'ses', 'holt'], model)"
_WIDTH = f"SELECT series_id, model, level, {r('e[(round_even(level * (len(e) - 1), 0))::INTEGER + 1]')} AS width FROM (SELECT series_id, model, list_sort(list(abs{_E})) AS e FROM ({_BACK}) GROUP BY 1, 2), (SELECT unnest([0.8::DOUBLE, 0.95::DOUBLE]) AS level)"
ORACLE_SQL = {
    "series_monthly": _SERIES,
    "series_two_grain": "SELECT coalesce(o_orderstatus, 'ALL') AS series_id, strftime(o_orderdate, '%Y-%m') AS period, count(*)::DOUBLE AS value FROM orders GROUP BY GROUPING SETS ((strftime(o_orderdate, '%Y-%m')), (o_orderstatus, strftime(o_orderdate, '%Y-%m')))",
    "series_eligibility": f"""WITH s AS ({_SERIES}), i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS i, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS back FROM s),
      g AS (SELECT series_id, avg(gap) AS g FROM (SELECT series_id, i - lag(i) OVER (PARTITION BY series_id ORDER BY period) AS gap FROM i WHERE value <> 0) GROUP BY 1),
      t AS (SELECT series_id, count(*) AS periods, {r('avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS zero_share, sum(CASE WHEN back <= 3 AND value <> 0 THEN 1 ELSE 0 END)::BIGINT AS recent, {r('coalesce(var_samp(value), 0.0)', 6)} AS variance FROM i GROUP BY 1)
      SELECT t.*, {r('coalesce(g, 0.0)', 6)} AS mean_gap, CASE WHEN periods < 12 THEN 'insufficient_history' WHEN recent = 0 THEN 'inactive_series' WHEN zero_share > 0.5 THEN 'too_sparse' WHEN variance = 0 THEN 'constant_series' WHEN periods < 24 THEN 'baseline_only' ELSE 'eligible' END AS status FROM t LEFT JOIN g USING (series_id)""",
    "folds": _FOLDS,
    "model_forecasts": _ALL,
    "backtest": _BACK,
    "backtest_metrics": _METRICS,
    "model_selection": f"SELECT series_id, model, mae FROM (SELECT *, min(mae) OVER (PARTITION BY series_id) AS b FROM ({_METRICS})) WHERE mae <= b + 1e-6 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY {_RANK}, model) = 1",
    "intervals": _WIDTH,
    "interval_coverage": f"SELECT series_id, model, level, {r('avg(CASE WHEN actual >= greatest(0.0, forecast - width) AND actual <= forecast + width THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS coverage FROM ({_BACK}) JOIN ({_WIDTH}) USING (series_id, model) GROUP BY 1, 2, 3",
} | {f"fc_{m}": f"SELECT series_id, h, forecast FROM ({_ALL}) WHERE model = '{m}'" for m in MODELS}

# Holt-Winters, one recursion step for each value; ``q`` is the queue of seasonal terms


def _seasonal(source: str, keys: str) -> str:
    level = "(0.4::DOUBLE * (y[i] - q[1]) + 0.6::DOUBLE * (level + trend))"
    return f"""SELECT {keys}, 'holt_winters' AS model, h::INTEGER AS h, {r('greatest(0.0, level + h * trend + q[(h - 1) % 12 + 1])')} AS forecast FROM (
  WITH RECURSIVE s AS (
    SELECT {keys}, y, 1 AS i, total / 12.0::DOUBLE AS level, (list_reduce(y[13:24], lambda a, v: a + v) - total) / 144.0::DOUBLE AS trend, list_transform(y[1:12], lambda v: v - total / 12.0::DOUBLE) AS q
      FROM (SELECT *, list_reduce(y[1:12], lambda a, v: a + v) AS total FROM ({source}) WHERE len(y) >= 24)
    UNION ALL SELECT {keys}, y, i + 1, {level}, 0.2::DOUBLE * ({level} - level) + 0.8::DOUBLE * trend, list_append(q[2:12], 0.2::DOUBLE * (y[i] - {level}) + 0.8::DOUBLE * q[1]) FROM s WHERE i <= len(y))
  SELECT * FROM s WHERE i = len(y) + 1), (SELECT unnest(range(1, {HORIZON + 1})) AS h)"""


ORACLE_SQL["fc_holt_winters"] = f"SELECT series_id, h, forecast FROM ({_seasonal(_Y, 'series_id')})"
_BACK_ALL = f"SELECT f.series_id, f.fold, f.model, f.h, forecast, next[f.h] AS actual FROM ({_forecasts(_CUT, 'series_id, fold')} UNION ALL {_seasonal(_CUT, 'series_id, fold')}) f JOIN ({_CUT}) c ON f.series_id = c.series_id AND f.fold = c.fold"
_SIX, _SEVEN = "'holt']", "'holt', 'holt_winters']"
#: Every series of the test tables has folds, so no fallback shows in the SQL.
ORACLE_SQL |= {f"{name}_all" if name != "backtest_metrics" else "backtest_all_metrics": ORACLE_SQL[name].replace(_BACK, _BACK_ALL).replace(_SIX, _SEVEN) for name in ("backtest", "backtest_metrics", "model_selection", "intervals")}
