"""Dense monthly series, eligibility, folds, base models, smoothing, errors, choice and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import month_key, round_half_away

#: Base models from simplest on: the order breaks ties of the metric.
SIMPLICITY = ["naive", "seasonal_naive", "moving_average", "drift", "ses", "holt", "holt_winters"]


def _monthly(facts: DataFrame, series: Column, date: Column, value: Column) -> DataFrame:
    return facts.groupBy(series.alias("series_id"), month_key(date).alias("period")).agg(F.sum(value).alias("v"))


def _spine(facts: DataFrame, date: Column) -> DataFrame:
    """One row, ``first`` and ``last``: the month of the first date and the last month that is over at the last date.

    A month in progress would count as a fall; it is kept only if there is no other.
    """
    day = date.cast("date")
    bounds = facts.agg(F.trunc(F.min(day), "month").alias("first"), F.max(day).alias("_max"))
    return bounds.select("first", F.greatest("first", F.add_months(F.trunc(F.date_add("_max", 1), "month"), -1)).alias("last"))


def dense_series(facts: DataFrame, series: Column, date: Column, value: Column) -> DataFrame:
    """(series_id, period, value, filled): zero where nothing happened in a month of the spine."""
    months = F.explode(F.transform(F.sequence("first", "last", F.expr("interval 1 month")), month_key))
    sums = _monthly(facts, series, date, value)
    spine = sums.select("series_id").distinct().crossJoin(_spine(facts, date)).select("series_id", months.alias("period"))
    return spine.join(sums, ["series_id", "period"], "left").select("series_id", "period", round_half_away(F.coalesce("v", F.lit(0)).cast("double")).alias("value"), F.col("v").isNull().alias("filled"))


def outside_series(facts: DataFrame, series: Column, date: Column, value: Column) -> DataFrame:
    """(series_id, period, value) of what ``dense_series`` has no month for: the month in progress, and facts without a date."""
    sums = _monthly(facts, series, date, value).crossJoin(_spine(facts, date))
    off = F.col("period").isNull() | (F.col("period") > month_key(F.col("last")))
    return sums.where(off).select("series_id", "period", round_half_away(F.col("v").cast("double")).alias("value"))


def two_grain_series(facts: DataFrame, series: str, date: Column, value: Column) -> DataFrame:
    """Sums by month, in all and by series, from one pass."""
    each = facts.select(F.col(series).alias("_s"), month_key(date).alias("period"), value.alias("_v"))
    out = each.groupingSets([["period"], ["_s", "period"]], "_s", "period").agg(F.sum("_v").alias("v"), F.grouping("_s").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("_s")).alias("series_id"), "period", round_half_away(F.col("v").cast("double")).alias("value"))


def _by_series() -> Window:
    return Window.partitionBy("series_id").orderBy("period")


def eligibility(series: DataFrame, least: int = 12, sparse: float = 0.5) -> DataFrame:
    """Diagnostics of each series and the first state that applies."""
    at = series.withColumn("i", F.row_number().over(_by_series()))
    zero = at.where("value <> 0").withColumn("gap", F.col("i") - F.lag("i").over(_by_series()))
    gaps = zero.groupBy("series_id").agg(F.avg("gap").alias("g"))
    last = at.withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("period"))))
    stats = last.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("periods"), F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("z"), F.sum(F.when((F.col("back") <= 3) & (F.col("value") != 0), 1).otherwise(0)).alias("recent"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var")
    )
    six = lambda c: round_half_away(c, 6)
    out = stats.join(gaps, "series_id", "left").select("series_id", "periods", six(F.col("z")).alias("zero_share"), "recent", six(F.col("var")).alias("variance"), six(F.coalesce("g", F.lit(0.0))).alias("mean_gap"))
    state = F.when(F.col("periods") < least, "insufficient_history").when(F.col("recent") == 0, "inactive_series").when(F.col("zero_share") > sparse, "too_sparse").when(F.col("variance") == 0, "constant_series").when(F.col("periods") < 2 * least, "baseline_only")
    return out.withColumn("status", state.otherwise("eligible"))


def folds(series: DataFrame, initial: int, horizon: int, step: int) -> DataFrame:
    """Expanding windows: train [0, train_end), validate [train_end, validation_end)."""
    size = series.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= initial + horizon)
    ends = F.sequence(F.lit(initial), F.col("n") - horizon, F.lit(step))
    return size.select("series_id", F.posexplode(ends).alias("fold", "train_end")).withColumn("validation_end", F.col("train_end") + horizon)


def histories(series: DataFrame) -> DataFrame:
    """One row for each series, its values in order.  A series has a value a month, so an array is small."""
    return series.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("period", "value"))), lambda x: x["value"]).alias("y"))


def _ses(y: Column, alpha: float) -> Column:
    return F.aggregate(F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0))), F.element_at(y, 1), lambda level, v: F.lit(alpha) * v + F.lit(1 - alpha) * level)


def _holt(y: Column, alpha: float, beta: float) -> Column:
    start = F.struct(F.element_at(y, 1).alias("level"), F.coalesce(F.get(y, F.lit(1)) - F.element_at(y, 1), F.lit(0.0)).alias("trend"))

    def step(a: Column, v: Column) -> Column:
        level = F.lit(alpha) * v + F.lit(1 - alpha) * (a["level"] + a["trend"])
        return F.struct(level.alias("level"), (F.lit(beta) * (level - a["level"]) + F.lit(1 - beta) * a["trend"]).alias("trend"))

    return F.aggregate(F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0))), start, step)


def model_forecasts(history: DataFrame, horizon: int, window: int = 3, season: int = 12, alpha: float = 0.4, beta: float = 0.2) -> DataFrame:
    """All base models of each history ``y`` for h = 1 to ``horizon``, never below zero.  Arrays only, no Python."""
    n, last = F.size("y"), F.element_at("y", -1)
    keys = [c for c in history.columns if c != "y"]
    fit = history.where(F.size("y") > 0).select(*keys, "y", _ses(F.col("y"), alpha).alias("_ses"), _holt(F.col("y"), alpha, beta).alias("_holt"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    tail = F.slice("y", F.greatest(n - window + 1, F.lit(1)), F.lit(window))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail)
    slope = F.when(n > 1, (last - F.element_at("y", 1)) / (n - 1)).otherwise(0.0)
    cycle = F.when(n >= season, F.get(F.col("y"), n - season + (F.col("h") - 1) % season)).otherwise(last)
    values = {"naive": last, "seasonal_naive": cycle, "moving_average": mean, "drift": last + slope * F.col("h"), "ses": F.col("_ses"), "holt": F.col("_holt.level") + F.col("_holt.trend") * F.col("h")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.greatest(v.cast("double"), F.lit(0.0)).alias("forecast")) for k, v in values.items()]))
    return fit.select(*keys, "h", each.alias("m")).select(*keys, "m.model", "h", round_half_away(F.col("m.forecast")).alias("forecast"))


def _seasonal(y: Column, horizon: int, season: int, alpha: float, beta: float, gamma: float) -> Column:
    """(h, forecast) of additive Holt-Winters smoothing, as a fold over the values.

    The state carries the level, the trend and a queue of seasonal terms: the
    first is the one of the value at hand; renewed, it goes to the end.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    one, two = F.slice(y, 1, season), F.slice(y, season + 1, season)
    level = total(one) / float(season)
    start = F.struct(level.alias("level"), ((total(two) - total(one)) / float(season * season)).alias("trend"), F.transform(one, lambda v: v - level).alias("queue"))

    def step(a: Column, v: Column) -> Column:
        term = F.element_at(a["queue"], 1)
        level = F.lit(alpha) * (v - term) + F.lit(1 - alpha) * (a["level"] + a["trend"])
        trend = F.lit(beta) * (level - a["level"]) + F.lit(1 - beta) * a["trend"]
        renewed = F.lit(gamma) * (v - level) + F.lit(1 - gamma) * term
        return F.struct(level.alias("level"), trend.alias("trend"), F.concat(F.slice(a["queue"], 2, season - 1), F.array(renewed)).alias("queue"))

    def ahead(a: Column) -> Column:
        value = lambda h: F.greatest(F.lit(0.0), a["level"] + h * a["trend"] + F.element_at(a["queue"], (h - 1) % season + 1))
        return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.struct(h.alias("h"), round_half_away(value(h)).alias("forecast")))

    return F.aggregate(y, start, step, ahead)


def _holt_winters(history: DataFrame, horizon: int, season: int, alpha: float, beta: float, gamma: float) -> DataFrame:
    keys = [c for c in history.columns if c != "y"]
    made = history.where(F.size("y") >= 2 * season).select(*keys, F.explode(_seasonal(F.col("y"), horizon, season, alpha, beta, gamma)).alias("m"))
    return made.select(*keys, F.lit("holt_winters").alias("model"), "m.h", "m.forecast")


def holt_winters(series: DataFrame, horizon: int, season: int = 12, alpha: float = 0.4, beta: float = 0.2, gamma: float = 0.2) -> DataFrame:
    """Additive seasonal smoothing.  Series shorter than two seasons give no rows."""
    return _holt_winters(histories(series), horizon, season, alpha, beta, gamma).drop("model")


def all_forecasts(history: DataFrame, horizon: int, season: int = 12, alpha: float = 0.4, beta: float = 0.2, gamma: float = 0.2) -> DataFrame:
    """The base models and, from two seasons on, Holt-Winters, of each history ``y``."""
    return model_forecasts(history, horizon, season=season, alpha=alpha, beta=beta).unionByName(_holt_winters(history, horizon, season, alpha, beta, gamma))


def _pairs(cut: DataFrame, forecasts: Callable[[DataFrame, int], DataFrame], horizon: int) -> DataFrame:
    train = cut.select("series_id", "fold", F.slice("y", F.lit(1), F.col("train_end")).alias("y"))
    actual = cut.select("series_id", "fold", F.posexplode(F.slice("y", F.col("train_end") + 1, F.lit(horizon))).alias("k", "actual"))
    return forecasts(train, horizon).join(actual.withColumn("h", F.col("k") + 1).drop("k"), ["series_id", "fold", "h"])


def backtest(series: DataFrame, initial: int, horizon: int, step: int) -> DataFrame:
    """Forecasts of every base model and fold next to what happened."""
    return _pairs(histories(series).join(folds(series, initial, horizon, step), "series_id"), model_forecasts, horizon)


def backtest_all(series: DataFrame, initial: int, horizon: int, step: int) -> DataFrame:
    """``backtest`` with Holt-Winters too; a series without folds has naive on the first window, as far as it goes on."""
    every, cuts = histories(series), folds(series, initial, horizon, step)
    first = every.join(cuts, "series_id", "left_anti").where(F.size("y") > initial).withColumn("fold", F.lit(0)).withColumn("train_end", F.lit(initial))
    naive = _pairs(first, lambda train, h: model_forecasts(train, h).where("model = 'naive'"), horizon)
    return _pairs(every.join(cuts, "series_id"), all_forecasts, horizon).unionByName(naive)


def with_fallback(chosen: DataFrame, series: DataFrame) -> DataFrame:
    """``chosen``, and naive for the series for which no model was evaluated."""
    rest = series.select("series_id").distinct().join(chosen, "series_id", "left_anti")
    return chosen.unionByName(rest.withColumn("model", F.lit("naive")), allowMissingColumns=True)


def final_forecasts(series: DataFrame, chosen: DataFrame, widths: DataFrame, horizon: int) -> DataFrame:
    """The chosen model on the whole series, with an interval for each level; no interval where nothing was back-tested."""
    made = all_forecasts(histories(series), horizon).join(chosen.select("series_id", "model"), ["series_id", "model"])
    low, high = F.greatest(F.lit(0.0), F.col("forecast") - F.col("width")), F.col("forecast") + F.col("width")
    return made.join(widths, ["series_id", "model"], "left").select("series_id", "model", "h", "forecast", "level", round_half_away(low).alias("low"), round_half_away(high).alias("high"))


def error_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, WAPE, bias and sMAPE; null where the actual values sum to 0, and a 0/0 term of sMAPE is 0.

    Errors are summed as decimals, so that the order of rows never moves a tie.
    """
    e, a, f = F.col("forecast") - F.col("actual"), F.abs("actual"), F.abs("forecast")
    exact, n = e.cast("decimal(20,4)"), F.count(F.lit(1))
    term = F.when(a + f == 0, 0.0).otherwise(2 * F.abs(e) / (a + f))
    out = pairs.groupBy(*by).agg(
        n.alias("n"), round_half_away(F.sum(F.abs(exact)).cast("double") / n).alias("mae"), round_half_away(F.sqrt(F.sum(exact * exact).cast("double") / n)).alias("rmse"),
        round_half_away(F.when(F.sum(a) > 0, F.sum(F.abs(exact)).cast("double") / F.sum(a))).alias("wape"), round_half_away(F.sum(exact).cast("double") / n).alias("bias"), round_half_away(F.avg(term)).alias("smape"),
    )
    return out


def choose_model(metrics: DataFrame, metric: str = "mae", tolerance: float = 1e-6) -> DataFrame:
    """The simplest model within ``tolerance`` of the best."""
    best = F.min(metric).over(Window.partitionBy("series_id"))
    rank = F.array_position(F.array(*map(F.lit, SIMPLICITY)), F.col("model"))
    near = metrics.withColumn("_b", best).where(F.col(metric) <= F.col("_b") + tolerance)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy(rank, "model"))).where("_r = 1").select("series_id", "model", metric)


def interval_widths(pairs: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    """Empirical widths: the absolute residual at index round(level * (n - 1)), half to even."""
    res = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(F.abs(F.col("forecast") - F.col("actual")))).alias("r"))
    each = res.select(*by, "r", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = F.bround(F.col("level") * (F.size("r") - 1)).cast("int")
    return each.select(*by, "level", round_half_away(F.get(F.col("r"), at)).alias("width"))


def coverage(pairs: DataFrame, widths: DataFrame, by: list[str]) -> DataFrame:
    """Share of actual values within the interval, its lower end clipped at 0."""
    joined = pairs.join(widths, by)
    inside = (F.col("actual") >= F.greatest(F.lit(0.0), F.col("forecast") - F.col("width"))) & (F.col("actual") <= F.col("forecast") + F.col("width"))
    return joined.groupBy(*by, "level").agg(round_half_away(F.avg(F.when(inside, 1.0).otherwise(0.0))).alias("coverage"))


def scaled_errors(pairs: DataFrame, scales: DataFrame, by: list[str], series: str = "series_id") -> DataFrame:
    """Signed bias as a share of what was, and the mean absolute error by the series' mean step (MASE); null over 0."""
    exact = (F.col("forecast") - F.col("actual")).cast("decimal(20,4)")
    total = F.sum("actual")
    sums = pairs.groupBy(*by).agg(round_half_away(F.when(total != 0, F.sum(exact).cast("double") / total)).alias("bias_share"), round_half_away(F.sum(F.abs(exact)).cast("double") / F.count(F.lit(1))).alias("mae"))
    return sums.join(scales.select(series, "scale"), series, "left").select(*by, "bias_share", "mae", "scale", round_half_away(F.when(F.col("scale") > 0, F.col("mae") / F.col("scale"))).alias("mase"))
