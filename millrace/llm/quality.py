"""Quality rules whose thresholds adapt to each language and source.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_SPACE = r"[ \x09-\x0D]+"
_WORD = r"[^ \x09-\x0D]"
#: Metric: least spread, and whether low values are as odd as high ones.
METRICS = {"symbol_ratio": (0.01, False), "dup_line_ratio": (0.05, False), "repeat_ratio": (0.03, False), "mean_word": (0.25, True)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.transform(F.array(value), body)[0]


def _paired(hashes: Column, step: int) -> Column:
    """Hashes of twice as long windows, from those of windows ``step`` apart."""
    n = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more."""

    def positions(ordered: Column) -> Column:
        def flag(x: Column, k: Column) -> Column:
            before, after = F.get(ordered, k - 1), F.get(ordered, k + 1)
            same = (before["h"] == x["h"]) | (after["h"] == x["h"])
            return F.when(F.coalesce(same, (before["h"] == x["h"]), (after["h"] == x["h"])), x["i"])

        return F.sort_array(F.filter(F.transform(ordered, flag), lambda x: x.isNotNull()))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(at, k + 1) - x, F.lit(8)))), F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(ordered, lambda o: _let(positions(o), total))


def _repeated_words(words: Column) -> Column:
    """``words`` is an array of at least eight words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(
        hashes, lambda a: _let(_paired(a, 1), lambda b: _let(_paired(b, 2), lambda c: _let(_paired(c, 4), lambda d: F.when(F.size(F.array_distinct(d)) < F.size(d), _covered(d)).otherwise(F.lit(0).cast("long")))))
    )


def text_metrics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts of every whole text; a null text has no words."""
    split = documents.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).select(
        "doc_id", "lang", "source",
        F.filter(F.split("text", _SPACE), lambda w: w != "").alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("lines"),
    )
    return split.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 8, _repeated_words(F.col("words"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


#: Ratio of neighbouring bin edges of the quantile sketches: quantiles are right to one per cent.
GAMMA = 1.02
_PER_BIN = 1 / math.log(GAMMA)
_ZERO = -1_000_000


def _bin(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.log(x) * F.lit(_PER_BIN)).cast("int")).otherwise(F.lit(_ZERO))


def _fences(sketch: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """Per key and metric: n, low and high, from the merged bins."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("total", F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))), F.col("bin")))
    value = lambda b: F.when(F.col(b) == _ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col(b) - 0.5))
    found = ranked.groupBy(*keys, "metric").agg(F.first("total").alias("n"), at(0.05).alias("q05"), at(0.5).alias("q50"), at(0.95).alias("q95"))
    least = F.create_map(*[F.lit(x) for m, (wide, _) in METRICS.items() for x in (m, wide)])[F.col("metric")]
    return found.select(*keys, "metric", "n", (value("q50") - spread * F.greatest(value("q50") - value("q05"), least)).alias("low"), (value("q50") + spread * F.greatest(value("q95") - value("q50"), least)).alias("high"))


def thresholds(measured: DataFrame, weight: float = 100.0, spread: float = 6.0) -> DataFrame:
    """Fences of each metric for each language and source, from mergeable quantile sketches.

    A sketch counts values in bins of equal ratio, so it holds at most some
    thousand numbers for a group, merges by adding and does not depend on the
    order or the place of rows.  A fence lies ``spread`` times the distance
    from the median to the outer 5 % away from the median.  The fences of a
    group of n documents count n / (n + ``weight``), the rest are those of its
    language, which lean on those of all documents in the same way.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS]))
    bins = measured.select("lang", "source", each.alias("m")).where(F.col("m.x").isNotNull()).select("lang", "source", "m.metric", _bin(F.col("m.x")).alias("bin"))
    sketch = written(bins.groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n")), "quality-sketches")
    group, lang, every = _fences(sketch, ["lang", "source"], spread).alias("g"), _fences(sketch, ["lang"], spread).alias("l"), _fences(sketch, [], spread).alias("a")
    joined = group.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.metric") == F.col("l.metric"))).join(every, F.col("g.metric") == F.col("a.metric"))

    def shrunk(side: str) -> Column:
        share = lambda t: F.col(f"{t}.n").cast("double") / (F.col(f"{t}.n") + F.lit(weight))
        of_lang = share("l") * F.col(f"l.{side}") + (1.0 - share("l")) * F.col(f"a.{side}")
        return share("g") * F.col(f"g.{side}") + (1.0 - share("g")) * of_lang

    fences = joined.select("g.lang", "g.source", "g.metric", shrunk("low").alias("low"), shrunk("high").alias("high"))
    wide = fences.groupBy("lang", "source").pivot("metric", list(METRICS)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    return written(wide, "quality-thresholds")


def quality_verdicts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """Base counts, base rule and adaptive verdict of every document.

    The counts are written once, sketched by (language, source) and joined to
    the fences that follow from them.  Only documents that pass the base rule
    are sketched.  The verdict depends on the rows alone, not on their order.  A null language or source is a group like any other; a null
    or empty text has no words and fails the base rule; repeated rows each
    keep theirs; no rows give no rows; other columns are ignored,
    whatever their names; a very long text is one row's arrays of its words.
    """
    counts = text_metrics(documents, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = written(counts.withColumn("base_failed", failed), "quality-counts")
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    measured = counts.withColumns(
        {"symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word": ratio("word_chars", "n_words")}
    )
    fences = thresholds(measured.where(~F.col("base_failed")), **options).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if METRICS[m][1]:
            inside &= F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
