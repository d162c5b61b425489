"""Scalar building blocks.  Every function takes and returns columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, and 0 where the denominator is null, zero or negative."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    """Null stays null."""
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def round_half_away(x: Column, digits: int = 4) -> Column:
    """Half away from zero on the binary value, which other engines reproduce with floor alone.

    Spark's floor is a long and ends at 2^63; ``y - 1`` is the larger only
    beyond that, where every double is whole and equal to its ``y - 1``.
    """
    scale = float(10**digits)
    y = F.abs(x) * scale + 0.5
    return F.signum(x) * F.greatest(F.floor(y).cast("double"), y - 1) / scale


def exact_mean(x: Column, digits: int = 4) -> Column:
    """Mean of values with ``digits`` places, summed as decimals: the order of rows never moves a tie."""
    return F.sum(x.cast(f"decimal(24,{digits})")).cast("double") / F.count(x)


def bounded_ratio(top: Column, bottom: Column) -> Column:
    return clamp01(safe_ratio(top, bottom))


def weighted_score(parts: dict[str, float]) -> Column:
    """Clamped sum of clamped components times weights; an absent component counts 0."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.coalesce(clamp01(F.col(name)), F.lit(0.0)) * weight
    return clamp01(total)


def band(x: Column, floors: list[tuple[float, str]], other: str) -> Column:
    """The label of the first floor that ``x`` reaches."""
    first, *rest = floors
    out = F.when(x >= first[0], first[1])
    for floor, label in rest:
        out = out.when(x >= floor, label)
    return out.otherwise(other)


def clean(x: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(x), F.lit(""))


def normalise_text(x: Column) -> Column:
    """Trimmed lower case with plain quotes and dashes; other signs become single spaces.

    Compatibility forms beyond ASCII are not folded: that has no built-in, and
    the library's queries have ASCII text only.
    """
    plain = F.translate(F.lower(F.trim(x)), "‘’‐–—", "''---")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\w\s#'-]", " "), r"\s+", " "))


def key_digest(prefix: str, length: int, *parts: Column) -> Column:
    """A short stable id of pipe-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def minutes_of_day(text: Column) -> Column:
    """Minutes of ``HH:MM``; null where it is not a time."""
    parts = F.split(text, ":")
    return F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")


def discount_factor(rate: Column, year: Column) -> Column:
    return F.lit(1.0) / F.pow(F.lit(1.0) + rate, year)


def benefit_ramp(year: Column, delay: Column, years: Column) -> Column:
    """0 until the delay is over, then rising to 1 over ``years``."""
    return F.when(year <= delay, F.lit(0.0)).otherwise(F.least(F.lit(1.0), safe_ratio(year - delay, years)))


def direction_holds(name: Column, value: Column, limit: Column) -> Column:
    """Limits named ``minimum_*`` hold from below, all others from above."""
    return F.when(name.startswith("minimum_"), value >= limit).otherwise(value <= limit)


def strict_cast(x: Column, kind: str) -> Column:
    """A cast that stops the query at a value which is not of that kind; null stays null."""
    value = x.try_cast(kind)
    return F.when(x.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"not a {kind}: "), x.cast("string"))).cast(kind)).otherwise(value)


def ordinal(x: Column, names: list[str]) -> Column:
    """The place of a name in an ordered list, from 1; null for a name that isn't there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), x).cast("int"), F.lit(0))
