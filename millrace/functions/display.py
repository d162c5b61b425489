"""How values are shown in reports and written to canonical files.  Every function takes and returns columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import round_half_away

MISSING = "n/a"


def _shown(x: Column, form: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(MISSING)).otherwise(form)


def number(x: Column, digits: int = 1) -> Column:
    """Thousands parted by commas, halves away from zero; ``n/a`` for null and NaN."""
    return _shown(x, F.format_number(round_half_away(x.cast("double"), digits), digits))


def integer(x: Column) -> Column:
    """The whole part, thousands parted by commas."""
    return _shown(x, F.format_number(x.cast("long"), 0))


def currency(x: Column, unit: str = "GBP") -> Column:
    return _shown(x, F.concat(F.lit(f"{unit} "), number(x, 0)))


def status_label(x: Column, labels: dict[str, str], missing: str = "insufficient_evidence") -> Column:
    """The label of a status, else its words with capitals; null and empty are ``missing``."""
    status = F.coalesce(F.nullif(x, F.lit("")), F.lit(missing))
    plain = F.initcap(F.lower(F.replace(status, F.lit("_"), F.lit(" "))))
    if not labels:
        return plain
    return F.coalesce(F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])[status], plain)


def canonical_value(frame: DataFrame, name: str) -> Column:
    """A column as it stands in a canonical file, by its type.

    Null is empty; truth is ``true`` or ``false``; dates and times are ISO;
    decimals have two places, floats at most four, without zeros at the end;
    all else is its text.
    """
    x, kind = F.col(name), frame.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # a formatted null would be the word null
        text = F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.4f", round_half_away(x.cast("double"), 4)), r"\.?0+$", ""))
    elif isinstance(kind, T.DecimalType):
        text = F.round(x, 2).cast("decimal(38,2)").cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit(""))


def display_name(frame: DataFrame, preferred: Sequence[str]) -> Column:
    """The first of the ``preferred`` columns that the frame has, else its first column, as text; null is empty."""
    own = {c.lower(): c for c in reversed(frame.columns)}
    name = next((own[c.lower()] for c in preferred if c.lower() in own), frame.columns[0])
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
