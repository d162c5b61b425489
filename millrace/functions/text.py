"""Text functions that have no built-in, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import normalise_text


@F.pandas_udf("string")
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf("double")
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def normalise_unicode(x: Column) -> Column:
    """:func:`normalise_text` after compatibility folding; ASCII texts pass as they are."""
    return normalise_text(_nfkc(x))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the normalised texts; null where one is null."""
    return _ratio(normalise_unicode(a), normalise_unicode(b))
