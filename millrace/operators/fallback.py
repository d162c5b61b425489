"""Sources that stand in for others, decided inside the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_with_rows(*frames: DataFrame) -> DataFrame:
    """The rows of the first of ``frames`` that has any, by name.

    Whether an earlier one has rows is a subquery of one row in the same
    plan: no action runs in the driver, and Spark reads no more of it than a row.
    """
    out, taken = None, None
    for frame in frames:
        own = frame if taken is None else frame.where(~taken)
        some = frame.select(F.lit(1).alias("some")).limit(1).exists()
        taken = some if taken is None else taken | some
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("at least one source is needed")
    return out
