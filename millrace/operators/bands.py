"""Values joined to the interval that covers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name


def band_join(rows: DataFrame, value: Column, bands: DataFrame, start: str = "start", end: str = "end", width: int = 60, strict: bool = True) -> DataFrame:
    """``rows`` with the columns of each band [start, end) that covers the whole number ``value``.

    Bands are cut at cells of ``width`` and rows go to theirs, so this is a join on a
    key with the bounds checked beside it, for any number of bands, never a
    loop over all of them.  A value that no band covers stops the query, or has
    nulls if not ``strict``; so has a null value.  A band that ends where it starts covers nothing.
    """
    cell, at = free_name("cell", rows, bands), free_name("band_value", rows, bands)
    of = free_name("band_cell", rows, bands)
    cells = bands.where(F.col(end) > F.col(start)).withColumn(of, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    placed = rows.withColumn(at, value.cast("long")).withColumn(cell, F.floor(F.col(at) / width))
    covered = (F.col(cell) == F.col(of)) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    out = placed.join(cells, covered, "left")
    if strict:
        none = F.raise_error(F.concat(F.lit("no band covers "), F.coalesce(F.col(at).cast("string"), F.lit("null"))))
        out = out.withColumn(of, F.when(F.col(of).isNull(), none.cast("long")).otherwise(F.col(of))).where(F.col(of) > F.lit(-(2**62)))
    return out.drop(cell, at, of)
