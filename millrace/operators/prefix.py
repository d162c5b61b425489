"""Running sums over ordered rows in two levels, so that no key and no table is summed by one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name

#: Sampled rows for each part.
_PER_PART = 16


def _joined(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """``small`` next to ``rows`` where all of ``on`` agree, nulls with nulls."""
    names = {c: free_name(f"{c}_of", rows, small) for c in on}
    cond = F.lit(True)
    for c, other in names.items():
        cond &= F.col(c).eqNullSafe(F.col(other))
    return rows.join(small.withColumnsRenamed(names), cond, how).drop(*names.values())


def in_parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], part: str, rows_per_part: int = 100_000, most_parts: int = 256) -> DataFrame:
    """``rows`` with an int column ``part`` that rises with ``order`` inside each key.

    The parts of a key are ranges between rows of a sample (about
    16 in ``rows_per_part``, chosen by the hash of key and order), of which a key
    keeps 16 x ``most_parts`` at most; a key too small to be sampled is one
    part.  ``part`` depends on the rows alone.  Rows that agree in all of
    ``order`` are in one part, so end it with a column that tells rows apart.
    Order is ascending, nulls first.
    """
    at, mark = free_name("at", rows), free_name("mark", rows)
    place = F.struct(*[F.col(c) for c in order])
    mark_of = F.xxhash64(F.lit(7), *[F.col(c) for c in (*keys, *order)])
    sample = rows.select(*keys, place.alias(at), mark_of.alias(mark)).where(F.pmod(F.col(mark), F.lit(max(1, rows_per_part // _PER_PART))) == 0)
    place_in = free_name("place", sample)
    few = sample.withColumn(place_in, F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(mark, at))).where(F.col(place_in) <= _PER_PART * most_parts)
    cuts = few.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias(at))
    cuts = cuts.withColumn(at, F.filter(at, lambda x, k: k % _PER_PART == _PER_PART - 1))
    return _joined(rows, cuts, keys, "left").withColumn(part, F.coalesce(F.size(F.filter(at, lambda x: x < place)), F.lit(0))).drop(at)


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], part: str | None = None, rows_per_part: int = 100_000) -> DataFrame:
    """``rows`` with, for each of ``totals``, its sum over the rows before in the order of the key.

    Each part of a key is summed (partly before it moves), the sums of the
    parts before are a running sum over a table of a row for each part, and
    rows are only ordered inside their part.  ``part`` names a column that
    rises with ``order`` inside each key; without it, ``in_parts`` makes one.
    Sums of whole numbers and decimals are exact; a null counts nothing.
    The first row of a key has 0.
    """
    made = part is None
    if made:
        part = free_name("part", rows)
        rows = in_parts(rows, keys, order, part, rows_per_part)
    rows = rows.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in totals.items()})
    before = {k: free_name(f"{k}_before", rows) for k in totals}
    sums = rows.groupBy(*keys, part).agg(*[F.sum(k).alias(before[k]) for k in totals])
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, part, *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before.values()])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(rows, offsets, [*keys, part], "inner").withColumns({k: F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(b) for k, b in before.items()})
    return out.drop(*before.values(), *[part] * made)


def numbered_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows_per_part: int = 100_000) -> DataFrame:
    """``rows`` with their number, from 1, in the order of their key (of the whole table without keys)."""
    return running_totals(rows, keys, order, {name: F.lit(1).cast("long")}, rows_per_part=rows_per_part).withColumn(name, F.col(name) + 1)


def carried_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], rows_per_part: int = 100_000) -> DataFrame:
    """``rows`` with each null of ``columns`` replaced by the last value before it in the order of the key.

    In two levels as ``running_totals``: the last value of each part, carried over
    the parts of the key, and rows ordered inside their part only.
    """
    part = free_name("part", rows)
    rows = in_parts(rows, keys, order, part, rows_per_part)
    place = F.struct(*[F.col(c) for c in order])
    names = {c: free_name(f"{c}_last", rows) for c in columns}
    lasts = rows.groupBy(*keys, part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(n) for c, n in names.items()])
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lasts.select(*keys, part, *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names.values()])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _joined(rows, offsets, [*keys, part], "inner")
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(n)) for c, n in names.items()}).drop(part, *names.values())
