"""Queues of arrivals at resources: replications with drawn service times, then measures.  Columns and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, round_half_away, safe_ratio
from .prefix import numbered_rows

#: Times are exact to four places, so that no order of sums moves them.
_MINUTES = "decimal(18,4)"


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 48 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[x.cast("string") for x in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    """The quantile ``u`` of a triangular distribution."""
    width = high - low
    rising, falling = F.lit(low) + F.sqrt(u * (width * (mode - low))), F.lit(high) - F.sqrt((F.lit(1.0) - u) * (width * (high - mode)))
    return F.when(u < (mode - low) / width, rising).otherwise(falling)


def replicate(arrivals: DataFrame, replications: int, opening: float, closing: float, service: tuple[float, float, float], by: tuple[str, ...] = ("resource",)) -> DataFrame:
    """First come, first served at each resource: arrival, start, end and wait of every contact, by replication.

    ``arrivals`` has the columns ``by``, contact and minute.  One queue is a
    combination of ``by`` in a replication, such as a resource on a day; the
    service time of a contact, in hundredths of a minute, is drawn from its names
    alone.  With S the
    running sum of service times, a contact starts at the largest of all
    a(j) - S(j - 1) up to it, plus S of the contact before: running windows,
    which hold no queue in memory.
    """
    each = arrivals.withColumn("replication", F.explode(F.sequence(F.lit(1), F.lit(replications))))
    names = [*by, "replication"]
    service_time = round_half_away(triangular(drawn(*[F.col(k) for k in names], F.col("contact")), *service), 2).cast(_MINUTES)
    each = each.select(*names, "contact", F.col("minute").cast(_MINUTES).alias("arrival"), service_time.alias("service"))
    queue = Window.partitionBy(*names).orderBy("arrival", "contact")
    so_far = queue.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = each.withColumn("before", (F.sum("service").over(so_far) - F.col("service")).cast(_MINUTES))
    start = F.max((F.greatest("arrival", F.lit(opening).cast(_MINUTES)) - F.col("before")).cast(_MINUTES)).over(so_far) + F.col("before")
    timed = summed.withColumn("start", start).withColumn("end", F.col("start") + F.col("service"))
    plain = lambda c: c.cast("double")
    over = F.greatest(F.lit(0.0), plain(F.col("end") - F.lit(closing).cast(_MINUTES)))
    return timed.select(*names, "contact", plain(F.col("arrival")).alias("arrival"), plain(F.col("start")).alias("start"), plain(F.col("end")).alias("end"), plain(F.col("start") - F.col("arrival")).alias("wait"), over.alias("overtime"))


def queue_measures(events: DataFrame, by: list[str]) -> DataFrame:
    """Contacts, waits (mean, median, 95th percentile) and overtime."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("contacts"), round_half_away(exact_mean(F.col("wait"))).alias("mean_wait"), round_half_away(F.percentile("wait", 0.5)).alias("median_wait"),
        round_half_away(F.percentile("wait", 0.95)).alias("p95_wait"), round_half_away(F.max("overtime")).alias("max_overtime"),
    )


def resilience(measures: DataFrame, by: list[str], column: str, limit: float, z: float = 1.96) -> DataFrame:
    """Mean over replications with its normal interval, and how often the limit is passed."""
    spread = F.coalesce(F.stddev_samp(column), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))
    over = F.sum(F.when(F.col(column) > limit, 1).otherwise(0))
    return measures.groupBy(*by).agg(
        F.count(F.lit(1)).alias("replications"), round_half_away(F.avg(column)).alias("mean"), round_half_away(F.avg(column) - z * spread).alias("low"), round_half_away(F.avg(column) + z * spread).alias("high"), round_half_away(safe_ratio(over, F.count(F.lit(1)))).alias("failure_rate")
    )


def admit(events: DataFrame, by: list[str], order: list[str], capacity: int) -> DataFrame:
    """First-come admission: contacts beyond the capacity of their group are blocked; a group of any size is numbered by many tasks."""
    return numbered_rows(events, by, order, "place").withColumn("place", F.col("place").cast("int")).withColumn("blocked", F.col("place") > capacity)
