"""Issues that a manifest declares against those that the rules find."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ISSUE = "issue_id string, dataset string, record_identifier string, issue_type string, expected_detection_milestone string, intentional boolean"
MANIFEST = f"metadata map<string, string>, issues array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _ISSUE.split(', '))}>>"
_KEYS = ["dataset", "record_id", "issue_type"]


def read_declared(spark: SparkSession, path: str) -> DataFrame:
    """The issues of JSON manifests (an object with a list ``issues``), a row each, with the file they stand in.  A manifest without the list, or that is no JSON, stops the query."""
    read = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    listed = F.when(F.col("issues").isNull(), F.raise_error(F.concat(F.lit("no issues in "), F.col("_metadata.file_name")))).otherwise(F.col("issues"))
    rows = read.select(F.col("_metadata.file_name").alias("source_file_name"), F.explode(listed).alias("issue")).select("source_file_name", "issue.*")
    return rows.withColumnRenamed("record_identifier", "record_id")


def compared(declared: DataFrame, found: DataFrame) -> DataFrame:
    """dataset, record_id, issue_type, declared, found and verdict: ``found``, ``missed`` or ``undeclared``.

    Both sides have the three keys; each is counted by key before they meet in
    one full outer join, so an issue told twice is one row with its numbers.  Null keys are keys.
    """
    left = declared.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("declared"))
    right = found.groupBy(*[F.col(k).alias(f"f_{k}") for k in _KEYS]).agg(F.count(F.lit(1)).alias("found"))
    cond = F.lit(True)
    for k in _KEYS:
        cond &= F.col(k).eqNullSafe(F.col(f"f_{k}"))
    both = left.join(right, cond, "full_outer")
    key = [F.when(F.col("declared").isNotNull(), F.col(k)).otherwise(F.col(f"f_{k}")).alias(k) for k in _KEYS]
    verdict = F.when(F.col("found").isNull(), "missed").when(F.col("declared").isNull(), "undeclared").otherwise("found")
    return both.select(*key, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found"), verdict.alias("verdict"))


def detected(declared: DataFrame, statuses: DataFrame, candidates: DataFrame, by_row: Sequence[str], by_dataset: Sequence[str], warning: str = "accepted_with_warning") -> DataFrame:
    """Each declared issue with ``detected``.

    An issue of a type in ``by_row`` is detected if its record has the status
    ``warning`` in ``statuses`` (dataset, record_id, record_status); one of a
    type in ``by_dataset`` if its record is there and its dataset has any
    duplicate in ``candidates``.  Others, and those of records that are not there, are not.
    """
    own = statuses.groupBy(F.col("dataset").alias("s_dataset"), F.col("record_id").alias("s_record")).agg(F.max((F.col("record_status") == warning).cast("int")).alias("warned"))
    twice = candidates.select(F.col("dataset").alias("d_dataset")).distinct()
    joined = declared.join(own, (F.col("dataset") == F.col("s_dataset")) & (F.col("record_id") == F.col("s_record")), "left").join(twice, F.col("dataset") == F.col("d_dataset"), "left")
    there = F.col("s_record").isNotNull()
    hit = F.when(F.col("issue_type").isin(*by_dataset), there & F.col("d_dataset").isNotNull()).when(F.col("issue_type").isin(*by_row), there & (F.col("warned") == 1))
    return joined.withColumn("detected", F.coalesce(hit, F.lit(False))).drop("s_dataset", "s_record", "warned", "d_dataset")


def with_intentional(issues: DataFrame, declared: DataFrame) -> DataFrame:
    """Issue rows (dataset, record_id) with the id of the intentional issue that the manifest declares for the record, if any: the smallest."""
    own = declared.where("intentional").groupBy(F.col("dataset").alias("i_dataset"), F.col("record_id").alias("i_record")).agg(F.min("issue_id").alias("intentional_issue_id"))
    return issues.join(own, (F.col("dataset") == F.col("i_dataset")) & (F.col("record_id") == F.col("i_record")), "left").drop("i_dataset", "i_record")
