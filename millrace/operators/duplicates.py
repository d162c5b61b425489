"""Duplicates of several types in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import key_digest


@dataclass(frozen=True)
class DuplicateType:
    """Rows whose ``basis`` agrees are candidates of this type; a null basis is none."""

    name: str
    severity: str
    basis: Column


def tagged_keys(rows: DataFrame, dataset: str, record: Column, types: Sequence[DuplicateType]) -> DataFrame:
    """A row for each record and type: dataset, duplicate_type, severity, match_basis, record_id.  One scan, no shuffle."""
    each = F.array(*[F.struct(F.lit(t.name).alias("duplicate_type"), F.lit(t.severity).alias("severity"), t.basis.cast("string").alias("match_basis")) for t in types])
    tagged = rows.select(record.cast("string").alias("record_id"), F.inline(each))
    return tagged.where("match_basis IS NOT NULL").select(F.lit(dataset).alias("dataset"), "duplicate_type", "severity", "match_basis", "record_id")


def duplicate_candidates(tagged: DataFrame) -> DataFrame:
    """Groups of two or more rows with the number of their rows, a stable id and what to do.

    All types of all datasets are one aggregation that counts before it moves,
    so a basis that very many rows share moves as a few numbers; nobody's
    members are gathered in a cell.
    """
    groups = tagged.groupBy("dataset", "duplicate_type", "severity", "match_basis").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return groups.withColumn("group_id", key_digest("DUP-", 12, F.col("dataset"), F.col("duplicate_type"), F.col("match_basis"))).withColumn("recommended_action", F.lit("review_source_records"))


def candidate_members(tagged: DataFrame, candidates: DataFrame) -> DataFrame:
    """group_id and record_id of every row of a group, as rows, however large the group."""
    keys = ["dataset", "duplicate_type", "match_basis"]
    return tagged.join(candidates.select(*keys, "group_id"), keys).select("group_id", "record_id")
