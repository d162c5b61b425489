"""Rows appended to a table that may have other columns, and replaced where their run is there already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import strict_cast

PROVENANCE = [T.StructField("source_file_name", T.StringType()), T.StructField("source_row_number", T.LongType()), T.StructField("ingestion_run_id", T.StringType()), T.StructField("source_checksum", T.StringType())]
STAGED = [T.StructField("record_status", T.StringType()), T.StructField("warning_reason", T.StringType()), T.StructField("normalised_name", T.StringType())]


def layer_schema(contract: T.StructType, layer: str) -> T.StructType:
    """The schema of a dataset in a layer: ``source`` has text as it came and where from, ``staging`` and ``curated`` the contract's types, how each row was judged, and where from."""
    if layer == "source":
        return T.StructType([*[T.StructField(f.name, T.StringType()) for f in contract.fields], *PROVENANCE])
    if layer in ("staging", "curated"):
        return T.StructType([*contract.fields, *STAGED, *PROVENANCE])
    raise ValueError(f"no such layer: {layer}")


def column_differences(rows: DataFrame, schema: T.StructType) -> dict[str, list[str]]:
    """Columns that only the rows have (``dropped``) and that only the table has (``missing``), by name without case."""
    mine, theirs = {c.lower() for c in rows.columns}, {c.lower() for c in schema.names}
    return {"dropped": [c for c in rows.columns if c.lower() not in theirs], "missing": [c for c in schema.names if c.lower() not in mine]}


def aligned(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` with the columns of ``schema``, in its order and types.

    Columns are matched by name, without case; others of the rows go, and
    those that the rows lack are null.  A value that is not of the table's type
    stops the query, as does a row that lacks what may not be null.  Two columns of the rows with one name are an error.
    """
    names = [c.lower() for c in rows.columns]
    if len(names) != len(set(names)):
        raise ValueError("two columns of the rows have one name")
    at = {c.lower(): c for c in rows.columns}
    kinds = {f.name.lower(): f.dataType for f in rows.schema.fields}
    out = []
    for f in schema.fields:
        k = f.name.lower()
        if k not in at:
            if not f.nullable:
                raise ValueError(f"the rows have no column {f.name}, which may not be null")
            value = F.lit(None).cast(f.dataType)
        elif kinds[k] == f.dataType or not isinstance(f.dataType, T.AtomicType):
            value = F.col(f"`{at[k]}`").cast(f.dataType)
        else:
            value = strict_cast(F.col(f"`{at[k]}`"), f.dataType.simpleString())
        if k in at and not f.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return rows.select(*out)


def append_run(rows: DataFrame, path: str, run_columns: Sequence[str], schema: T.StructType | None = None) -> dict[str, list[str]]:
    """Writes ``rows`` to the Parquet table at ``path``, whose folders are the values of ``run_columns``; tells the columns that were dropped or missing.

    The folders of the runs that ``rows`` has are replaced and all others stay,
    so a run that is written twice, or that stopped halfway, is there once.
    The schema is the table's, or ``schema`` for a table that is not there yet.
    """
    spark = rows.sparkSession
    found = schema if schema is not None else spark.read.parquet(path).schema
    told = column_differences(rows, found)
    aligned(rows, found).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run_columns).parquet(path)
    return told
