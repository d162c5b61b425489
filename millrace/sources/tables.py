"""Reading and writing tables: the test tables, contracts for CSV, and guarded output."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contract import read_lenient


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_contract_csv(spark: SparkSession, path: str, schema: T.StructType, run_id: str) -> DataFrame:
    """A CSV file whose header must be the schema's, with where each row came from.

    Row numbers start at 2, after the header, in the order of each file; all
    values are trimmed; empty ones, and those that are not of their type, are
    null (``contract.read_contract`` tells such rows apart).
    """
    return read_lenient(spark, path, schema, run_id)


def write_once(df: DataFrame, path: str, rebuild: bool = False) -> None:
    """Parquet that is not overwritten unless asked for."""
    df.write.mode("overwrite" if rebuild else "errorifexists").parquet(path)


def census(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Rows of each table, as one union of counts."""
    out = None
    for n in names:
        part = table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Name, length and SHA-256 of each file; for source files, each of which fits a task's memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def manifest_errors(spark: SparkSession, folder: str, manifest: DataFrame, pattern: str = "*") -> DataFrame:
    """Files that are missing, not listed, or not what the manifest (name, sha256) says."""
    found = file_digests(spark, folder, pattern).select("name", F.col("sha256").alias("found"))
    both = manifest.select("name", F.col("sha256").alias("listed")).join(found, "name", "full_outer")
    error = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "not_listed").when(F.col("found") != F.col("listed"), "changed")
    return both.select("name", error.alias("error")).where("error is not null")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Each table as a temporary view."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def read_only_sql(spark: SparkSession, query: str, **values) -> DataFrame:
    """One SELECT or WITH over the registered views; values are bound as parameters, never pasted."""
    plain = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", query, flags=re.S).strip()
    if ";" in plain or not re.match(r"(?i)(select|with)\b", plain) or re.search(r"(?i)\b(insert|update|delete|merge|drop|create|alter|truncate|set|load|cache)\b", plain):
        raise ValueError("only one SELECT is allowed")
    return spark.sql(query, args=values)


def columns_of(spark: SparkSession, names: list[str]) -> DataFrame:
    """Names, types and places of the columns of registered views."""
    rows = [(n, f.name, f.dataType.simpleString(), k) for n in names for k, f in enumerate(spark.table(n).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, place int")


def export_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A report table as one CSV file with a header, in a total order."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def export_json(df: DataFrame, path: str, order: list[str]) -> None:
    """The same as JSON lines, keys in the order of their names."""
    df.select(*sorted(df.columns)).orderBy(*order).coalesce(1).write.mode("errorifexists").json(path)
