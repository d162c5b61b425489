"""Delimited files under a contract: rows numbered by all tasks, and rows that break the contract told apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = ["source_file_name", "split_start"]


@dataclass(frozen=True)
class Reading:
    """``rows`` keep the contract; ``rejects`` are the others, each with its raw line and all its reasons."""

    rows: DataFrame
    rejects: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, source_file_name, source_row_number of every line with text, numbered from 1 in each file.

    Files are read in splits.  Each split's lines are counted where they are
    read; a running sum over the splits of a file, one row each, says where
    a split begins, and a line's number follows from its place in the split.
    No file is ordered, shuffled or read by one task.  A blank line is no row.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias(_SPLIT[0]), F.col("_metadata.file_block_start").alias(_SPLIT[1]), F.monotonically_increasing_id().alias("place"))
    text = F.trim(F.regexp_replace("line", "[\\r\\x{FEFF}]", ""))
    # the place of a line counts blank ones too, so numbers are places among all lines less the blank lines before
    marked = lines.withColumn("blank", (text == "").cast("long"))
    splits = marked.groupBy(*_SPLIT).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("blank").alias("blanks"))
    before = Window.partitionBy(_SPLIT[0]).orderBy(_SPLIT[1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*[F.col(c).alias(f"of_{c}") for c in _SPLIT], "first", "blanks", F.coalesce(F.sum(F.col("n") - F.col("blanks")).over(before), F.lit(0)).alias("start"))
    joined = marked.join(starts, (F.col(_SPLIT[0]) == F.col(f"of_{_SPLIT[0]}")) & (F.col(_SPLIT[1]) == F.col(f"of_{_SPLIT[1]}")))
    dense = joined.where("blank = 0 AND blanks = 0").withColumn("at", F.col("place") - F.col("first"))
    # only splits that hold blank lines have their lines ordered
    inside = Window.partitionBy(*_SPLIT).orderBy("place")
    gapped = joined.where("blank = 0 AND blanks > 0").withColumn("at", F.row_number().over(inside).cast("long") - 1)
    return dense.unionByName(gapped).select("line", _SPLIT[0], (F.col("start") + F.col("at") + 1).alias("source_row_number"))


def conform(lines: DataFrame, schema: T.StructType, line: str = "line", sep: str = ",") -> DataFrame:
    """``lines`` with a struct ``record`` of the contract's types and ``problems``, the reasons why a line breaks it.

    Values are trimmed and empty ones null.  Reasons are ``width`` (other than
    the contract's number of values), ``open_quote`` (a quoted value that goes
    beyond its line), ``<column>:missing`` where the contract allows no null,
    and ``<column>:<type>`` for a value that is not of the type; such a value is null in the record.
    """
    texts = T.StructType([*[T.StructField(f"v{k}", T.StringType()) for k in range(len(schema.fields))], T.StructField("broken", T.StringType())])
    parsed = F.from_csv(line, texts.simpleString()[7:-1].replace(":", " "), {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    open_quote = F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1

    def judged(p: Column) -> Column:
        reasons: list[Column] = [F.when(open_quote, F.lit("open_quote")), F.when(p["broken"].isNotNull(), F.lit("width"))]
        values = []
        for k, f in enumerate(schema.fields):
            text = F.nullif(F.trim(p[f"v{k}"]), F.lit(""))
            value = text.try_cast(f.dataType)
            reasons.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{f.name}:{f.dataType.simpleString()}")))
            if not f.nullable:
                reasons.append(F.when(text.isNull(), F.lit(f"{f.name}:missing")))
            values.append(value.alias(f.name))
        return F.struct(F.struct(*values).alias("record"), F.array_compact(F.array(*reasons)).alias("problems"))

    # a generator of one row, so that a line is parsed once however often its parts are used
    return lines.select("*", F.inline(F.transform(F.array(parsed), judged)))


def _body(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame:
    """Numbered lines after the headers; a first line that is not the contract's header stops the query."""
    header = sep.join(schema.names)
    first = spark.read.text(path).limit(1).first()
    if first is None or first[0].strip("\ufeff\r") != header:
        raise ValueError(f"header of {path} is not {schema.names}")
    ok = (F.col("source_row_number") > 1) | (F.regexp_replace("line", "[\\r\\x{FEFF}]", "") == header)
    # on both columns, as Spark may look at either first when it drops rows
    wrong = F.raise_error(F.concat(F.lit("header is not the contract's: "), F.col("source_file_name")))
    checked = numbered_lines(spark, path).select(
        F.when(ok, F.regexp_replace("line", "\\r$", "")).otherwise(wrong.cast("string")).alias("line"), "source_file_name", F.when(ok, F.col("source_row_number")).otherwise(wrong.cast("long")).alias("source_row_number")
    )
    return checked.where("source_row_number > 1")


def read_contract(spark: SparkSession, path: str, schema: T.StructType, run_id: str, checksums: DataFrame | None = None, sep: str = ",") -> Reading:
    """The files at ``path`` under ``schema``, with where each row came from.

    Both parts have source_file_name, source_row_number (from 2, after the
    header), ingestion_run_id and source_checksum, which ``checksums`` (name,
    sha256), such as a manifest or ``file_digests``, gives by file; without it it is
    null.  Quoted values may hold separators, not line ends.
    """
    found = conform(_body(spark, path, schema, sep), schema, sep=sep).withColumn("ingestion_run_id", F.lit(run_id))
    if checksums is None:
        found = found.withColumn("source_checksum", F.lit(None).cast("string"))
    else:
        own = checksums.select(F.col("name").alias("checksum_of"), F.col("sha256").alias("source_checksum"))
        found = found.join(own, F.col("source_file_name") == F.col("checksum_of"), "left")
    origin = ["source_file_name", "source_row_number", "ingestion_run_id", "source_checksum"]
    fine = F.size("problems") == 0
    return Reading(found.where(fine).select("record.*", *origin), found.where(~fine).select(F.col("line").alias("raw_line"), F.array_join("problems", ";").alias("reasons"), *origin))


def read_lenient(spark: SparkSession, path: str, schema: T.StructType, run_id: str, sep: str = ",") -> DataFrame:
    """All rows, with null for values that are not of their type."""
    found = conform(_body(spark, path, schema, sep), schema, sep=sep)
    return found.select("record.*", "source_file_name", "source_row_number", F.lit(run_id).alias("ingestion_run_id"))
