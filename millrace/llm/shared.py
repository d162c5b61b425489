"""Where intermediate tables live, and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine, as in tests, a
    local folder is made and set as the checkpoint folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage.

    The shuffle files of the write go when it ends: nothing reads them again.
    """
    return _write(df, new_path(df.sparkSession, name))


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run, emptied as soon as all that is made from them is written too."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = new_path(self.spark, f"{self.name}-{name}")
        return _write(df, self.paths[name])

    def clear(self, *names: str) -> None:
        for name in names:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(self.paths.pop(name))


#: Bytes of text that a task holds as one Arrow batch, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes too, as ten thousand rows of long texts are too many; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not (now.rstrip("b").isdigit() and int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``step`` on each Arrow batch of ``df``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)
        pa.default_memory_pool().release_unused()  # workers outlive tasks

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


class Bits:
    """A table of bits that is indexed like an array of booleans."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __getitem__(self, at):
        return (self.data[at >> 3] >> (at & 7) & 1).astype(bool)

    def any(self) -> bool:
        return bool(self.data.any())


def bitmap(df: DataFrame, slot: str, bits: int) -> Bits:
    """A table of ``2 ** bits`` bits, set at the values of the column ``slot``.

    Built by Spark's bitmap aggregates; at most ``2 ** bits / 32768`` rows of
    4 KB reach the driver, whatever the input.
    """
    at = F.col(slot).cast("long") + 1
    rows = df.where(F.col(slot).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros(max(1 << bits, 32768) >> 3, np.uint8)
    for r in rows.toLocalIterator():
        own = np.frombuffer(bytes(r.m), np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return Bits(out)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
