"""Jump consistent hashing of rows to shards, with gapless slots inside each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump hash of 64-bit keys, vectorised; no ring table."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.float64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jump[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[live] = np.floor((at[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        live = live[jump[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a stable 64-bit key."""

    @F.pandas_udf("int")
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64).view(np.uint64), shards))

    return apply(key)


def assign_shards(documents: DataFrame, shards: int = 24, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and next shard of every row, by the law ``key``.

    The shard depends on the id and the number of shards alone, so appending a
    shard moves only the rows that go into it (``grown_shard``).  ``slot``
    numbers the rows of a shard without gaps from 0: each shard is cut into
    ``buckets`` hash buckets, which are numbered apart and then shifted by the
    sizes of those before, so that no shard is sorted by one task.  The shifts
    are a table of ``shards * buckets`` rows at most.

    A null text has no bytes (size 8, CRC of nothing); a very long one counts
    whole; a null id is a key like any other; repeated rows get slots of their
    own; an empty table gives an empty one; other columns are ignored,
    whatever their names.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = documents.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    placed = sized.select(
        "doc_id", "size", "text_crc32", shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.join(F.broadcast(shifts), ["shard", "bucket"])
        .withColumn("slot", (F.col("shift") + F.row_number().over(inside) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )
