"""Token counts with a cache keyed by the digests of content and of the tokenizer's version."""

from __future__ import annotations

import hashlib
import importlib.metadata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, shared_dir
from .textnp import blocks, string_bytes

_SCHEMA = "content string, tokenizer string, n_tokens long"


@cache
def _tokenizer(path: str):
    """Function from texts to token counts, one for each worker process."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return lambda texts: [len(x.ids) for x in found.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library's version, which together fix the counts."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _encode(batch: pa.RecordBatch, path: str, version: str) -> pa.RecordBatch:
    count = _tokenizer(path)
    texts, n = batch.column("text"), batch.num_rows
    _, off = string_bytes(texts)
    out = np.zeros(n, np.int64)
    for a, b in blocks(off):  # bounded token lists
        out[a:b] = count([x or "" for x in texts.slice(a, b - a).to_pylist()])
    return pa.RecordBatch.from_arrays([batch.column("content"), pa.array([version] * n, pa.string()), pa.array(out)], ["content", "tokenizer", "n_tokens"])


def _known(spark, cache_dir: str, version: str) -> DataFrame | None:
    """Counts of a tokenizer's version in the cache; none where there is no cache yet."""
    try:
        table = spark.read.schema(_SCHEMA).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return table.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, tokenizer: str, cache_dir: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text; texts that the cache knows are not encoded again.

    ``cache_dir`` holds a Parquet table (content, tokenizer, n_tokens), by
    default one in the shared folder, of this tokenizer's version, that later
    runs find again.  Content is named by the SHA-256
    of its bytes: tokenizers normalise in ways of their own, so any other
    normalisation could change a count.  One row of each content that is
    missing under this tokenizer's version is encoded, its count appended, and
    all counts are then read from the table; if a job is repeated, the worst
    that happens is a pair that is there twice, and reads take each pair once.

    A null text counts as empty and has no tokens; a very long one is encoded
    whole; copies share one encoding, and repeated rows each have their row;
    an empty table appends nothing; other columns are ignored, whatever their
    names.  Returns
    doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    """
    spark = documents.sparkSession
    version = tokenizer_version(tokenizer)
    cache_dir = cache_dir or f"{shared_dir(spark)}/millrace/token-cache/{version[:16]}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = documents.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    known = _known(spark, cache_dir, version)
    missing = named if known is None else named.join(known, "content", "left_anti")
    # one row of each content; copies are combined before the shuffle
    first = missing.groupBy("content").agg(F.first("text").alias("text"))
    encoded = map_batches(first, lambda b: _encode(b, tokenizer, version), _SCHEMA)
    encoded.write.mode("append").parquet(cache_dir)
    counted = named.drop("text").join(_known(spark, cache_dir, version), "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
