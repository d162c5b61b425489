import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm.sentencepieces import Encoder, decode, encode, load, occurrences, suffix_order

from .edge import awkward, documents

import numpy as np

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyzé日本語 \n\t.,0123456789AB▁  <>|­​😀"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(400)] + ["a" * 700, "=" * 999, " " * 333, "<s>a</s>", "▁▁", "\x00", "x" * 65, "hello" * 400]


def test_ids_match_the_library(library):
    many = texts()
    ids, ends = Encoder(load(MODEL))(many)
    for k, t in enumerate(many):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t, num_threads=1), t


def test_occurrence_ranges_by_brute_force():
    model = load(MODEL)
    text = "▁the▁cat▁then▁there▁éa"
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    order = suffix_order(data, model.longest)
    low, high = occurrences(data, order, model)
    for k in np.flatnonzero(high > low).tolist():
        piece = model.pieces[model.ids[k]]
        assert sorted(order[low[k] : high[k]].tolist()) == [i for i in range(len(text)) if text.startswith(piece, i)]
    assert sum(high - low) == sum(1 for i in model.ids for k in range(len(text)) if text.startswith(model.pieces[i], k))


def test_documents(spark, sf_dir, library):
    rows = awkward() + [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    frame = documents(spark, rows)
    got = encode(frame, MODEL)
    found = got.collect()
    assert len(found) == len(rows)
    texts_by = dict(rows)
    for r in found:
        assert list(r.ids) == library.encode(texts_by[r.doc_id] or "", num_threads=1) and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in decode(got, MODEL).collect()}
    for r in found:
        assert (back[r.doc_id] == (texts_by[r.doc_id] or "")) == r.round_trip
    assert decode(got.withColumn("ids", F.lit(None).cast("array<int>")), MODEL).where("text is not null").count() == 0


def test_empty_table(spark):
    assert encode(documents(spark, []), MODEL).count() == 0
