import public_tokenizers
import sentencepiece

import corpus_pipeline

from .edge import documents
from .test_decontamination import brute as leaks
from .test_jaccard import brute as groups
from .test_pii import brute as personal


def test_each_stage_on_its_own_input(spark, sf_dir):
    """The stages one after another, each held against brute force over what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kind = docs.schema

    kept = steps["language"](spark, docs, sf_dir)
    before = dict(rows(docs))
    assert kept.columns == docs.columns and all(before[i] == t for i, t in rows(kept))
    assert kept.count() >= 0.9 * docs.where("length(text) >= 60").count()

    unique = steps["near-duplicates"](spark, spark.createDataFrame(kept.collect(), kind), sf_dir)
    want = sorted(i[1] for i, n, c in groups(rows(kept)) if c == i[1])
    assert sorted(i for i, _ in rows(unique)) == want

    clean = steps["decontamination"](spark, spark.createDataFrame(unique.collect(), kind), sf_dir)
    assert not any(x[-1] for x in leaks(rows(clean), bench))
    hit = {x[1] for x in leaks(rows(unique), bench) if x[-1]}
    was = dict(rows(unique))
    assert all(was[i] == t for i, t in rows(clean) if i not in hit) and clean.count() == unique.count()

    safe = steps["personal-data"](spark, spark.createDataFrame(clean.collect(), kind), sf_dir)
    assert safe.columns == docs.columns and not any(personal(t or "") for _, t in rows(safe))

    last = steps["sentencepiece"](spark, spark.createDataFrame(safe.collect(), kind), sf_dir)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows(safe))
    found = last.collect()
    assert len(found) == len(texts) and all(list(r.ids) == model.encode(texts[r.doc_id] or "", num_threads=1) for r in found)

    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {r.doc_id: list(r.ids) for r in found}


def test_stages_take_empty_tables(spark, sf_dir):
    empty = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
