from millrace.llm.language import fit, fit_documents, held_out, identify, keep_identified

from .edge import awkward, documents


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs, fit_documents(docs))
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = got.join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und' and length(text) >= 40").collect()
    assert len(both) > 20
    assert sum(r.lang == r.lang_pred for r in both) / len(both) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_awkward_rows(spark, sf_dir):
    model = fit_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = awkward()
    got = identify(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 11):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    kept = keep_identified(documents(spark, rows), model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.rejected}


def test_far_texts_are_rejected_and_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_documents(docs)
    noise = documents(spark, [(1, "qxzjk " * 300), (2, "zzzzqqqq" * 100)])
    assert keep_identified(noise, model).count() == 0
    clean = docs.where("lang is not null and length(text) >= 60")
    assert keep_identified(clean, model).count() >= 0.97 * clean.count()


def test_nothing_learnt(spark):
    empty = documents(spark, [])
    model = fit_documents(empty)
    assert identify(empty, model).count() == 0
    rows = identify(documents(spark, [(1, "some text")]), fit({})).collect()
    assert rows[0].lang_pred == "und" and rows[0].score == 0


def test_crc_rule(spark):
    import zlib

    for r in documents(spark, [(i, "x") for i in range(40)]).select("doc_id", held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
