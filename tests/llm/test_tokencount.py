import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm.tokencount import count_tokens, tokenizer_version

from .edge import awkward, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows():
    return [*awkward(), (400, "<s> and </s> and <unk> ▁ <0x41>"), (401, "a\x00b"), (402, "long " * 5000)]


def test_counts_match_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for i, t in rows())
    got = count_tokens(documents(spark, rows()), MODEL).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_counts_of_a_json_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, rows()), path).collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in rows()}


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = rows()
    count_tokens(documents(spark, first), MODEL, cache).count()
    table = lambda: spark.read.parquet(cache)
    assert table().count() == len({t or "" for _, t in first})
    more = [*first, (900, "a text that is new"), (901, "a text that is new")]
    got = count_tokens(documents(spark, more), MODEL, cache)
    assert got.count() == len(more) and table().count() == len({t or "" for _, t in first}) + 1
    count_tokens(documents(spark, more[:3]), public_tokenizers.path("byte_bpe_50k.json"), cache).count()
    assert table().select("tokenizer").distinct().count() == 2
    # a pair that is there twice, as after a repeated append, changes nothing
    table().write.mode("append").parquet(cache + "-copy")
    table().write.mode("append").parquet(cache + "-copy")
    again = count_tokens(documents(spark, more), MODEL, cache + "-copy")
    assert sorted(map(str, again.collect())) == sorted(map(str, count_tokens(documents(spark, more), MODEL, cache).collect()))


def test_a_second_run_of_the_query_encodes_nothing(spark, sf_dir):
    from millrace.llm.queries import op6_token_counts
    from millrace.llm.shared import shared_dir

    path = f"{shared_dir(spark)}/millrace/token-cache/{tokenizer_version(MODEL)[:16]}"
    first = sorted(map(tuple, op6_token_counts(spark, sf_dir).collect()))
    encoded = spark.read.parquet(path).count()
    assert sorted(map(tuple, op6_token_counts(spark, sf_dir).collect())) == first
    assert spark.read.parquet(path).count() == encoded > 0


def test_empty_table(spark):
    assert count_tokens(documents(spark, []), MODEL).count() == 0


@pytest.mark.parametrize("limit", [2, 10])
def test_limit(spark, limit):
    assert all(r.over_limit == (r.n_tokens > limit) for r in count_tokens(documents(spark, awkward()), MODEL, limit=limit).collect())
