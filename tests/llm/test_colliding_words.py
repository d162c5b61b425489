"""Words made to collide under the unkeyed hash: no query may take them for one another."""

import random

import numpy as np
import pytest

from millrace.llm.decontamination import find_contamination
from millrace.llm.jaccard import keep_one, near_duplicates
from millrace.llm.textnp import equal_spans, hash_spans

from .edge import documents

KNOWN = ("67aw9efeaa60a400", "rws6bmnczu9tx8p3")


def test_the_known_pair_collides_without_a_key_and_not_with_one():
    buf = np.frombuffer("".join(KNOWN).encode(), np.uint8)
    at = np.array([0, 16])
    plain, keyed = hash_spans(buf, at, at + 16), hash_spans(buf, at, at + 16, 12345)
    assert plain[0] == plain[1] and keyed[0] != keyed[1]
    assert equal_spans(buf, at, at + 16, buf, at[::-1], at[::-1] + 16).tolist() == [False, False] and equal_spans(buf, at, at + 16, buf, at, at + 16).all()
    long = np.frombuffer(b"x" * 1300 + b"y", np.uint8)
    assert equal_spans(long, np.array([0, 0]), np.array([600, 600]), long, np.array([100, 701]), np.array([700, 1301])).tolist() == [True, False]


@pytest.mark.parametrize("pair", [KNOWN, tuple(w + "tail4242" for w in KNOWN)])
def test_documents_of_colliding_words_are_not_one_class(spark, pair):
    rng = random.Random(1)
    rest = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = [(1, pair[0]), (2, pair[1]), (3, f"a b c {pair[0]} d e f"), (4, f"a b c {pair[1]} d e f"), (5, " ".join([*rest[:7], pair[0], *rest[7:12]])), (6, " ".join([*rest[:7], pair[1], *rest[7:12]])), (7, " ".join([*rest, pair[0]])), (8, " ".join([*rest, pair[1]]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (3, 3), 4: (3, 4), 5: (9, 5), 6: (9, 6), 7: (57, 7), 8: (57, 7)}
    assert sorted(r.doc_id for r in keep_one(documents(spark, rows)).collect()) == [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("pair", [KNOWN, tuple(w + "tail4242" for w in KNOWN)])
def test_a_benchmark_word_does_not_hit_one_that_collides(spark, pair):
    rest = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, pair[0]), (2, f"{rest} {pair[0]} x1 x2 x3 x4 x5 x6 x7 x8 x9")], "item_id long, text string")
    rows = [(1, pair[0]), (2, pair[1]), (3, f"{rest} {pair[1]} x1 x2 x3 x4 x5 x6 x7 x8 x9"), (4, f"say {rest} {pair[0]} x1")]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in find_contamination(documents(spark, rows), items).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (12, 1), 4: (14, 2)}


def test_bytes_decide_even_where_hashes_agree(spark, monkeypatch):
    """With the key known beforehand, as if drawn so: only the comparison of bytes is left."""
    from millrace.llm import decontamination

    monkeypatch.setattr(decontamination, "new_key", lambda: 0)
    phrases = decontamination.make_phrases(["1"], [KNOWN[0]], 10)
    for word, want in ((KNOWN[0], True), (KNOWN[1], False)):
        low = np.frombuffer(word.encode(), np.uint8)
        hit, docs, _ = decontamination.search_shard(low, np.array([0]), np.array([16]), np.array([0, 1]), phrases)
        assert hit.tolist() == [want] and len(docs) == int(want)
