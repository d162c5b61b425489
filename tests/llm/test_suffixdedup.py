import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import suffixdedup
from millrace.llm.suffixdedup import remove_repeats

from .edge import awkward, documents, prose


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[k : k + length] for _, x in data for k in range(len(x) - length + 1))
    out = []
    for i, x in data:
        hit = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        runs = sum(1 for k, h in enumerate(hit) if h and (not k or not hit[k - 1]))
        rest = bytes(c for c, h in zip(x, hit) if not h)
        out.append((i is None, i or 0, len(x), sum(hit), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passage = [prose(rng, 70) for _ in range(4)]
    out = [r for r in awkward() if r[0] != 10]
    for i in range(100, 140):
        parts = [prose(rng, rng.randrange(40)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passage)[rng.randrange(60) :])
        out.append((i, " ".join(parts)))
    out += [(200, "ab" * 400), (201, "ż" * 300), (202, passage[0][:199]), (203, passage[1][:200]), (204, "ab" * 100)]
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_matches_brute_force(spark, rows, length):
    assert got(remove_repeats(documents(spark, rows), length)) == brute(rows, length)


def test_hot_anchors_are_counted_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 3)
    assert got(remove_repeats(documents(spark, rows), 200)) == brute(rows, 200)


def test_one_anchor_with_many_strips():
    rng = random.Random(1)
    tail = prose(rng, 60).encode()
    strips = sorted({prose(rng, 3).encode() + b" " + tail[: 220 + rng.randrange(60)] for _ in range(40)})
    whole = suffixdedup._repeats(strips, [1] * len(strips), [0] * len(strips), 200)
    suffixdedup.CHUNK_BYTES, before = 1000, suffixdedup.CHUNK_BYTES
    try:
        parts = suffixdedup._repeats(strips, [1] * len(strips), [0] * len(strips), 200)
    finally:
        suffixdedup.CHUNK_BYTES = before
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).count() == 0


def test_texts_that_collide_under_polynomials(spark):
    rows = []
    for i, size in enumerate((1024, 4096)):
        one = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
        two = "".join("ba"[bin(k).count("1") % 2] for k in range(size))
        rows += [(2 * i, f"only one {one}"), (2 * i + 1, f"only two {two}")]
    for length in (64, 200):
        assert got(remove_repeats(documents(spark, rows), length)) == brute(rows, length)


def test_a_text_that_is_cut_into_pieces(spark):
    rng = random.Random(7)
    passage = prose(rng, 60)
    long = "".join(rng.choice("abcdefghij ") for _ in range(600_000))
    rows = [(1, long[:262_000] + passage + long[262_000:]), (2, passage), (3, long[500_000:500_300] + "ż"), (4, long[262_100:262_350])]
    assert got(remove_repeats(documents(spark, rows), 200)) == brute(rows, 200)
