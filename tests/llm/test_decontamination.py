import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import decontamination
from millrace.llm.decontamination import find_contamination, remove_contamination
from millrace.llm.fmindex import FMIndex

from .edge import awkward, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows(text, width=10):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, items, width=10):
    out = []
    by = {}
    for i, t in items:
        by.setdefault(None if i is None else str(i), set()).update(windows(t, width))
    for i, t in rows:
        w, hit, seen = words(t), set(), set()
        for name, own in by.items():
            for size in {len(x) for x in own}:
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) in own:
                        hit |= set(range(k, k + size))
                        seen |= {name} - {None}
        out.append((i is None, i or 0, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def fixture():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice((3, 9, 10, 11, 25)), 60)) for i in range(30)] + [(50, None), (None, "some words"), (51, ""), (52, "!!"), (7, "a b c d e f g h i j k"), (53, "é日本 Żółć a-b_c"), (54, "same same same same same same same same same same same"), (60, items_text := prose(rng, 30, 60)), (61, items_text)]
    rows = awkward()
    for i in range(100, 140):
        text = [prose(rng, rng.randrange(30), 60) for _ in range(2)]
        piece = rng.choice(items)[1] or ""
        own = piece.split()
        own = own[rng.randrange(3) :]
        rows.append((i, f"{text[0]} {' -- '.join(own).upper()} {text[1]}"))
    rows += [(200, "same " * 30), (201, "é日本, ŻÓŁĆ; Żółć A B C"), (202, "é日本 Żółć a b c")]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame([(*x, "t", 1) for x in items], "item_id long, text string, t string, i int")


@pytest.mark.parametrize("width", [10, 4])
def test_hits_match_brute_force(spark, width):
    rows, items = fixture()
    assert got(find_contamination(documents(spark, rows), bench(spark, items), width)) == brute(rows, items, width)


def test_benchmark_in_blocks(spark, monkeypatch):
    rows, items = fixture()
    monkeypatch.setattr(decontamination, "PHRASE_BLOCK_BYTES", 700)
    assert got(find_contamination(documents(spark, rows), bench(spark, items))) == brute(rows, items)


def test_removal_leaves_no_phrase(spark):
    rows, items = fixture()
    frame = documents(spark, rows)
    out = remove_contamination(frame, bench(spark, items))
    assert out.columns == frame.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(rows) and not any(x[-1] for x in brute(left, items))
    clean = {x[1] for x in brute(rows, items) if not x[-1]}
    assert {i: t for i, t in left if i in clean} == {i: t for i, t in rows if i in clean}


def test_empty_tables(spark):
    rows, items = fixture()
    assert find_contamination(documents(spark, []), bench(spark, items)).count() == 0
    assert got(find_contamination(documents(spark, rows), bench(spark, []))) == brute(rows, [])
    assert remove_contamination(documents(spark, rows), bench(spark, [])).count() == len(rows)


def test_fm_index_by_brute_force():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 300)
    index = FMIndex(text)
    for size in (1, 2, 5, 300):
        phrases = np.array([text[k : k + size] for k in range(0, 301 - size, 7)] + [np.full(size, 9)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(text) - size + 1) if (text[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_that_collide_under_polynomials(spark):
    for size in (1024, 4096):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        two = "".join("ba"[bin(i).count("1") % 2] for i in range(size))
        rows, items = [(1, one), (2, two), (3, f"x {one} y")], [(7, one)]
        assert got(find_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)


def test_an_item_without_an_id_hits_but_is_not_named(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma")], "item_id long, text string")
    row = find_contamination(documents(spark, [(1, "x alpha beta gamma y")]), items).first()
    assert (row.n_hit, row.n_items, row.contaminated) == (3, 0, True)


def test_a_text_of_some_megabytes(spark):
    passage = prose(random.Random(5), 12, 60)
    rows = [(1, prose(random.Random(4), 500_000, 5000) + " " + passage), (2, passage)]
    found = {r.doc_id: (r.n_words, r.n_hit) for r in find_contamination(documents(spark, rows), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert found == {1: (500_012, 12), 2: (12, 12)}
