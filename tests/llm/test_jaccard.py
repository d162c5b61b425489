import random
import re

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.jaccard import keep_one, near_duplicates

from .edge import awkward, documents, prose


def shingles(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None and sets[i]:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted(((name is None, name or 0), len(sets[i]), (least.get(find(i)) if sets[i] else name)) for i, (name, _) in enumerate(rows))


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = awkward()
    base = prose(rng, 60).split()
    for i in range(100, 160):  # chains of small changes around the threshold, and equal prefixes
        words = base[:]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"q{rng.randrange(5)}"
        out.append((i, " ".join(words[: rng.choice((60, 58, 50))])))
    return out


def test_links_match_brute_force(spark, rows):
    assert got(near_duplicates(documents(spark, rows))) == brute(rows)


def test_long_lists_by_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert got(near_duplicates(documents(spark, rows))) == brute(rows)


def test_one_of_each_group_stays(spark, rows):
    frame = documents(spark, rows)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    want = {i[1] for i, _, c in brute(rows) if not i[0] and c == i[1]}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and ids.count(None) == 1 and ids.count(12) == 1


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0


def test_texts_that_collide_under_polynomials(spark):
    for size in (1024, 4096):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        two = "".join("ba"[bin(i).count("1") % 2] for i in range(size))
        rows = [(1, one), (2, two), (3, f"{one} x {one}"), (4, f"{two} x {two}"), (5, " ".join(one)), (6, " ".join(two))]
        assert got(near_duplicates(documents(spark, rows))) == brute(rows)


def test_repeated_ids_with_other_texts_and_null_ids(spark):
    words = prose(random.Random(3), 80)
    rows = [(5, words), (5, words + " more"), (7, "something else entirely here now"), (None, words), (None, "twice without any id here"), (None, "twice without any id here"), (None, None), (8, ""), (7, "something else entirely here now")]
    kept = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in keep_one(documents(spark, rows)).collect())
    assert [k for k, _ in kept] == [(False, 5), (False, 7), (False, 8), (True, 0), (True, 0)]


def test_components_found_in_the_second_round(spark, rows):
    """The least group of a list may link with none, while others of the list link with one another."""
    rng = random.Random(8)
    shared = prose(rng, 12)
    base = prose(rng, 80)
    rows = [(0, shared + " " + prose(rng, 84))]
    rows += [(i, f"{shared} {base} q{i}") for i in range(1, 9)] + [(i, f"{shared} {prose(rng, 80)} q{i}") for i in range(20, 30)]
    assert got(near_duplicates(documents(spark, rows))) == brute(rows)


def test_parities_never_rule_out_an_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        assert jaccard._differing(jaccard._bits(x), jaccard._bits(y)) <= len(np.setxor1d(x, y))
