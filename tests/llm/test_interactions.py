import random
import re
from collections import Counter
from itertools import permutations

import pytest

from millrace.llm.interactions import audit_filters, replay

from .edge import awkward, documents, prose


def by_hand(rows, labels):
    flags = []
    for i, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [j for j, t, *_ in rows if j is not None and i is not None and j < i and (t or "") == text]
        own = [x for x in labels if x[0] is not None and x[0] == i]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": bool(same)}
        flags.append((lang or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in flags}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flags if f[0] == part]
            gone = []
            for k, letter in enumerate(order):
                hit = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                shapley[part, letter] += len(hit)
                out[part, order, k + 1] = [len(left), len(hit), sum(letter in f[1] for f in gone), sum(f[1] == {letter} for f in flags if f[0] == part), sum(f[2] for f in hit), sum(f[3] for f in hit)]
                gone += hit
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def as_dict(df):
    got = [tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()]
    assert len({g[:3] for g in got}) == len(got)
    return {g[:3]: g[3:] for g in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_replay_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(*r, rng.choice(["en", "de", None, ""]), rng.choice(["web", None])) for r in awkward(seed)]
    rows += [(i, prose(rng, rng.choice([150, 250, 500]), rng.choice([40, 4000])) + rng.choice(["", " #", " ABC" * 30]), rng.choice(["en", "de"]), "s") for i in range(300, 380)]
    rows += [(i + 1000, t, lang, s) for i, t, lang, s in rng.sample(rows[-80:], 20)] + rows[-3:]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.choices([r[0] for r in rows], k=120)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_dict(audit_filters(documents(spark, rows), table)) == by_hand(rows, labels)


def test_many_copies_of_one_text(spark):
    rows = [(i, "the same words " * 5, "en", "s") for i in range(400)] + [(1000 + i, f"w{i} " * 3, "en", "s") for i in range(200)]
    got = as_dict(audit_filters(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["en", "EABCD", 1][:2] == (201, 399) and len(got) == 600


def test_no_rows(spark):
    assert audit_filters(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_other_filters(spark):
    flags = spark.createDataFrame([("x", None, True, True, None), ("x", True, False, False, True)], "part string, good boolean, toxic boolean, short boolean, odd boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.toxic_lost) for r in replay(flags, ["short", "odd"]).collect()}
    assert got == {("shortodd", 1): (1, 1, 1), ("shortodd", 2): (0, 1, 0), ("oddshort", 1): (1, 1, 0), ("oddshort", 2): (0, 1, 1)}
    with pytest.raises(ValueError):
        replay(flags, list("ABCDEFG"))
