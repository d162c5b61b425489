"""How far texts may lie is learnt from all languages, not from the first of the alphabet."""

import random

import numpy as np

from millrace.llm import language
from millrace.llm.language import _evenly, fit


def test_pieces_come_from_every_language():
    lists = [[f"{k}{i}" for i in range(n)] for k, n in (("a", 400), ("b", 400), ("c", 400), ("d", 3))]
    got = _evenly(lists, 512)
    count = {k: sum(t[0] == k for t in got) for k in "abcd"}
    assert len(got) == len(set(got)) == 512 and count["d"] == 3 and max(count.values()) - min(count[k] for k in "abc") <= 1
    assert {t[0] for t in _evenly([[f"{k}"] * 5 for k in "abcdefgh"], 3)} == set("abcdefgh")
    assert _evenly([], 5) == _evenly([[]], 5) == []


def test_reach_is_that_of_all_languages(monkeypatch):
    """Texts of the last language lie farther from its centroids; with the others only, its own would have been too far."""
    rng = random.Random(1)
    words = lambda n, abc: ["".join(rng.choices(abc, k=7)) for _ in range(n)]
    few, many = words(5, "abcde"), words(4000, "nopqrstuvwxyz")
    samples = {"a": [" ".join(rng.choices(few, k=60)) for _ in range(400)], "b": [" ".join(rng.choices(few, k=60)) for _ in range(400)], "c": [" ".join(rng.choices(many, k=60)) for _ in range(400)]}
    drawn = []
    whole = language._count
    monkeypatch.setattr(language, "_count", lambda texts: (drawn.append(texts), whole(texts))[1])
    model = fit(samples, share=0.99)
    for texts in drawn[len(samples) :]:  # after the samples themselves, the pieces of each length
        assert sum(set(t) - set("abcde ") != set() for t in texts) >= len(texts) // 4
    counts = whole([t[:64] for t in samples["c"]])
    assert np.mean(model.nearest(counts)[2]) <= 0.1
