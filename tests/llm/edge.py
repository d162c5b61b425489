"""Small document tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot long, n long, cid long, key string, anchor string, spans string, _pii_carry string"


def documents(spark, rows):
    """``rows`` are (doc_id, text) or (doc_id, text, lang, source); further columns have names that operators use inside."""
    full = [(*r, *((None, None) if len(r) == 2 else ()), None if r[1] is None else len(r[1]), 1, 2, 3, "k", "a", "s", "c") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, texts without letters, signs beyond ASCII."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    rows = [(1, None), (2, ""), (3, "   \t\n "), (4, "one two"), (5, "ONE two"), (6, base), (7, base), (8, base.upper()), (9, base + " tail"), (10, prose(rng, 30_000)), (11, "12 34 ##"), (None, "text without an id " * 9), (12, "żółć 日本語 éa é " * 12), (12, "żółć 日本語 éa é " * 12), (13, "x" * 5000), (14, " a b\u0085c")]
    for i in range(20, 60):
        words = base.split() if rng.random() < 0.5 else prose(rng, 90).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows
