"""A term and a value count together wherever both are in a document."""

import random

from millrace.llm.pii import disclosing_terms, find_pii

from .edge import documents


def texts():
    rng = random.Random(9)
    filler = lambda n: " ".join(f"word{rng.randrange(60)}" for _ in range(n))
    rows = [(k, f"Zorblattine wrote. {filler(80)} reach zed@example.org {filler(10)}") for k in range(6)]
    # near the value in half of the documents, far from it in the others
    rows += [(10 + k, f"{filler(20)} Quixandra {'' if k % 2 else filler(30)} at 10.1.2.3 {filler(10)}") for k in range(8)]
    # copies prove nothing
    rows += [(20 + k, "Vextorium spoke of mail to vex@example.org today") for k in range(5)]
    return rows + [(100 + k, filler(90)) for k in range(60)]


def test_terms_far_from_values(spark):
    got = {r.term: r["drop"] for r in disclosing_terms(documents(spark, texts())).collect()}
    assert got == {"zorblattine": True, "wrote": True, "reach": True, "quixandra": True}


def test_terms_inside_values_are_not_counted(spark):
    """The term is in other documents only within other addresses."""
    rng = random.Random(4)
    filler = lambda n: " ".join(f"word{rng.randrange(60)}" for _ in range(n))
    rows = [(k, f"{filler(6)} Morwenna {filler(30)} see 10.9.8.7 {filler(9)}") for k in range(4)]
    rows += [(10 + k, f"{filler(20)} morwenna@host{k}.example.org {filler(20)}") for k in range(60)]
    assert {r.term: r["drop"] for r in disclosing_terms(documents(spark, rows)).collect()} == {"morwenna": True, "see": True}


def test_many_values_and_terms(spark, monkeypatch):
    from millrace.llm import pii

    whole = sorted(map(tuple, disclosing_terms(documents(spark, texts())).collect()))
    monkeypatch.setattr(pii, "PAIR_ROWS", 7)
    assert sorted(map(tuple, disclosing_terms(documents(spark, texts())).collect())) == whole
    spans = {r.doc_id: r.n_term for r in find_pii(documents(spark, texts())).collect()}
    assert all(spans[k] == 3 for k in range(6)) and not any(spans[100 + k] for k in range(60))
