import hashlib
import random
import re

from millrace.llm.pii import base_spans, find_pii, remove_pii

from .edge import awkward, documents

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_patterns_match_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aB1234567890..@@-+ ()é%_") for _ in range(rng.randrange(60)))
        assert base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "+44 (20) 7946-0958", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.2.3.4", "999.1.1.1"):
        assert base_spans(text) == brute(text)


def planted():
    rows = awkward()
    rng = random.Random(5)
    for k in range(6):
        filler = [" ".join(f"word{rng.randrange(60)}" for _ in range(20)) for _ in range(2)]
        rows.append((100 + k, f"{filler[0]} Zorblattine{k % 2 and ' '} {'note' + str(k)} reach zed@example.org {filler[1]}"))
    rows += [(200, "mail é.x zed@example.org, 4111 1111 1111 1111 and 10.0.0.1 +1 (555) 010-9999")]
    rows += [(300 + k, " ".join(f"word{rng.randrange(60)}" for _ in range(40))) for k in range(40)]
    return rows


def test_spans_on_fixture(spark):
    rows = planted()
    got = find_pii(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, []).append(brute(text or ""))
    terms = set()
    for r in got:
        base = by_id[r.doc_id][0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        said = ",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        kept = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert ",".join(kept) == said
        text = dict(rows)[r.doc_id] or ""
        terms |= {text[int(a) : int(b)].lower() for s in r.spans.split(",") if s.startswith("term:") for _, a, b in [s.split(":")]}
    assert "zorblattine" in terms and not any(t.startswith("word") for t in terms)


def test_removal(spark):
    rows = planted()
    frame = documents(spark, rows)
    got = remove_pii(frame)
    assert got.columns == frame.columns and got.count() == len(rows)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[10] == dict(rows)[10]
    assert "@" not in texts[100] and "orblattine" not in texts[100].lower()
    assert texts[200].startswith("mail é.x <EMAIL>, <CARD> and <IP> <PHONE>")


def test_empty_table(spark):
    assert find_pii(documents(spark, [])).count() == 0
    assert remove_pii(documents(spark, [])).count() == 0
