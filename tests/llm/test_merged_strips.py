"""Merged strips against counting every window, for anchors with copies only, with some, and with none."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

from millrace.llm.suffixdedup import _merge_parts


def test_ranges_of_strips_with_and_without_copies():
    rng, length = random.Random(5), 20
    rows, name = [], 0
    for anchor in range(60):
        letters = bytes([2 * anchor, 2 * anchor + 1])  # as equal strings have one anchor
        shared = bytes(rng.choices(letters, k=60))
        for _ in range(rng.randint(1, 4)):
            strip = bytes(rng.choices(letters, k=rng.randint(20, 40))) + shared[: rng.choice([0, 25, 60])]
            # a third of the anchors has copies of all strips, a third of none
            rows.append((anchor, name, (rng.randint(2, 4), 1, rng.randint(1, 2))[anchor % 3], strip))
            name += 1
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["anchor", "content", "weight", "bytes"])
    seen = Counter()
    for _, _, weight, strip in rows:
        for k in range(len(strip) - length + 1):
            seen[strip[k : k + length]] += weight
    got = {}
    for out in _merge_parts(iter([batch]), length):
        for row in out.to_pylist():
            got[row["content"]] = {p for r in row["runs"] for p in range(r["a"], r["b"])}
    for _, name, _, strip in rows:
        hit = [k for k in range(len(strip) - length + 1) if seen[strip[k : k + length]] > 1]
        assert got.get(name, set()) == {p for k in hit for p in range(k, k + length)}
