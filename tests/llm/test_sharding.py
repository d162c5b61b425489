import zlib
from collections import Counter

import numpy as np

from millrace.llm.sharding import assign_shards, jump_hash

from .edge import awkward, documents


def plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 24, 25, 1000):
        assert jump_hash(keys, n).tolist() == [plain(int(k), n) for k in keys[:3000]]
    a, b = jump_hash(keys, 24), jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.02
    assert Counter(a.tolist()).most_common()[-1][1] > 80


def test_slots_and_sizes(spark):
    rows = awkward() + [(i, f"t{i % 7}") for i in range(1000, 1400)]
    got = assign_shards(documents(spark, rows), 24).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    place = {}
    for r in got:
        assert place.setdefault(r.doc_id, r.shard) == r.shard
    again = {r.doc_id: r.shard for r in assign_shards(documents(spark, rows[::2]), 24).collect()}
    assert all(place[i] == s for i, s in again.items())
    grown = {r.doc_id: r.shard for r in assign_shards(documents(spark, rows), 25).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in got}


def test_empty_table(spark):
    assert assign_shards(documents(spark, []), 24).count() == 0
