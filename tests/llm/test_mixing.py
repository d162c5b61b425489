import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import ROUNDS, _permuted, mix, mixed_texts, source_targets, taken_words

from .edge import awkward, documents, prose


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shared again and again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, stopped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        out = {s: most * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in stopped and out[s] > most * sizes[s]}
        if not above:
            return out
        stopped |= above


@pytest.mark.parametrize("seed", range(8))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 7, 50, 1000, 100_000]) for s in rng.sample(["a", "b", "B", "é", "", "zz", "ｘ", "𝒙", None], 6)}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(targets(sizes))


def test_permutations_hit_each_index_once(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        keys = F.array(*[F.lit((r * 7919 + 13) % n).cast("long") for r in range(ROUNDS)])
        got = [r.p for r in spark.range(n).select(_permuted(F.col("id"), F.lit(n).cast("long"), keys, "x").alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 90 or sum(p == k for k, p in enumerate(got)) < n / 4)


def mixed_rows(seed):
    rng = random.Random(seed)
    rows = [(*r, "en", rng.choice(["web", "books", None])) for r in awkward(seed)]
    rows += [(i, prose(rng, rng.randrange(3, 900)), "en", rng.choice(["web", "web", "web", "books", "code", "rare" if i % 20 == 0 else "web"])) for i in range(300, 600)]
    return rows + rows[-4:] + rows[-4:]


def test_mix(spark):
    rows = mixed_rows(1)
    table = documents(spark, rows)
    mixture = mix(table, block_words=32, shard_slots=50)
    got = taken_words(mixture).collect()
    own = Counter()
    for _, t, _, s in rows:
        own[s] += size(t)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, size(t), own[s]) for i, t, _, s in rows)
    target = targets(own)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(own[s], round(target[s], 6)) for s in own}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    words = defaultdict(int)
    for r in got:
        words[r.source_size] += r.taken
    assert all(abs(words[own[s]] - target[s]) <= 64 for s in own), (dict(words), target)
    again = taken_words(mix(table.repartition(5), block_words=32, shard_slots=50)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))

    slots = mixture.slots.collect()
    shards = Counter(r.shard for r in slots)
    assert all(n == 50 for s, n in shards.items() if s != max(shards)) and sorted(shards) == list(range(len(shards)))
    wanted = {r["rank"]: (r.wanted, r.blocks) for r in mixture.sources.collect()}
    for rank, (n, blocks) in wanted.items():
        of = Counter(r.block for r in slots if r["rank"] == rank)
        assert sum(of.values()) == n and (not of or max(of.values()) - min([*of.values(), 9 if len(of) == blocks else 0]) <= 1)
    for rank, (n, _) in wanted.items():  # every shard holds about its share
        share = n / len(slots)
        for s, m in shards.items():
            k = sum(r.shard == s and r["rank"] == rank for r in slots)
            assert abs(k - share * m) <= 5 * (share * (1 - share) * m) ** 0.5 + 3


def test_texts_of_the_mix(spark):
    rows = mixed_rows(2)[-60:]
    table = documents(spark, rows)
    mixture = mix(table, block_words=16, shard_slots=20)
    texts = mixed_texts(table, mixture).collect()
    assert len(texts) == mixture.slots.count() > 0
    all_words = Counter(w for r in texts for w in r.text.split(" "))
    assert sum(all_words.values()) == sum(r.taken for r in taken_words(mixture).collect())
    assert max(len(r.text.split(" ")) for r in texts) == 16
    mine = " ".join(sorted((t for _, t, *_ in rows if t), key=len)[-1].split())
    assert any(r.text in mine for r in texts)


def test_many_copies_of_one_row(spark):
    rows = [(5, "a few words here", "en", "web")] * 5000 + [(i, "other words " * 4, "en", "books") for i in range(100)]
    got = taken_words(mix(documents(spark, rows), block_words=8)).collect()
    assert len(got) == 5100 and max(r.taken for r in got if r.size == 4) <= 12
    assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) <= 16


def test_no_words(spark):
    assert taken_words(mix(documents(spark, []))).count() == 0
    got = taken_words(mix(documents(spark, [(1, None), (2, "  ")]))).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
