"""Running sums in two levels against plain Python."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from millrace.operators.prefix import in_parts, numbered_rows, running_totals


def rows_of(n, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(9)]), i, rng.choice([None, *range(-5, 50)])) for i in range(n)]


SCHEMA = "k string, o int, i int, v int"
first = lambda x: (x is not None, x)  # noqa: E731  nulls first


def test_running_totals(spark):
    rows = rows_of(3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.i: (r.t, r.n) for r in running_totals(df, ["k"], ["o", "i"], {"t": F.col("v"), "n": F.lit(1)}, rows_per_part=100).collect()}
    want = {}
    for _, own in groupby(sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2])), key=lambda r: r[0]):
        t = 0
        for n, r in enumerate(own):
            want[r[2]] = (t, n)
            t += r[3] or 0
    assert got == want


def test_parts_split_the_large_key_and_rise_with_the_order(spark):
    df = spark.createDataFrame(rows_of(4000), SCHEMA)
    got = in_parts(df, ["k"], ["o", "i"], "part", rows_per_part=200).collect()
    large = sorted((first(r.o), r.i, r.part) for r in got if r.k == "a")
    parts = [p for *_, p in large]
    assert parts == sorted(parts) and len(set(parts)) >= 5
    assert max(parts.count(p) for p in set(parts)) < len(parts) / 3
    again = in_parts(df.repartition(11), ["k"], ["o", "i"], "part", rows_per_part=200).collect()
    assert sorted(got, key=lambda r: r.i) == sorted(again, key=lambda r: r.i)


def test_numbers_of_a_whole_table(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("x"), F.lit("c").alias("part"))
    got = numbered_rows(df, [], ["x"], "place", rows_per_part=300).collect()
    assert all(r.place == r.x + 1 and r.part == "c" for r in got) and len(got) == 5000
    assert numbered_rows(df.limit(0), [], ["x"], "place").count() == 0


def test_no_task_orders_a_whole_key(spark):
    df = spark.createDataFrame(rows_of(10), SCHEMA)
    plan = running_totals(df, ["k"], ["i"], {"t": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "part" in plan


def test_values_are_carried_across_parts(spark):
    from millrace.operators.prefix import carried_forward

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), i, rng.choice([None] * 30 + [i]), rng.choice([None, f"s{i}"])) for i in range(2000)]
    got = {(r.k, r.i): (r.v, r.s) for r in carried_forward(spark.createDataFrame(rows, "k string, i int, v int, s string"), ["k"], ["i"], ["v", "s"], rows_per_part=100).collect()}
    last, want = {}, {}
    for k, i, v, s in rows:
        before = last.get(k, (None, None))
        last[k] = want[k, i] = (before[0] if v is None else v, before[1] if s is None else s)
    assert got == want


def test_allocation_over_many_parts(spark):
    from millrace.operators.scenario import allocate, moves, with_unmet

    rng = random.Random(5)
    need = [(rng.choice("gh"), i, float(rng.randrange(0, 9))) for i in range(800)]
    offer = [(rng.choice("ghi"), i, float(rng.randrange(0, 12))) for i in range(500)]
    want = {}
    for g in "gh":
        left = [[k, a] for x, k, a in offer if x == g and a > 0]
        for _, k, a in (x for x in need if x[0] == g):
            while a > 0 and left:
                took = min(a, left[0][1])
                want[g, k, left[0][0]] = took
                a -= took
                left[0][1] -= took
                if left[0][1] <= 0:
                    left.pop(0)
    d, s = spark.createDataFrame(need, "g string, k int, need double"), spark.createDataFrame(offer, "g string, k int, offer double")
    rows = allocate(d, s, "g", "need", ["k"], "offer", ["k"], rows_per_part=60)
    assert {(r.g, r.d.k, r.s.k): r.amount for r in rows.collect()} == want
    full = with_unmet(rows, d, "g", "need", ["k"]).collect()
    assert sum(r.amount + r.unmet for r in full) == sum(a for *_, a in need)
    assert {r.k for r in full if r.s is None} == {k for g, k, _ in need} - {k for _, k, _ in want}
    table = spark.createDataFrame([("x", "p", "p", 1.0), ("x", "p", "q", 2.0), ("x", "p", "q", 0.5), ("x", None, "q", 0.0)], "g string, a string, b string, n double")
    assert {tuple(r) for r in moves(table, ["g"], "a", "b", "n").collect()} == {("x", None, "q", 0.0, "not_moved"), ("x", "p", "q", 2.5, "candidate_move")}


def test_source_that_stands_in(spark):
    from millrace.operators.fallback import first_with_rows

    a, b, c = (spark.range(n).select("id", F.lit(name).alias("of")) for n, name in ((0, "a"), (3, "b"), (5, "c")))
    assert {r.of for r in first_with_rows(a, b, c).collect()} == {"b"} and first_with_rows(c, b).count() == 5 and first_with_rows(a, a).count() == 0
