from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.negatives import fit_tree, hard_negatives, meeting

SCHEMA = "vec_id long, embedding array<double>, label int, row long, q string, cell int, anchor int"


def by_hand(rows, every, positives=5, negatives=10):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    last = lambda i: (i is None, i)
    for n, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(j), m) for m, (j, w, _) in enumerate(kept)))
        near = [(-s, kept[m][0]) for s, _, m in scored if m != n and kept[m][2] == label][:positives]
        for ps, p in near:
            far = [(-s, kept[m][0]) for s, _, m in scored if kept[m][2] != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out.update((i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(far))
    return out


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, 1, "q", 2, 3) for r in rows], SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def vectors(seed, n, dim=8, clusters=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.1 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(y) for y in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("clusters", [None, 6])
def test_against_all_pairs(spark, clusters):
    rows = vectors(1, 700, clusters=clusters)
    assert mined(spark, rows, 20, leaf=60, group=6) == by_hand(rows, 20)


def test_awkward_rows(spark):
    rows = vectors(2, 300, dim=4)
    same = rows[40][1]
    rows += [(1000 + i, same, i % 2) for i in range(150)]  # ties, one vector often
    rows += [rows[40], rows[40], rows[41]]  # repeated rows, an anchor among them
    rows += [(None, rows[3][1], 1), (None, same, 0), (60, None, 1), (80, rows[2][1], None), (100, [0.1, None, 0.2, 0.3], 2), (120, [float("nan"), 0.0, 0.0, 0.0], 2), (140, [float("inf"), 0.0, 0.0, 0.0], 2), (160, [0.5], 1), (180, [], 1), (200, [9e5, -9e5, 3.0, 1.0], 0), (-20, [0.0, 0.5, 0.1, 0.2], 3)]
    pad = lambda v: v if v is None or None in v else v + [0.0] * (4 - len(v))
    assert mined(spark, rows, 20, leaf=40, group=5) == by_hand([(i, pad(v), label) for i, v, label in rows], 20)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.1], 2)]
    assert mined(spark, rows, 100) == by_hand(rows, 100) and len(by_hand(rows, 100)) == 1
    assert not mined(spark, rows[1:], 100) and not mined(spark, [], 100)
    assert not mined(spark, [(0, [1e300, 1.0], 1), (1, [1e300, 1.0], 1)], 100)


def test_pruning_drops_pairs_of_nodes_and_never_a_wanted_row():
    rng = np.random.default_rng(5)
    x = np.round(256 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 3000)] * 4 + 0.2 * rng.normal(size=(3000, 16))))
    anchors = x[::30]
    trees = []
    for rows, leaves in ((anchors, 8), (x, 64)):
        tree = fit_tree(rows, leaves)
        node = tree.place(rows)
        away = np.sqrt(((rows - tree.center[node]) ** 2).sum(axis=1))
        trees.append((tree, tree.cell[node], {int(c): float(away[tree.cell[node] == c].max()) for c in np.unique(tree.cell[node])}))
    (a, a_cell, a_radius), (c, c_cell, c_radius) = trees
    products = anchors @ x.T
    low = {int(k): float(np.sort(products[a_cell == k], axis=1)[:, -50].min()) for k in np.unique(a_cell)}
    met = {(int(i), int(j)) for own in meeting(a.filled(a_radius, low, {}), c.filled(c_radius, {}, {})) for i, j in zip(*own)}
    assert len(met) < 0.5 * len(a_radius) * len(c_radius)
    for n in range(len(anchors)):
        assert all((int(a_cell[n]), int(c_cell[m])) in met for m in np.flatnonzero(products[n] >= low[int(a_cell[n])]))
