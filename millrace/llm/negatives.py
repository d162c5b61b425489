"""Hard negatives by dual-tree search: trees over anchors and candidates, pruned in pairs of nodes, leaf pairs scored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_batches, small_batches, written

#: A bound below and above every score.
_FAR = 1 << 62
#: Components are whole numbers of 1 / 256; a vector whose own product reaches 2 ** 62 has no score that a long can hold.
SCALE = 256
_MOST_NORM = float(1 << 62)


# ---- rows -----------------------------------------------------------------------------------------------------------


def _quantised(rows: DataFrame) -> DataFrame:
    """row, vec_id, label, anchor and q (32-bit components) of the rows that take part."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(batch.schema.get_field_index("v")).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(batch.schema.get_field_index("v"))
        starts = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(len(lists)):
                q = np.floor(values[starts[k] : starts[k + 1]] * SCALE)
                out.append(q.astype("<i4").tobytes() if np.isfinite(q).all() and q @ q < _MOST_NORM else None)
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "vec_id", "label", "anchor")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], ["row", "vec_id", "label", "anchor", "q"])

    return map_batches(rows, step, "row long, vec_id long, label long, anchor boolean, q binary").where("q IS NOT NULL")


def _matrix(values, dim: int) -> np.ndarray:
    """The vectors of a binary Arrow array, short ones filled with zeros."""
    each = [np.frombuffer(x, "<i4") for x in values.to_pylist()]
    if all(len(x) == dim for x in each):
        return np.concatenate(each).reshape(-1, dim).astype(np.float64) if each else np.zeros((0, dim))
    out = np.zeros((len(each), dim))
    for k, x in enumerate(each):
        out[k, : len(x)] = x
    return out


# ---- trees ----------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A binary tree of balls.  Inner nodes split by a direction; ``cell`` numbers the leaves, others have -1."""

    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    direction: np.ndarray
    cut: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf (as a node) of each row of ``x``."""
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.cell[at] < 0)
        while len(live):
            node = at[live]
            at[live] = np.where(np.einsum("ij,ij->i", x[live], self.direction[node]) <= self.cut[node], self.left[node], self.right[node])
            live = live[self.cell[at[live]] < 0]
        return at

    def filled(self, radius: dict[int, float], low: dict[int, float], high: dict[int, float]) -> Tree:
        """With the balls of all rows: leaves as told by cell (others are empty), inner nodes around their children."""
        r, lo, hi = (np.full(len(self.cell), x) for x in (-1.0, np.inf, -np.inf))
        for node in range(len(self.cell) - 1, -1, -1):  # children come after their parents
            if self.cell[node] >= 0:
                c = int(self.cell[node])
                if c in radius:
                    r[node], lo[node], hi[node] = radius[c], low.get(c, -np.inf), high.get(c, np.inf)
            else:
                for child in (self.left[node], self.right[node]):
                    if r[child] >= 0:
                        r[node] = max(r[node], np.linalg.norm(self.center[node] - self.center[child]) * (1 + 1e-9) + r[child])
                        lo[node], hi[node] = min(lo[node], lo[child]), max(hi[node], hi[child])
        return Tree(self.left, self.right, self.cell, self.direction, self.cut, self.center, r, lo, hi)


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Splits of ``sample`` along the line between two far rows, at the widest gap of the middle half, level by level; rows that are all equal are not split."""
    dim = sample.shape[1]
    nodes: list[dict] = []

    def add(rows: np.ndarray) -> int:
        center = sample[rows].mean(axis=0) if len(rows) else np.zeros(dim)
        nodes.append({"rows": rows, "center": center, "left": -1, "right": -1, "direction": np.zeros(dim), "cut": 0.0})
        return len(nodes) - 1

    add(np.arange(len(sample)))
    level, count, grew = [0], 1, True
    while count < leaves and grew:
        grew, deeper = False, []
        for node in level:
            rows = nodes[node]["rows"]
            if count < leaves and len(rows) > 1:
                x = sample[rows]
                far = x[np.argmax(((x - nodes[node]["center"]) ** 2).sum(axis=1))]
                along = x[np.argmax(((x - far) ** 2).sum(axis=1))] - far
                at = x @ along
                ordered = np.sort(at)
                quarter = len(ordered) // 4
                gaps = np.diff(ordered[quarter : len(ordered) - quarter])
                if not len(gaps) or gaps.max() <= 0:
                    quarter, gaps = 0, np.diff(ordered)
                cut = ordered[quarter + int(np.argmax(gaps))]
                left = at <= cut
                if not left.all():
                    nodes[node] |= {"direction": along, "cut": cut, "left": add(rows[left]), "right": add(rows[~left])}
                    deeper += [nodes[node]["left"], nodes[node]["right"]]
                    count, grew = count + 1, True
        level = deeper
    column = lambda k, kind=np.float64: np.array([n[k] for n in nodes], kind)
    left = column("left", np.int64)
    cell = np.where(left < 0, np.cumsum(left < 0) - 1, -1)
    none = np.zeros(len(nodes))
    return Tree(left, column("right", np.int64), cell, column("direction"), column("cut"), column("center"), none, none, none)


def _tree_of(rows: DataFrame, n: int, dim: int, leaf: int, cells: int) -> Tree:
    """Fitted on about 16 rows a leaf, chosen by the hash of the row's number: 16 * ``cells`` rows, twice that at most."""
    leaves = min(cells, max(1, -(-n // leaf)))
    wanted = 16 * leaves
    share = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(1 << 20)) < max(1, min(1 << 20, (wanted << 20) // max(n, 1)))
    found = rows.where(share).select("q").limit(2 * wanted).toArrow().column("q")
    return fit_tree(_matrix(found, dim), leaves)


def _packed(rows: DataFrame, tree, dim: int, leaf: int, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The leaf blocks (cell, part, items), and of each cell its rows and radius.

    A cell of more than ``leaf`` rows is cut into parts of about ``leaf`` rows by the
    number of the row, so that equal vectors, which no tree parts, never make one large block.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(batch.column(batch.schema.get_field_index("q")), dim)
        own = tree.value
        node = own.place(q)
        away = np.sqrt(((q - own.center[node]) ** 2).sum(axis=1)) * (1 + 1e-9)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.cell[node].astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(map_batches(rows, step, f"{kinds}, cell int, away double"), "negatives-placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    parts = placed.join(cells.select("cell", F.expr(f"(n - 1) div {leaf} + 1").alias("parts")), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "row"), "parts"))
    item = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row", "label", *fields, "q")
    return parts.groupBy("cell", "part").agg(F.sort_array(F.collect_list(item)).alias("items")), cells


# ---- pairs of nodes -------------------------------------------------------------------------------------------------


def _intervals(a: Tree, i: np.ndarray, c: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between the balls of nodes i and nodes j, with a margin for rounding."""
    middle = np.einsum("ij,ij->i", a.center[i], c.center[j])
    na, nc = np.linalg.norm(a.center[i], axis=1), np.linalg.norm(c.center[j], axis=1)
    reach = a.radius[i] * nc + c.radius[j] * na + a.radius[i] * c.radius[j]
    margin = 1 + 1e-9 * (na + a.radius[i]) * (nc + c.radius[j])
    return middle - reach - margin, middle + reach + margin


def meeting(a: Tree, c: Tree, start: int = 0, chunk: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of ``a`` below ``start`` and of ``c`` whose rows can have a product that the anchors still want.

    A pair of nodes goes, with all anchors below it, if its interval lies below the
    least or above the most that any of them wants; else the larger ball is split.
    """
    stack = [(np.array([start]), np.array([0]))]
    while stack:
        i, j = stack.pop()
        if len(i) > chunk:
            stack += [(i[chunk:], j[chunk:]), (i[:chunk], j[:chunk])]
            continue
        alive = (a.radius[i] >= 0) & (c.radius[j] >= 0)
        i, j = i[alive], j[alive]
        least, most = _intervals(a, i, c, j)
        near = (most >= a.low[i]) & (least <= a.high[i])
        i, j = i[near], j[near]
        leaf_a, leaf_c = a.cell[i] >= 0, c.cell[j] >= 0
        both = leaf_a & leaf_c
        if both.any():
            yield a.cell[i[both]], c.cell[j[both]]
        split_a = ~both & ~leaf_a & (leaf_c | (a.radius[i] >= c.radius[j]))
        split_c = ~both & ~split_a
        if split_a.any() or split_c.any():
            ai, aj, ci, cj = i[split_a], j[split_a], i[split_c], j[split_c]
            stack.append((np.concatenate([a.left[ai], a.right[ai], ci, ci]), np.concatenate([aj, aj, c.left[cj], c.right[cj]])))


def _subtrees(tree: Tree, many: int) -> list[int]:
    level = [0]
    while len(level) < many and any(tree.cell[x] < 0 for x in level):
        level = [y for x in level for y in ([x] if tree.cell[x] >= 0 else [int(tree.left[x]), int(tree.right[x])])]
    return level


def _cell_pairs(spark: SparkSession, trees, starts: list[int]) -> DataFrame:
    """(a_cell, c_cell) that can hold what is wanted; each task takes a subtree of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = trees.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for i, j in meeting(a, c, starts[k]):
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["a_cell", "c_cell"])

    return spark.range(0, len(starts), 1, len(starts)).mapInArrow(run, "a_cell int, c_cell int")


def _seed_pairs(a: Tree, c: Tree, seeds: int) -> list[tuple[int, int]]:
    """The ``seeds`` cells of candidates with the largest middle product for each cell of anchors."""
    ai, ci = (np.flatnonzero((t.cell >= 0) & (t.radius >= 0)) for t in (a, c))
    out = []
    for i in ai:
        best = np.argsort(-(c.center[ci] @ a.center[i]), kind="stable")[:seeds]
        out += [(int(a.cell[i]), int(c.cell[ci[k]])) for k in best]
    return out


# ---- scores ---------------------------------------------------------------------------------------------------------


def _first(score: np.ndarray, row: np.ndarray, col: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` entries of each row, by falling score; ties by rising column."""
    order = np.lexsort((col, -score, row))
    rows = row[order]
    new = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return order[np.arange(len(rows)) - begin < k]


class _Block:
    def __init__(self, items, dim: int):
        self.q = _matrix(items.field("q"), dim)
        self.row, self.label = (items.field(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
        self.vec_id = items.field("vec_id")
        self.center = self.q.mean(axis=0)
        self.radius = float(np.sqrt(((self.q - self.center) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        self.norm = float(np.sqrt((self.q**2).sum(axis=1).max()))


def _scored(pairs: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """(row, goal, score, vec_id, c_row): in each pair of blocks, the first k rows that each goal of each anchor accepts.

    A task remembers the k best scores of each goal of the blocks of anchors it met last, and neither
    scores a pair nor emits a row that cannot be among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        last: tuple = (None, None)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            a_all, c_all = column("a_items"), column("c_items")
            for n in range(batch.num_rows):
                key = (column("a_cell")[n].as_py(), column("a_part")[n].as_py())
                at = (column("c_cell")[n].as_py(), column("c_part")[n].as_py())
                if key in known:
                    block, goals, best = known[key] = known.pop(key)
                else:
                    items = a_all[n].values
                    block, lists = _Block(items, dim), items.field("goals")
                    starts = lists.offsets.to_numpy()
                    flat = lists.values
                    of = np.repeat(np.arange(len(items)), np.diff(starts))
                    goals = (of, *(flat.field(c).to_numpy(zero_copy_only=False)[starts[0] : starts[-1]] for c in ("goal", "lo", "hi")))
                    best = np.full((len(of), k), -_FAR, np.int64)
                    known[key] = (block, goals, best)
                    if len(known) > 256:
                        known.pop(next(iter(known)))
                of, goal, lo, hi = goals
                if last[0] != at:
                    last = (at, _Block(c_all[n].values, dim))
                other = last[1]
                floor = np.maximum(lo, best[:, -1])
                middle = float(block.center @ other.center)
                na, nc = np.linalg.norm(block.center), np.linalg.norm(other.center)
                reach = block.radius * nc + other.radius * na + block.radius * other.radius + 1 + 1e-9 * block.norm * other.norm
                live = np.flatnonzero((floor <= middle + reach) & (hi >= middle - reach))
                if not len(live):
                    continue
                exact = block.norm * other.norm < 2.0**53
                wanted = np.unique(of[live])
                x = block.q[wanted]
                scores = x @ other.q.T if exact else x.astype(np.int64) @ other.q.astype(np.int64).T
                scores = scores.astype(np.int64)
                fits = (block.label[wanted][:, None] == other.label[None, :]) == same
                if same:
                    fits &= block.row[wanted][:, None] != other.row[None, :]
                line = np.searchsorted(wanted, of[live])
                hits = [(fits[m] & (scores[m] >= floor[g]) & (scores[m] <= hi[g])).nonzero()[0] for g, m in zip(live, line)]
                rows = np.repeat(np.arange(len(live)), [len(h) for h in hits])
                if not len(rows):
                    continue
                cols = np.concatenate(hits)
                found = scores[line[rows], cols]
                keep = _first(found, rows, cols, k)
                rows, cols, found = live[rows[keep]], cols[keep], found[keep]
                for g in np.unique(rows):
                    best[g] = np.sort(np.concatenate([best[g], found[rows == g]]))[::-1][:k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.row[of[rows]]), pa.array(goal[rows]), pa.array(found), other.vec_id.take(pa.array(cols)), pa.array(other.row[cols])], ["row", "goal", "score", "vec_id", "c_row"]
                )

    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, "row long, goal int, score long, vec_id long, c_row long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each goal; Spark keeps only as many a task before they move."""
    order = Window.partitionBy("row", "goal").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "c_row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# ---- search ---------------------------------------------------------------------------------------------------------


class _Search:
    def __init__(self, rows: DataFrame, n: int, anchors: int, dim: int, leaf: int, group: int, cells: int, seeds: int):
        self.spark, self.dim, self.group, self.seeds = rows.sparkSession, dim, group, seeds
        sc = self.spark.sparkContext
        self.anchors = rows.where("anchor")
        self.a_tree, c_tree = _tree_of(self.anchors, anchors, dim, group, cells), _tree_of(rows, n, dim, leaf, cells)
        shared = sc.broadcast(c_tree)
        blocks, sizes = _packed(rows, shared, dim, leaf, [])
        self.c_tree = c_tree.filled({r.cell: r.radius for r in sizes.collect()}, {}, {})
        self.blocks = written(blocks.select(F.col("cell").alias("c_cell"), F.col("part").alias("c_part"), F.col("items").alias("c_items")), "negatives-blocks")
        shared.destroy()

    def first(self, goals: DataFrame, k: int, same: bool) -> DataFrame:
        """The first ``k`` rows of each goal (row, goal, lo, hi) of an anchor, of its own label or of others.

        A first round scores each block of anchors with one block of its nearest cells only; the k-th
        best scores found there raise what the goals accept before the trees meet.
        """
        raised = self._round(goals, k, same, seeds=True)
        kth = raised.where(F.col("place") == k).select(F.col("row").alias("of"), F.col("goal").alias("of_goal"), "score")
        better = goals.join(kth, (F.col("row") == F.col("of")) & (F.col("goal") == F.col("of_goal")), "left").select("row", "goal", F.greatest("lo", F.coalesce("score", "lo")).alias("lo"), "hi")
        return self._round(written(better, "negatives-goals"), k, same, seeds=False)

    def _round(self, goals: DataFrame, k: int, same: bool, seeds: bool) -> DataFrame:
        spark, sc = self.spark, self.spark.sparkContext
        grouped = goals.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("goal", "lo", "hi"))).alias("goals"))
        wanting = self.anchors.join(grouped, F.col("row") == F.col("of")).select("row", "vec_id", "label", "q", "goals")
        shared = sc.broadcast(self.a_tree)
        packed, cells = _packed(wanting, shared, self.dim, self.group, ["goals"])
        a_blocks = written(packed.select(F.col("cell").alias("a_cell"), F.col("part").alias("a_part"), F.col("items").alias("a_items")), "negatives-anchors")
        shared.destroy()
        goal = F.explode(F.flatten(F.col("a_items.goals"))).alias("g")
        wants = a_blocks.select("a_cell", goal).groupBy("a_cell").agg(F.min("g.lo").alias("lo"), F.max("g.hi").alias("hi")).collect()
        a = self.a_tree.filled({r.cell: r.radius for r in cells.collect()}, {r.a_cell: r.lo for r in wants}, {r.a_cell: r.hi for r in wants})
        trees = None
        if seeds:
            cell_pairs = spark.createDataFrame(_seed_pairs(a, self.c_tree, self.seeds), "a_cell int, c_cell int")
            blocks = self.blocks.where("c_part = 0")
        else:
            trees = sc.broadcast((a, self.c_tree))
            cell_pairs, blocks = written(_cell_pairs(spark, trees, _subtrees(a, 64)), "negatives-cells"), self.blocks
        pairs = cell_pairs.join(a_blocks, "a_cell").join(blocks, "c_cell")
        found = written(_scored(pairs, self.dim, k, same), "negatives-found")
        if trees is not None:
            trees.destroy()
        return written(_merged(found, k), "negatives-merged")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    leaf: int = 1024, group: int = 128, cells: int = 4096, seeds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its ``positives`` nearest rows of its label, the ``negatives`` first rows of other labels whose score lies between ``low_percent`` and ``high_percent`` of the positive's.

    A score is the inner product of components floor(256 * x); higher ones
    come first, ties by smaller id.  One tree of balls is fitted over anchors, one over
    all rows, each of ``cells`` leaves at most on a sample of about 16 rows a
    leaf; all rows are placed in them, and leaves cut into blocks of ``group``
    anchors or ``leaf`` rows.  Pairs of nodes whose interval of products no
    anchor below wants are dropped for all its anchors together; blocks of the
    leaf pairs left come together by joins on the leaf and are scored exactly.
    What trees and cells hold has a fixed bound (``cells``); pairs of leaves are made in tasks.
    On vectors without clusters nothing can be pruned, and anchors times rows are scored.

    Rows with a null label, a null vector, or a component that is null or not
    finite take no part, nor do vectors longer than 2 ** 31 / 256, whose
    scores no long holds.  A vector shorter than others has zeros at its end.  A row is
    not its own positive, but another row with its id can be; of equal scores a
    null id comes last.  Repeated anchors each have their rows.  A
    positive with a negative score has no negatives.  No rows, or no anchors, give no rows; other columns are
    ignored, whatever their names.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    numbered = usable.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(F.col(vector_col), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("v"),
    )
    table = written(_quantised(numbered), "negatives-rows")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.max(F.octet_length("q")).alias("bytes")).first()
    if not size.anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    search = _Search(table, size.n, size.anchors, max(1, size.bytes // 4), leaf, group, cells, seeds)
    everything = search.anchors.select("row", F.lit(0).alias("goal"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
    near = search.first(everything, positives, same=True)
    part = lambda percent, up: F.expr(f"score div 100 * {percent} + (score % 100 * {percent} + {up}) div 100")
    windows = near.where("score >= 0").select("row", F.col("place").cast("int").alias("goal"), part(low_percent, 99).alias("lo"), part(high_percent, 0).alias("hi"))
    far = search.first(written(windows, "negatives-windows"), negatives, same=False)
    ids = search.anchors.select("row", F.col("vec_id").alias("anchor_id"))
    positive = near.select("row", F.col("place").alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "row")
    found = far.select("row", "goal", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positive.join(found, ["row", "goal"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
