"""Runs that build on other runs: what each rests on, what is missing, and ids that hash all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import key_digest

#: Steps that a chain of runs has at most.
MOST_LEVELS = 64


def closure(edges: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """run, upstream, depth: everything that each run rests on, with the longest way to it, from ``edges`` (run, upstream).

    A recursive query; a way is followed as often as there are ways, which is
    little for stages of a pipeline.  A way longer than ``most_levels`` is cut
    there, so a run that rests on itself is told by a row with itself as upstream.
    """
    return edges.sparkSession.sql(
        """WITH RECURSIVE ways(run, upstream, depth, seen) MAX RECURSION LEVEL 100 AS (
             SELECT run, upstream, 1, array(run, upstream) FROM {edges}
             UNION ALL
             SELECT w.run, e.upstream, w.depth + 1, array_append(w.seen, e.upstream) FROM ways w JOIN {edges} e ON w.upstream = e.run
             WHERE w.depth < {most} AND w.run <> w.upstream AND NOT array_contains(slice(w.seen, 2, size(w.seen)), e.upstream))
           SELECT run, upstream, max(depth) AS depth FROM ways GROUP BY run, upstream""",
        edges=edges.select("run", "upstream").distinct(), most=most_levels,
    )


def lineage_errors(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """run, upstream, error: ``missing_upstream`` for what a run rests on, at any depth, and is not there; ``cycle`` for a run that rests on itself."""
    known = runs.select(F.col("run").alias("known")).distinct()
    joined = closure(edges).join(known, F.col("upstream") == F.col("known"), "left")
    error = F.when(F.col("known").isNull(), "missing_upstream").when(F.col("run") == F.col("upstream"), "cycle")
    return joined.select("run", "upstream", error.alias("error")).where("error IS NOT NULL")


def run_ids(runs: DataFrame, edges: DataFrame, version: str, prefix: str = "RUN-") -> DataFrame:
    """run, level, run_id: ids that hash the version, the run's own checksum and the ids of all that it rests on directly.

    ``runs`` has run and checksum.  Ids are made level by level, a level of runs after
    all that they rest on, each a join of the edges with the ids so far; a
    run that rests on something missing, or on itself, at any depth has no id.  The number of levels is asked of the
    closure once; it is the length of the chain of stages.
    """
    reach = closure(edges)
    level = reach.groupBy("run").agg(F.max("depth").alias("level"))
    broken = lineage_errors(runs, edges).select(F.col("run").alias("bad"))
    bad = broken.union(reach.join(broken.distinct(), F.col("upstream") == F.col("bad")).select("run")).distinct()
    placed = runs.select("run", "checksum").join(level, "run", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    placed = placed.join(bad, F.col("run") == F.col("bad"), "left").withColumn("fine", F.col("bad").isNull()).drop("bad")
    last = placed.where("fine").agg(F.max("level").alias("last")).first().last
    done = None
    for k in range(0 if last is None else last + 1):
        own = placed.where(F.col("fine") & (F.col("level") == k)).select("run", "checksum")
        if done is None:
            basis = own.withColumn("upstream_ids", F.lit(""))
        else:
            ids = edges.select(F.col("run").alias("of"), "upstream").distinct().join(done.select(F.col("run").alias("upstream"), "run_id"), "upstream").groupBy("of").agg(F.concat_ws(",", F.sort_array(F.collect_list("run_id"))).alias("upstream_ids"))
            basis = own.join(ids, F.col("run") == F.col("of"), "left").select("run", "checksum", F.coalesce("upstream_ids", F.lit("")).alias("upstream_ids"))
        new = basis.select("run", key_digest(prefix, 16, F.lit(version), F.col("run"), F.col("checksum").cast("string"), F.col("upstream_ids")).alias("run_id"))
        done = new if done is None else done.unionByName(new)
    if done is None:
        return placed.select("run", "level", F.lit(None).cast("string").alias("run_id"))
    return placed.select("run", "level").join(done, "run", "left")
