"""Data-quality rules as a catalogue: each has an id and a kind, and is found and run by its id."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import Rule, check_rows


#: Tasks that count keys; up to 200, Spark's default for ``spark.shuffle.sort.bypassMergeThreshold``, rows that move are not sorted in memory.
PARTS = 200


def _listed(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: What breaks a rule of each kind, as a condition in plain SQL over one row.  A null breaks only ``required``.
KINDS: dict[str, Callable[..., str]] = {
    "required": lambda column: f"{column} IS NULL",
    "filled": lambda column: f"{column} IS NULL OR trim({column}) = ''",
    "range": lambda column, low, high: f"NOT {column} BETWEEN {low} AND {high}",
    "domain": lambda column, *values: f"{column} NOT IN ({_listed(values)})",
    "order": lambda low, high: f"{low} > {high}",
    "conditional": lambda when, then: f"({when}) AND NOT ({then})",
}


@dataclass(frozen=True)
class Entry:
    """One rule of a catalogue: ``kind`` names what breaks it, ``args`` are the kind's."""

    rule_id: str
    dataset: str
    dimension: str
    severity: str
    kind: str
    args: tuple

    @property
    def broken(self) -> str:
        if self.kind not in KINDS:
            raise ValueError(f"rule {self.rule_id} has no known kind: {self.kind}")
        return KINDS[self.kind](*self.args)


def catalogue(entries: Iterable[Entry]) -> dict[str, Entry]:
    """Entries by id; two of one id are an error."""
    out: dict[str, Entry] = {}
    for e in entries:
        if e.rule_id in out:
            raise ValueError(f"two rules have the id {e.rule_id}")
        out[e.rule_id] = e
    return out


def run_rules(known: dict[str, Entry], tables: Callable[[str], DataFrame], rule_ids: Sequence[str] | None = None) -> DataFrame:
    """A result row for each of ``rule_ids`` (all rules without them); the rules of a dataset are one pass over it.  An id that the catalogue lacks is an error."""
    wanted = list(known) if rule_ids is None else list(rule_ids)
    if unknown := [x for x in wanted if x not in known]:
        raise ValueError(f"no such rules: {unknown}")
    by: dict[str, list[Rule]] = {}
    for x in wanted:
        e = known[x]
        by.setdefault(e.dataset, []).append(Rule(x, e.dataset, e.dimension, e.severity, F.coalesce(F.expr(e.broken), F.lit(False))))
    return reduce(DataFrame.unionByName, [check_rows(tables(name), rules) for name, rules in by.items()])


@dataclass(frozen=True)
class Reference:
    """``key`` of ``child`` must stand in ``parent_key`` of ``parent``."""

    child: str
    key: str
    parent: str
    parent_key: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.key}"


def reference_keys(tables: Callable[[str], DataFrame], references: Sequence[Reference]) -> DataFrame:
    """spec, key, n, known: for each reference, every key of the child with how many rows have it, and whether the parent has it.

    Keys of both sides are tagged rows of one aggregation, no join; whole
    numbers are compared as such, others as text; only the columns of keys are read.
    They are counted twice, first by the task that read them: a key that very
    many rows share is so counted by as many tasks as read it, and no task
    that reads a table holds its keys.  What a task of either count holds is
    the share ``PARTS`` of the keys.
    """
    frames = {t: tables(t) for t in dict.fromkeys(t for x in references for t in (x.child, x.parent))}
    whole = lambda x: all(isinstance(frames[t].schema[k].dataType, T.IntegralType) for t, k in ((x.child, x.key), (x.parent, x.parent_key)))
    names = F.array(*[F.lit(x.name) for x in references])
    counted = []
    for kind in ("long", "string"):
        sides = []
        for at, x in enumerate(references):
            if whole(x) == (kind == "long"):
                side = lambda t, k, n: frames[t].select(F.lit(at).alias("at"), F.col(k).cast(kind).alias("key"), F.lit(n).cast("long").alias("n"), F.lit(n == 0).alias("known"), F.spark_partition_id().alias("reader"))  # noqa: B023, E731
                sides += [side(x.child, x.key, 1), side(x.parent, x.parent_key, 0).where("key IS NOT NULL")]
        if sides:
            keys = reduce(DataFrame.unionByName, sides)
            for by in (["at", "key", "reader"], ["at", "key"]):
                keys = keys.repartition(PARTS, *by).groupBy(*by).agg(F.sum("n").alias("n"), F.max("known").alias("known"))
            counted.append(keys.where("n > 0").select(F.get(names, F.col("at")).alias("spec"), F.col("key").cast("string").alias("key"), "n", "known"))
    return reduce(DataFrame.unionByName, counted)


def reference_totals(keys: DataFrame, references: Sequence[Reference]) -> DataFrame:
    """spec, n_rows, orphans, unset: a row for each reference, 0 where its child has no rows.  Keys are summed before they meet the names."""
    names = keys.sparkSession.createDataFrame([(x.name,) for x in references], "name string")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = keys.groupBy("spec").agg(F.sum("n").alias("n_rows"), total(F.col("key").isNotNull() & ~F.col("known")).alias("orphans"), total(F.col("key").isNull()).alias("unset"))
    return names.join(sums, F.col("name") == F.col("spec"), "left").select(F.col("name").alias("spec"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "orphans", "unset")])


def orphan_keys(keys: DataFrame) -> DataFrame:
    """spec, key, n of the keys that no parent has."""
    return keys.where("key IS NOT NULL AND NOT known").select("spec", "key", "n")
