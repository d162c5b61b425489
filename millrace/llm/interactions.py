"""How quality filters overlap: every order of the filters replayed over all documents."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_SPACE = r"[ \x09-\x0D]+"
FILTERS = ("A", "B", "C", "D", "E")


def document_flags(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, part, good, toxic, and for each filter whether the document fails it.

    A: under 200 words; B: under half of the words distinct; C: over 3 % of
    the code points are A to Z; D: a sign of ``#$%&*|``; E: the text of a
    smaller id, wherever that stands.  Texts are equal where their SHA-256
    are; the smallest id of each text is found with map-side combining, so the
    copies of a text never meet; it is written, so that the join that takes it
    back to the documents is one that Spark splits where a text is common.

    A null text is an empty one, a null language the part ''.  A null id is
    neither smaller nor larger than any other and has no label.  Repeated ids
    and rows each count; equal ids are not smaller than each other.  Several
    labels of an id count as one that is good, or toxic, if any is.  No rows
    give no rows; a very long text is one row's array of its words; other
    columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    counted = seen.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.char_length("text").cast("long").alias("points"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("different")))[0].alias("words"),
    )
    flagged = written(
        counted.select(
            "doc_id", "part", "digest", (F.col("words.n") < 200).alias("A"), (100 * F.col("words.different") < 50 * F.col("words.n")).alias("B"),
            (100 * F.col("capitals") > 3 * F.col("points")).alias("C"), "D",
        ),
        "audit-flags",
    )
    ends = flagged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = written(ends.where(F.col("first") < F.col("last")).select("digest", "first"), "audit-first")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return (
        flagged.join(first, "digest", "left")
        .withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
        .join(marks.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
        .select("doc_id", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), *FILTERS)
    )


def replay(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Each order of ``filters`` applied to the rows of ``flags``, counted after each step.

    ``flags`` has part, good, toxic and a boolean column for each filter that
    says whether the row fails it (null: it does not).  Rows that agree in all
    of these are one row with a count before they are crossed with the orders,
    so that the replay works on at most 2 ** (filters + 2) rows a part, however
    many documents there are.  The orders (120 of five filters) go with the
    plan; each crossed row is exploded into its steps, its first failing step
    found, and the counts summed with map-side combining.

    Every part, order and step has a row, zeros included.  Returns part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, the rows that the step's filter removes summed
    over all orders.
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("the orders of 1 to 6 filters can be replayed")
    fails = [F.coalesce(F.col(f), F.lit(False)).alias(f"f{k}") for k, f in enumerate(filters)]
    alike = flags.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), *fails)
    alike = alike.groupBy(*alike.columns).agg(F.count(F.lit(1)).alias("n"))
    orders = F.array(*[F.struct(F.lit("".join(filters[k] for k in o)).alias("filter_order"), F.array(*map(F.lit, o)).alias("at")) for o in permutations(range(len(filters)))])
    failing = F.array(*[f"f{k}" for k in range(len(filters))])
    crossed = alike.withColumn("failing", failing).select("part", "good", "toxic", "n", "failing", F.size(F.filter("failing", lambda x: x)).alias("many"), F.inline(orders))
    stepped = crossed.select("*", F.array_position(F.transform("at", lambda k: F.get("failing", k)), F.lit(True)).alias("first"), F.posexplode("at").alias("pos", "filter"))
    step, fails_here = F.col("pos") + 1, F.get("failing", F.col("filter"))
    removed = F.col("first") == step
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    counts = stepped.groupBy("part", "filter_order", step.cast("int").alias("step"), "filter").agg(
        total((F.col("first") == 0) | (F.col("first") > step)).alias("kept"), total(removed).alias("removed"),
        total(fails_here & (F.col("first") < step)).alias("redundant"), total(fails_here & (F.col("many") == 1)).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit_filters(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The five filters in all 120 orders over whole texts; see ``document_flags`` and ``replay`` for what each row means and for awkward rows."""
    return replay(document_flags(documents, labels, id_col, text_col, lang_col))
