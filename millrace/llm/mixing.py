"""Sources mixed to target weights: packed blocks, drawn counts, permuted indexes, and a join by index.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running_totals
from .shared import written

_WORD = r"[^ \x09-\x0D]+"
_SPACE = r"[ \x09-\x0D]+"
#: Rounds of the index permutations.
ROUNDS = 24
#: Cells of the table that a draw is looked up in.
CELLS = 1024
#: Shards, or copies of a row, that are worked on as one.
CHUNK = 4096
#: Slots whose blocks one task finds: the counts that they come from are so small that Spark would give them all to one.
SLOTS_PER_TASK = 50_000


@dataclass
class Mixture:
    """What a mix is made of.

    ``sources``: source, rank, weight, source_size, target, blocks, wanted.
    ``documents``: source, rank, doc_id, digest, size, copies, start; equal rows are one with ``copies``.
    ``slots``: shard, rank, repeat, block; a row for each block of each output shard.
    """

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    block_words: int


def _bits(*parts) -> Column:
    """60 bits that depend on the parts alone."""
    joined = F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def _permuted(x: Column, n: Column, keys: Column, *names) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 to ``n`` - 1, by the swap-or-not shuffle; ``keys`` has a number below ``n`` for each round."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.get(keys, r) - at, n)
        coin = F.md5(F.concat_ws("|", F.lit("coin"), *[y.cast("string") if isinstance(y, Column) else F.lit(str(y)) for y in names], r.cast("string"), F.greatest(at, other).cast("string")))
        return F.when(coin >= "8", other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, swap)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Of (source, source_size), a row for each source: rank by code point with null last, weight and target.

    Targets share the sum of all sizes by weight; one that would pass ``most``
    times its source's size stays there, and what is left is shared among the
    others, until none is above.  In the order of size by weight the sources that stop come first,
    so the level of the others follows from running sums over this table,
    which has a row for each source.
    """
    all_of, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("rank", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)))
    cap = F.col("source_size") * most
    early = Window.partitionBy(F.lit(0)).orderBy(cap * F.expr(f"{lcm(*weights)} div weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select("*", cap.alias("cap"), (F.sum("source_size").over(all_of) - F.coalesce(F.sum(cap).over(early), F.lit(0))).alias("rest"), (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(early), F.lit(0))).alias("share"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    free = wide("cap") * wide("share") >= wide("rest") * wide("weight")
    level = F.min(F.when(free, F.struct((cap * F.expr(f"{lcm(*weights)} div weight")).alias("at"), "rank", "rest", "share"))).over(all_of)
    shared = (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.share")
    return left.withColumn("level", level).select("source", "rank", "weight", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(shared, F.col("cap").cast("double"))).alias("target"))


def _exploded(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """Each row ``count`` times, with ``name`` from 0; no array is longer than the chunk or the count's part by it."""
    chunks = rows.withColumn("many", count).where(F.col("many") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {CHUNK}"))))
    inside = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("many")) - 1)
    return chunks.withColumn(name, F.explode(inside)).drop("many", "chunk")


def packed(documents: DataFrame, block_words: int) -> DataFrame:
    """The part of each document in each block of its source: rank, block, doc_id, digest, size, copy, from_word, n_words."""
    each = _exploded(documents.where("size > 0"), F.col("copies"), "copy").withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    blocks = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    low = F.greatest(F.col("block") * block_words, F.col("start"))
    high = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    return each.withColumn("block", F.explode(blocks)).select("rank", "block", "doc_id", "digest", "size", "copy", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))


def _drawn(spark, sources: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial counts of each output shard: shard, rank, n.

    Each slot of a shard draws a number below ``slots``; it is looked up in a
    table of the sources' ranges, cut at cells so that it is a join on a key.
    """
    width = slots // CELLS + 1
    cells = F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + wanted - 1) div {width}"))
    table = written(sources.where("wanted > 0").select("rank", "first", (F.col("first") + F.col("wanted")).alias("end"), F.explode(cells).alias("cell")), "mix-cells")
    per_task = max(spark.sparkContext.defaultParallelism, slots // 2_000_000 + 1)
    draws = spark.range(0, slots, 1, per_task).select(F.expr(f"id div {shard_slots}").alias("shard"), (_bits("draw", seed, F.col("id")) % slots).alias("u"))
    draws = draws.withColumn("cell", F.expr(f"u div {width}"))
    return draws.join(table, "cell").where("u >= first AND u < end").groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def _settled(counts: DataFrame, sources: DataFrame, slots: int, seed: int) -> DataFrame:
    """Slots of the shards as (shard, rank, index): each source has as many as it wants in all.

    A source drawn too often gives up its surplus at even steps, so that every
    shard gives about the same share; a permutation of the seats that become
    free deals them to the sources that were drawn too rarely.
    """
    counts = written(running_totals(counts.withColumn("part", F.expr(f"shard div {CHUNK}")), ["rank"], ["shard"], {"before": F.col("n")}, part="part").drop("part"), "mix-counts")
    drawn = counts.groupBy("rank").agg(F.sum("n").alias("drawn"))
    all_of = sources.where("wanted > 0").select("rank", "wanted").join(drawn, "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    all_of = written(all_of.withColumn("surplus", F.greatest(F.lit(0).cast("long"), F.col("drawn") - F.col("wanted"))), "mix-drawn")
    ends = counts.join(all_of, "rank").withColumn("upto", F.col("before") + F.col("n"))
    kept = ends.withColumn("index", F.expr("before - before * surplus div drawn")).withColumn("kept", F.expr("upto - upto * surplus div drawn") - F.col("index"))
    tasks = max(kept.sparkSession.sparkContext.defaultParallelism, slots // SLOTS_PER_TASK + 1)
    regular = _exploded(kept.repartition(tasks, "shard", "rank"), F.col("kept"), "k").select("shard", "rank", (F.col("index") + F.col("k")).alias("index"))
    over = kept.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("free")).where("free > 0").withColumn("part", F.expr(f"shard div {CHUNK}"))
    seats = _exploded(running_totals(over, [], ["shard"], {"at": F.col("free")}, part="part"), F.col("free"), "k").select("shard", (F.col("at") + F.col("k")).alias("seat"))
    whole, early = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    short = all_of.withColumn("lack", F.col("wanted") - F.col("drawn")).where("lack > 0")
    short = short.withColumn("at", F.coalesce(F.sum("lack").over(early), F.lit(0))).withColumn("all", F.sum("lack").over(whole))
    short = written(short.withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: _bits("seat", seed, r) % F.col("all"))), "mix-short")
    needs = _exploded(short, F.col("lack"), "k").select("rank", _permuted(F.col("at") + F.col("k"), F.col("all"), F.col("keys"), "seat", seed).alias("seat"), (F.col("drawn") + F.col("k")).alias("index"))
    return regular.unionByName(seats.join(needs, "seat").select("shard", "rank", "index"))


def mix(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, block_words: int = 128, shard_slots: int = 1024, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mixture:
    """A mix of all documents in which each source's words come near its target.

    The words of a source, documents in the order of a hash, are packed into
    blocks of ``block_words``.  The mix has output shards of ``shard_slots``
    slots, one block each.  Each shard draws how many of its slots go to each
    source, multinomially by the targets; draws beyond a source's share of all
    slots pass to sources that were drawn too rarely (about the square root of
    all slots), so that targets are met to a block and no block, hence no
    document, is taken more than ``most`` times, which plain draws cannot
    promise.  The k-th slot of a source takes the k-th block of a pseudorandom
    permutation of its blocks, a new one each time they are used up.  All
    draws are MD5 of numbers, so reruns agree, on any cluster.

    Equal rows are counted as one before anything moves; running sums have two
    levels, so that no source is ordered by one task.  What has a row for each
    source (``source_targets``) is one task's.

    A null or empty text has no words and is never taken; a null source is a
    source of its own, the last; repeated ids and rows each take part; no rows
    give no rows; other columns are ignored, whatever their names; a very long
    text is a row for each of its blocks, without its words.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.sha2(text.cast("binary"), 256).alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"))
    alike = written(sized.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    own = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sources = source_targets(own, weights, most).withColumn("blocks", blocks).withColumn("wanted", wanted)
    first = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = written(sources.withColumn("first", F.coalesce(F.sum("wanted").over(first), F.lit(0))), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("n")).first().n

    place = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest"))
    ranks = sources.select(F.col("source").alias("of"), "rank")
    placed = alike.join(ranks, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("place", place).withColumn("part", F.substring("place", 1, 2))
    order = ["place", "doc_id", "digest"]
    ordered = written(running_totals(placed, ["rank"], order, {"start": F.col("size") * F.col("copies")}, part="part").drop("part", "place"), "mix-documents")

    settled = _settled(_drawn(spark, sources, total, shard_slots, seed), sources, total, seed)
    keys = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: _bits("key", seed, F.col("rank"), e, r) % F.col("blocks")))
    keyed = settled.join(written(sources.where("wanted > 0").select("rank", "blocks", keys.alias("keys")), "mix-keys"), "rank").withColumn("repeat", F.expr("index div blocks").cast("int"))
    block = _permuted(F.col("index") % F.col("blocks"), F.col("blocks"), F.get("keys", F.col("repeat")), seed, F.col("rank"), F.col("repeat"))
    return Mixture(sources, ordered, keyed.select("shard", "rank", "repeat", block.alias("block")), block_words)


def taken_words(mixture: Mixture) -> DataFrame:
    """doc_id, size, source_size, target, and taken, the words of it that the mix takes; a row for each row of the documents."""
    times = mixture.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = packed(mixture.documents, mixture.block_words).join(times, ["rank", "block"], "left")
    counts = parts.groupBy("rank", "doc_id", "digest", "size", "copy").agg(F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).alias("taken"))
    empty = _exploded(mixture.documents.where("size = 0"), F.col("copies"), "copy").select("rank", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    own = mixture.sources.select("rank", "source", "source_size", "target")
    return counts.select("rank", "doc_id", "size", "taken").unionByName(empty).join(own, "rank").select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(documents: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: shard, rank, repeat, block, and text, the words of the block in order with single spaces; the words of a block come together by its index."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = documents.select(F.col(id_col).alias("of_id"), F.sha2(text.cast("binary"), 256).alias("of_digest"), text.alias("text")).dropDuplicates(["of_id", "of_digest"])
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    docs = mixture.documents.where("size > 0").join(texts, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")))
    each = _exploded(docs, F.col("copies"), "copy").withColumn("start", F.col("start") + F.col("copy") * F.col("size")).withColumn("words", words)
    length = mixture.block_words
    blocks = F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}"))

    def piece(b: Column) -> Column:
        low, high = F.greatest(b * length, F.col("start")), F.least((b + 1) * length, F.col("start") + F.col("size"))
        return F.struct(b.alias("block"), low.alias("at"), F.array_join(F.slice("words", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")), " ").alias("text"))

    pieces = each.select("rank", F.inline(F.transform(blocks, piece)))
    whole = pieces.groupBy("rank", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    return mixture.slots.join(whole, ["rank", "block"])
