"""Near-duplicates by a grouped prefix join on word shingles.

Two documents link when their shingle sets overlap by the threshold.  Sets
that are equal are one class.  In a global order of shingles, rare before
frequent, linked sets share a shingle among their first ``n - ceil(t n) + 1``,
the prefix.  Classes with the same prefix and size are one group; groups are
indexed and filtered as units and only then expanded to classes, which are
verified on their whole texts.

The join has two rounds.  In the first, each list of the index meets only its
hub, the group in whose prefix the shingle stands first: of the variants of
one text, the one with the least words of its own.  That ties copies together
in at most as many pairs as the index has rows.  In the second, only groups that are still in different components meet,
so that thousands of copies are never compared with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .graph import components
from .shared import Bits, Scratch, bitmap, free_name, map_batches
from .textnp import blocks, digests, mix, new_key, shingle_sets, string_bytes

#: Groups of one list that meet in one task; longer lists are met block by block.
BLOCK = 512
#: Sizes of the tables that tasks hold, as powers of two in bits, whatever the input.
FREQUENT_BITS, WANTED_BITS = 25, 25
#: Occurrences from which a shingle may count as frequent; the least power of two that leaves ``MOST_FREQUENT`` of them.
FREQUENT, MOST_FREQUENT = 8, 1 << 22
#: Bits of a shingle's hash by which it is counted.
COUNT_BITS = 40
#: Counts and index are made in passes that each take a part of the shingles, which bounds the disk.
PASSES = 2


class Words(NamedTuple):
    """Words of a shingle, and the key that this run hashes them with."""

    width: int
    key: int


def _sets(column: pa.Array, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, off = string_bytes(column)
    for a, b in blocks(off):
        values, cut = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], words.width, words.key)
        yield a, values, cut


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _counted(batch: pa.RecordBatch, words: Words, part: int) -> pa.RecordBatch:
    """The shingles of a batch that belong to a pass, and in how many of its documents each is."""
    found = [(v >> np.uint64(64 - COUNT_BITS))[v % np.uint64(PASSES) == part] for _, v, _ in _sets(batch.column("text"), words)]
    values, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count.astype(np.int32))], ["shingle", "n"])


def _frequent(texts: DataFrame, scratch: Scratch, words: Words) -> Bits:
    """Slots of frequent shingles.

    Every shingle of every document is counted.  At most ``MOST_FREQUENT`` are
    taken, the most frequent, so the table never fills.
    """
    counts = []
    for part in range(PASSES):
        seen = map_batches(texts.select("text"), lambda b, part=part: _counted(b, words, part), "shingle long, n int")
        counts.append(scratch.write(f"frequent-{part}", seen.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)))
    often = reduce(DataFrame.union, counts)
    sizes = {r.k: r.n for r in often.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each power of two
    least, total = FREQUENT, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > MOST_FREQUENT:
            least = 2 << k
            break
    found = bitmap(often.where(F.col("n") >= least).select(F.shiftrightunsigned("shingle", COUNT_BITS - FREQUENT_BITS).alias("slot")), "slot", FREQUENT_BITS)
    return found


def _prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _class_names(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set, which names its class."""
    return [xxhash.xxh3_128_digest(values[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_NAME = pa.binary()


def _bits(values: np.ndarray) -> bytes:
    """Parities of a set's shingles by slot; two slots and more for a shingle, as a power of two of them."""
    slots = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    return np.packbits(np.bincount((mix(values) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).tobytes()


def _differing(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of the two sets only: the slots whose parities differ."""
    if len(x) < len(y):
        x, y = y, x
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(one) > len(two):
        one = np.bitwise_xor.reduce(one.reshape(-1, len(two)), axis=0)
    return int(np.bitwise_count(one ^ two).sum())


def _describe(batch: pa.RecordBatch, words: Words, percent: int, frequent: Bits) -> pa.RecordBatch:
    """Text digest, size, class, group, parities and prefix of each document's set.

    The order of shingles: rare before frequent ones, each by hash.
    """
    size, own, group, bits, prefix, cuts, texts = [], [], [], [], [], [np.zeros(1, np.int64)], []
    buf, off = string_bytes(batch.column("text"))
    for a, b in blocks(off):
        part, inner = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        values, cut = shingle_sets(part, inner, words.width, words.key)
        texts += digests(part, inner)
        n = np.diff(cut)
        rare = ~frequent[_slots(values, FREQUENT_BITS)]
        length = np.where(n > 0, _prefix_length(n, percent), 0)
        chosen = []
        for x, y, p in zip(cut[:-1].tolist(), cut[1:].tolist(), length.tolist()):
            v = values[x:y]
            first = v[rare[x:y]][:p]
            chosen.append(first if len(first) == p else np.concatenate([first, v[~rare[x:y]][: p - len(first)]]))
        tops = np.concatenate(chosen) if chosen else values[:0]
        ends = np.cumsum(length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tops ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
        size.append(n)
        own += _class_names(values, cut)
        bits += [_bits(values[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        group.append(mix(sums[ends] - sums[ends - length] + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        prefix.append(tops)
        cuts.append(cuts[-1][-1] + ends)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(prefix).view(np.int64)))
    arrays = [batch.column("doc_id"), batch.column("slot"), pa.array(texts, _NAME), pa.array(np.concatenate(size)), pa.array(own, _NAME), pa.array(np.concatenate(group).view(np.int64)), pa.array(bits, _NAME), lists]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "slot", "text_key", "n", "cid", "gid", "bits", "prefix"])


def _entries(batch: pa.RecordBatch, wanted: Bits, part: int) -> pa.RecordBatch:
    """(shingle, group, size, place in the prefix) of wanted documents, for the shingles of a pass."""
    batch = batch.filter(pa.array(wanted[batch.column("slot").to_numpy()]))
    lists = batch.column("prefix")
    cut = lists.offsets.to_numpy()
    length = np.diff(cut)
    values = lists.flatten().to_numpy()
    place = np.arange(len(values)) - np.repeat(cut[:-1] - cut[0], length)
    keep = values.view(np.uint64) % np.uint64(PASSES) == part
    each = lambda c, kind: np.repeat(batch.column(c).to_numpy(), length)[keep].astype(kind)
    return pa.RecordBatch.from_arrays([pa.array(values[keep]), pa.array(each("gid", np.int64)), pa.array(each("n", np.int32)), pa.array(place[keep].astype(np.int32))], ["s", "gid", "n", "at"])


def _wanted_texts(batch: pa.RecordBatch, words: Words, wanted: Bits) -> pa.RecordBatch:
    """Class and text of each wanted document."""
    batch = batch.filter(pa.array(wanted[batch.column("slot").to_numpy()]))
    names = [name for _, values, cut in _sets(batch.column("text"), words) for name in _class_names(values, cut)]
    return pa.RecordBatch.from_arrays([pa.array(names, _NAME), batch.column("text")], ["cid", "text"])


def _shingles(text: str, words: Words) -> set[bytes]:
    all_of, width = text.encode().lower().split(), words.width
    return {b" ".join(all_of[i : i + width]) for i in range(max(1, len(all_of) - width + 1))}


def _verify(batch: pa.RecordBatch, words: Words, percent: int) -> pa.RecordBatch:
    """The pairs that link: counted by hash first, then confirmed on the bytes of their shingles."""
    keep = np.zeros(batch.num_rows, bool)
    last: tuple[str, set[bytes]] = ("", set())
    for first, left, left_cut in _sets(batch.column("x"), words):
        n = len(left_cut) - 1
        for at, right, cut in _sets(batch.column("y").slice(first, n), words):
            for i in range(len(cut) - 1):
                row = first + at + i
                a, b = left[left_cut[at + i] : left_cut[at + i + 1]], right[cut[i] : cut[i + 1]]
                same = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * same >= percent * (len(a) + len(b) - same):
                    x, y = batch.column("x")[row].as_py(), _shingles(batch.column("y")[row].as_py(), words)
                    if x != last[0]:
                        last = (x, _shingles(x, words))
                    same = len(last[1] & y)
                    keep[row] = 100 * same >= percent * (len(last[1]) + len(y) - same)
    return batch.select(["a", "b"]).filter(pa.array(keep))


def _possible(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Pairs whose sets differ in too few slots to be ruled out."""
    differ = np.array([_differing(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], np.int64)
    both = batch.column("n").to_numpy().astype(np.int64) + batch.column("o").to_numpy()
    # sets of ``both`` shingles with ``differ`` in one only overlap by (both - differ) / 2 at most
    return batch.select(["a", "b"]).filter(pa.array((100 + percent) * (both - differ) >= 2 * percent * both))


def _verified(texts: DataFrame, described: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, words: Words, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: parities rule most others out before texts are moved."""
    share = texts.sparkSession.sparkContext.broadcast

    def involved(pairs: DataFrame, step: str) -> tuple[DataFrame, Bits]:
        found = scratch.write(f"{name}-{step}", pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "slot", "n"), "cid"))
        return found, share(bitmap(found, "slot", WANTED_BITS))

    def joined(pairs: DataFrame, sides: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
        for key, k in (("a", 1), ("b", 2)):
            pairs = pairs.join(sides.select(F.col("cid").alias(key), *[F.col(c[0]).alias(c[k]) for c in columns]), key)
        return pairs.select("a", "b", *[c[k] for c in columns for k in (1, 2)])

    pairs = scratch.write(f"{name}-pairs", pairs)
    known, one = involved(pairs, "known")
    of_one = lambda b: b.filter(pa.array(one.value[b.column("slot").to_numpy()])).select(["cid", "n", "bits"])
    parities = map_batches(described.select("slot", "cid", "n", "bits"), of_one, "cid binary, n long, bits binary")
    parities = scratch.write(f"{name}-parities", parities.join(known.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))
    left = scratch.write(f"{name}-left", map_batches(joined(pairs, parities, ("n", "n", "o"), ("bits", "x", "y")), lambda b: _possible(b, percent), "a binary, b binary"))
    one.destroy()
    scratch.clear(f"{name}-parities")
    known, two = involved(left, "compared")
    whole = map_batches(texts, lambda b: _wanted_texts(b, words, two.value), "cid binary, text string")
    whole = scratch.write(f"{name}-texts", whole.join(known.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))
    links = scratch.write(f"{name}-links", map_batches(joined(left, whole, ("text", "x", "y")), lambda b: _verify(b, words, percent), "a binary, b binary"))
    two.destroy()
    scratch.clear(f"{name}-texts")
    return links


def _sizes_fit(n: Column, o: Column, percent: int) -> Column:
    return 100 * F.least(n, o) >= percent * F.greatest(n, o)


def _enough(overlap: Column, n: Column, o: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (n + o)


def _roots(texts: DataFrame, described: DataFrame, classes: DataFrame, scratch: Scratch, words: Words, percent: int) -> DataFrame:
    """(node, root) for the classes that link with others.

    ``classes`` has gid, cid, n, and the slot of one document of each.
    """
    share = texts.sparkSession.sparkContext.broadcast
    groups = scratch.write("groups", classes.groupBy("gid").agg(F.min("cid").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k")))
    chosen = share(bitmap(classes, "slot", WANTED_BITS))
    # the index: only shingles in the prefixes of two groups or more
    prefixed = described.select("slot", "gid", "n", "prefix")
    parts = []
    for part in range(PASSES):
        raw = scratch.write(f"index-{part}", map_batches(prefixed, lambda b, part=part: _entries(b, chosen.value, part), "s long, gid long, n int, at int"))
        twice = raw.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("s")
        parts.append(scratch.write(f"shared-{part}", raw.join(twice, "s", "left_semi")))
        scratch.clear(f"index-{part}")
    each = reduce(DataFrame.union, parts).groupBy("s", "gid", "n").agg(F.min("at").alias("at"))
    lists = each.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("at", "gid", "n")).alias("hub")).where("m > 1")
    entries = scratch.write("entries", each.join(lists, "s"))
    chosen.destroy()
    members = classes.select("gid", "cid")

    # first round: each list's hub with the others, of it one class with all of theirs
    n, o = F.col("hub.n"), F.col("n")
    star = entries.where((F.col("gid") != F.col("hub.gid")) & _sizes_fit(n, o, percent) & _enough(F.least(n - F.col("hub.at"), o - F.col("at")), n, o, percent))
    star = scratch.write("star", star.select(F.least("hub.gid", "gid").alias("g"), F.greatest("hub.gid", "gid").alias("h")).distinct())
    within = groups.where("k > 1").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    of_first = groups.select(F.col("gid").alias("g"), F.col("first").alias("a"))
    pairs = star.union(within).join(of_first, "g").join(members.select(F.col("gid").alias("h"), F.col("cid").alias("b")), "h").where("a <> b").select("a", "b")
    links = _verified(texts, described, classes, pairs, scratch, "first", words, percent)
    tied = scratch.write("tied", components(links))

    # second round: groups of one list whose components differ; a group of several components (no root) differs from all
    rooted = scratch.write("rooted", members.join(tied, F.col("cid") == F.col("node"), "left").select("gid", "cid", F.coalesce("root", "cid").alias("root")))
    of_group = rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    of_group = scratch.write("group-roots", of_group.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("root")))
    placed = entries.select("s", "gid", "n", "at").join(of_group, "gid")
    mixed = placed.groupBy("s").agg(F.count(F.lit(1)).alias("m"), (F.min("root").eqNullSafe(F.max("root")) & (F.count("root") == F.count(F.lit(1)))).alias("one"))
    placed = placed.join(mixed.where("not one").select("s", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "s")
    placed = scratch.write("mixed", placed.withColumn("own", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")))
    scratch.clear("entries")
    x = placed.select("*", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)).alias("other")).alias("x")
    y = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("other")).alias("y")
    n, o = F.col("x.n"), F.col("y.n")
    apart = F.col("x.root").isNull() | F.col("y.root").isNull() | (F.col("x.root") != F.col("y.root"))
    once = (F.col("x.own") < F.col("y.own")) | (F.col("x.gid") < F.col("y.gid"))
    # what matches lies at the first shingle that both have, or behind it: a variant of a text with many rare shingles
    # of its own has the frequent ones too late in its prefix
    first = _enough(F.least(n - F.col("x.at"), o - F.col("y.at")), n, o, percent)
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own")) & once & apart & _sizes_fit(n, o, percent) & first)
    met = met.select(F.least("x.gid", "y.gid").alias("g"), F.greatest("x.gid", "y.gid").alias("h")).distinct()
    # what the first round has compared in full is not compared again
    single = groups.where("k = 1").select(F.col("gid").alias("g"))
    met = met.join(star.join(single, "g", "left_semi").join(single.select(F.col("g").alias("h")), "h", "left_semi"), ["g", "h"], "left_anti")
    several = of_group.where(F.col("root").isNull()).select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    one, two = rooted.select(F.col("gid").alias("g"), F.col("cid").alias("a"), F.col("root").alias("r")), rooted.select(F.col("gid").alias("h"), F.col("cid").alias("b"), F.col("root").alias("q"))
    pairs = met.union(several).join(one, "g").join(two, "h").where("r <> q and (g <> h or a < b)").select("a", "b")
    more = _verified(texts, described, classes, pairs, scratch, "second", words, percent)
    named = tied.select(F.col("node").alias("cid"), F.col("root").alias("up"))
    of = lambda c: more.join(named, F.col(c) == F.col("cid"), "left").withColumn(c, F.coalesce("up", c)).select("a", "b")
    more = of("a")
    more = scratch.write("between", of("b"))
    upper = scratch.write("upper", components(more).select(F.col("node").alias("up"), F.col("root").alias("top")))
    joined = tied.join(upper, F.col("root") == F.col("up"), "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(tied, F.col("up") == F.col("node"), "left_anti").select(F.col("up").alias("node"), F.col("top").alias("root"))
    roots = scratch.write("components", joined.union(alone))
    scratch.clear("mixed", *[f"shared-{part}" for part in range(PASSES)])
    return roots


def _components(documents: DataFrame, scratch: Scratch, words: Words, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, cid) of every document, and (cid, root) of every class."""
    slot = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 64 - WANTED_BITS)
    texts = documents.select(F.col(id_col).alias("doc_id"), slot.alias("slot"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    frequent = documents.sparkSession.sparkContext.broadcast(_frequent(texts, scratch, words))
    described = map_batches(texts, lambda b: _describe(b, words, percent, frequent.value), f"doc_id {kind}, slot long, text_key binary, n long, cid binary, gid long, bits binary, prefix array<long>")
    described = scratch.write("sets", described)
    classes = scratch.write("classes", described.where("n > 0").groupBy("gid", "cid").agg(F.first("n").cast("int").alias("n"), F.min("slot").alias("slot")))
    roots = _roots(texts, described, classes, scratch, words, percent)
    sizes = scratch.write("sizes", described.select("doc_id", "text_key", "n", "cid"))
    named = scratch.write("named", classes.select("cid").join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root")))
    frequent.destroy()
    scratch.clear("sets")
    return sizes, named


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size and component of every document under links of Jaccard similarity >= percent / 100.

    The set of a document holds its distinct shingles of ``width`` words, A-Z
    in lower case, split at white space; with fewer words, the whole sequence
    is one shingle.  No pair of different sets that links is lost: whatever
    the first round leaves in different components meets in the second.  Equal
    sets are one class and are never expanded into pairs.  Candidates are found
    by 64-bit hashes and confirmed on the bytes of their shingles; classes are
    named by 128-bit digests of their hashes.  Words are hashed with a key that
    each run draws, so no texts can be made whose words agree: two given
    ones do with a chance of 2 ** -64.

    A text that is null, empty or without words has an empty set and links
    with nothing: its component is its own id.  Rows that repeat an id and
    text share a component; a null id is never the smallest.  A very long text
    is handled whole in one task, which takes some 60 bytes for each of its
    words.  An empty table gives no rows; other columns are ignored, whatever
    their names.  Returns doc_id, n_shingles, component_id.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    sizes, named = _components(documents, scratch, Words(width, new_key()), percent, id_col, text_col)
    joined = sizes.where("n > 0").join(named, "cid")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    some = joined.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _with_key(batch: pa.RecordBatch, text: str, key: str) -> pa.RecordBatch:
    column = batch.column(text)
    return batch.append_column(key, pa.array(digests(*string_bytes(column if pa.types.is_string(column.type) else column.cast(pa.string()))), _NAME))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, and of equal ids that with the smallest text digest.

    A null id comes after all others; rows that repeat the id and text that
    stay are one document.  Documents without words (null and empty texts)
    link with nothing and all stay.  An empty table stays empty.  All columns
    stay as they are, whatever their names.  Only documents of components of
    two or more are moved, by the digest of their text.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    sizes, named = _components(documents, scratch, Words(width, new_key()), percent, id_col, text_col)
    joined = sizes.where("n > 0").join(named, "cid")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    best = joined.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.min(order).alias("one")).where("k > 1").select("root", "one")
    fate = joined.join(best, "root").select("text_key", F.col("doc_id").alias("id"), (order == F.col("one")).alias("stays")).distinct()
    fate = scratch.write("fate", fate)
    keys = fate.select(F.conv(F.substring(F.hex("text_key"), 1, 8), 16, 10).cast("long").alias("slot"))
    moved = documents.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.shiftright("slot", 32 - WANTED_BITS).alias("slot")), "slot", WANTED_BITS))
    key = free_name(documents, "text_key")
    schema = StructType([*documents.schema.fields, StructField(key, BinaryType())])

    def some(batch: pa.RecordBatch, which: bool) -> pa.RecordBatch:
        keyed = _with_key(batch, text_col, key)
        slot = np.array([int.from_bytes(x[:4], "big") for x in keyed.column(key).to_pylist()], np.int64) >> (32 - WANTED_BITS)
        return keyed.filter(pa.array(moved.value[slot] == which))

    clean = map_batches(documents, lambda b: some(b, False), schema).drop(key)
    rest = map_batches(documents, lambda b: some(b, True), schema).alias("d")
    told = rest.join(fate.alias("f"), (F.col(f"d.{key}") == F.col("f.text_key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("f.id")), "left").where(F.coalesce("f.stays", F.lit(True)))
    # rows that are told apart from no other: those of a text that stays are one
    apart = told.where(F.col("f.stays").isNull()).select("d.*").drop(key)
    one = told.where(F.col("f.stays")).select("d.*").dropDuplicates([id_col, key]).drop(key)
    return clean.union(apart).union(one)
