"""Exact repeated substrings over all documents, found by merging shards' Burrows-Wheeler transforms.

A substring of ``length`` bytes that occurs twice has the same anchor in both
places: of all its short grams, the first in a global order, rare before
frequent.  Neighbouring substrings with one anchor form a strip.  Strips whose
anchor occurs once hold nothing that repeats.  The others are gathered by
anchor, equal strips as one with a weight, and within each part of the anchors
the transforms of small shards of strips are built and merged; the intervals
with common prefixes of ``length`` bytes are the repeats.  An anchor whose
strips all have copies needs no merge: each strip repeats as a whole.  Anchors with very
many strips would be one task's work: their substrings are counted apart, by
digests of 128 bits, which splits them over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .shared import Bits, Scratch, bitmap, map_batches
from .textnp import BLOCK_BYTES, blocks, neighbour_hashes, rolling, string_bytes

#: Bytes of a gram.
GRAM = 32
#: Sizes of the tables that tasks hold, as powers of two in bits.
FREQUENT_BITS, TEXT_BITS, ANCHOR_BITS = 25, 25, 27
LOCAL, FREQUENT = 3, 24
#: Bytes of strips whose transforms are merged at once; larger anchors are taken two parts at a time.
CHUNK_BYTES = 1 << 20
_LOCAL_BYTES = 4 << 20
#: Strips of one anchor, copies included, beyond which its substrings are counted instead.
HOT = 20_000


def _frequent(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One gram in four, those that occur often within some MB of text."""
    buf, off = string_bytes(batch.column("text"))
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in blocks(off, _LOCAL_BYTES):
        part = buf[off[a] : off[b]]
        found = []
        for c in range(0, len(part), 1 << 20):  # grams across documents do no harm: this is only an order
            grams = neighbour_hashes(rolling(part[c : c + (1 << 20) + GRAM - 1]), GRAM)
            found.append(grams[grams & np.uint64(3) == 0])
        values = np.sort(np.concatenate(found)) if found else keys[0]
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else counts[0]
        count = np.diff(np.append(at, len(values)))
        keys.append(values[at[count >= LOCAL]])
        counts.append(count[count >= LOCAL])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], ["gram", "n"])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    table = padded.reshape(-1, width)
    right = np.minimum.accumulate(table, axis=1).reshape(-1)
    left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def _strips(part: np.ndarray, own: np.ndarray, length: int, frequent: Bits) -> tuple[np.ndarray, ...]:
    """Strips of a block: document, start, end and anchor of each.

    A long document is taken in pieces: a strip may end anywhere, as each
    substring lies in one strip.
    """
    if len(own) == 2 and len(part) > 2 * BLOCK_BYTES:
        pieces = []
        for c in range(0, len(part), BLOCK_BYTES):
            piece = part[c : c + BLOCK_BYTES + length - 1]
            doc, begin, end, anchor = _strips(piece, np.array([0, len(piece)]), length, frequent)
            pieces.append((doc, begin + c, end + c, anchor))
        return tuple(np.concatenate(x) for x in zip(*pieces))
    grams = neighbour_hashes(rolling(part), GRAM)
    none = np.zeros(0, np.int64)
    if len(part) < length:
        return none, none, none, none.view(np.uint64)
    # the order: one gram in four before the others, and of those, rare before frequent; then by hash
    order = grams >> np.uint64(2)
    chosen = np.flatnonzero(grams & np.uint64(3) == 0)
    often = chosen[frequent[(grams[chosen] >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)]]
    order |= np.uint64(1 << 63)
    order[chosen] ^= np.uint64(1 << 63)
    order[often] |= np.uint64(1 << 62)
    order &= np.uint64(0xFFFFFFFF00000000)  # equal ones by place
    order |= np.arange(len(grams), dtype=np.uint64)
    spot = _least(order, length - GRAM + 1) & np.uint64(0xFFFFFFFF)
    size = np.diff(own)
    inside = np.flatnonzero(size >= length)
    edge = np.zeros(len(part) + 1, np.int8)
    edge[own[inside]] += 1
    edge[own[inside + 1] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge[: len(part) - length + 1], dtype=np.int8))
    if not len(starts):
        return none, none, none, none.view(np.uint64)
    spot = spot[starts].astype(np.int64)
    new = np.append(True, (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + length
    doc = np.searchsorted(own, begin, "right") - 1
    return doc, begin - own[doc], end - own[doc], grams[spot[first]]


def _names(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: with its anchor or its size, it names a strip or a text."""
    return np.fromiter((xxhash.xxh3_64_intdigest(part[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = string_bytes(column)
    for a, b in blocks(off):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def _strip_rows(batch: pa.RecordBatch, length: int, frequent: Bits) -> pa.RecordBatch:
    kinds = {"anchor": np.int64, "content": np.int64, "text_key": np.int64, "size": np.int64, "start": np.int32}
    columns: list[list] = [[np.zeros(0, k)] for k in kinds.values()]
    for _, _, part, own in _parts(batch.column("text")):
        doc, begin, end, anchor = _strips(part, own, length, frequent)
        content, keys = _names(part, own[doc] + begin, own[doc] + end), _names(part, own[:-1], own[1:])
        for column, x in zip(columns, (anchor.view(np.int64), content.view(np.int64), keys[doc].view(np.int64), np.diff(own)[doc], begin.astype(np.int32))):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], list(kinds))


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _anchored(batch: pa.RecordBatch, repeated: Bits) -> pa.RecordBatch:
    return batch.filter(pa.array(repeated[_slots(batch.column("anchor").to_numpy().view(np.uint64), ANCHOR_BITS)]))


def _distinct_strips(batch: pa.RecordBatch, length: int, frequent: Bits, repeated: Bits, hot: Bits, involved: Bits, of_hot: bool) -> dict[tuple[int, int], list]:
    """[weight, bytes] of each strip with a repeated anchor, by anchor and content; of hot anchors or of the others."""
    found: dict[tuple[int, int], list] = {}
    for _, _, part, own in _parts(batch.column("text")):
        kept = np.flatnonzero(involved[_slots(_names(part, own[:-1], own[1:]), TEXT_BITS)])
        if not len(kept):
            continue
        if len(kept) < len(own) - 1:
            part = np.concatenate([part[own[j] : own[j + 1]] for j in kept.tolist()])
            own = np.append(0, np.cumsum(np.diff(own)[kept]))
        doc, begin, end, anchor = _strips(part, own, length, frequent)
        slot = _slots(anchor, ANCHOR_BITS)
        some = np.flatnonzero(repeated[slot] & (hot[slot] == of_hot))
        begin, end = (own[doc] + begin)[some], (own[doc] + end)[some]
        for a, b, *name in zip(begin.tolist(), end.tolist(), anchor[some].tolist(), _names(part, begin, end).tolist()):
            strip = found.get(name := tuple(name))
            if strip:
                strip[0] += 1
            else:
                found[name] = [1, part[a:b].tobytes()]
    return found


def _strip_bytes(batch: pa.RecordBatch, *tables) -> pa.RecordBatch:
    """The strips of anchors that are not hot, equal ones of a batch as one with a weight."""
    found = _distinct_strips(batch, *tables, False)
    names = np.array(list(found), np.uint64).reshape(-1, 2).view(np.int64)
    arrays = [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "content", "weight", "bytes"])


def _strip_windows(batch: pa.RecordBatch, length: int, *tables) -> pa.RecordBatch:
    """A row for each substring of ``length`` bytes in the strips of hot anchors: its digest of 128 bits and its place in the strip."""
    found = _distinct_strips(batch, length, *tables, True)
    digests = [[xxhash.xxh3_128_digest(x[1][k : k + length]) for k in range(len(x[1]) - length + 1)] for x in found.values()]
    size = [len(h) for h in digests]
    names = np.repeat(np.array(list(found), np.uint64).reshape(-1, 2).view(np.int64), size, axis=0)
    starts = np.concatenate([np.arange(n, dtype=np.int32) for n in size] or [np.zeros(0, np.int32)])
    values = [x for own in digests for x in own]
    weights = np.repeat(np.array([x[0] for x in found.values()], np.int64), size)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), pa.array(weights), pa.array(starts), pa.array(values, pa.binary())], ["anchor", "content", "weight", "start", "window"])


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_MERGED = "anchor long, content long, runs array<struct<a:int,b:int>>"


def _window_runs(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    runs = [[{"a": x, "b": y} for x, y in _runs(np.array(sorted(starts)), length)] for starts in batch.column("starts").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("content"), pa.array(runs, _RUNS)], ["anchor", "content", "runs"])


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered ranges of substrings that start at the given offsets."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _repeats(strips: list[bytes], weights: list[int], groups: list[int], length: int) -> list[np.ndarray]:
    """Starts of repeated substrings in each strip.  ``groups`` numbers the anchors, in order."""
    arrays, weight = [np.frombuffer(x, np.uint8) for x in strips], np.minimum(np.array(weights, np.int64), 2)
    size = np.cumsum([len(x) for x in strips])
    if size[-1] <= 2 * CHUNK_BYTES or groups[0] != groups[-1]:
        return repeated_starts(arrays, weight, length)
    # one anchor with very many strips: any two occurrences lie in some pair of parts
    cut = np.append(np.searchsorted(size, np.arange(0, size[-1], CHUNK_BYTES)), len(strips))
    cut = np.unique(cut)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strips)
    for i in range(len(cut) - 1):
        for j in range(i + 1, len(cut) - 1):
            own = [*range(cut[i], cut[i + 1]), *range(cut[j], cut[j + 1])]
            for k, x in zip(own, repeated_starts([arrays[k] for k in own], weight[own], length)):
                found[k] = np.union1d(found[k], x)
    return found


def _merge_parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strips arrive by anchor; whole anchors are gathered to chunks, and each chunk's transforms merged."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def done(rows: list) -> pa.RecordBatch:
        groups = np.cumsum([0] + [int(a[0] != b[0]) for a, b in zip(rows, rows[1:])])
        weights = np.array([r[2] for r in rows], np.int64)
        # where each strip of an anchor has a copy, all of them repeat as a whole, whatever else they share
        least = np.minimum.reduceat(weights, np.searchsorted(groups, np.arange(groups[-1] + 1)))
        runs = [[(0, len(r[3]))] for r in rows]
        merging = np.flatnonzero(least[groups] < 2).tolist()
        if merging:
            starts = _repeats([rows[k][3] for k in merging], weights[merging].tolist(), groups[merging].tolist(), length)
            for k, x in zip(merging, starts):
                runs[k] = _runs(x, length)
        some = [k for k, x in enumerate(runs) if x]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][0] for k in some], pa.int64()), pa.array([rows[k][1] for k in some], pa.int64()), pa.array([[{"a": x, "b": y} for x, y in runs[k]] for k in some], _RUNS)], ["anchor", "content", "runs"]
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "weight", "bytes"))):
            if held and row[:2] == held[-1][:2]:
                held[-1] = (*row[:2], held[-1][2] + row[2], row[3])
                continue
            if held and row[0] != held[-1][0]:
                if size >= CHUNK_BYTES:
                    yield done(held)
                    held, size = [], 0
                elif size + len(row[3]) >= CHUNK_BYTES and held[0][0] != held[-1][0]:
                    # the last anchor may be large: what came before is a chunk of its own
                    k = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]) + 1
                    yield done(held[:k])
                    held = held[k:]
                    size = sum(len(x[3]) for x in held)
            held.append(row)
            size += len(row[3])
    if held:
        yield done(held)


def _removed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts, and the digest of what is left, of each document with its ranges."""
    n = batch.num_rows
    buf, off = string_bytes(batch.column("text"))
    spans = batch.column("spans")
    removed, count, digests = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    present = spans.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        raw = buf[off[i] : off[i + 1]]
        if not present[i]:
            digests.append(hashlib.sha256(raw).hexdigest())
            continue
        left, end, digest = 0, 0, hashlib.sha256()
        for x, y in sorted((s["a"], s["b"]) for s in spans[i].as_py()):
            if x > end or not count[i]:
                digest.update(raw[end:x])
                count[i] += 1
                left += x - end
            end = max(end, y)
        digest.update(raw[end:])
        removed[i] = end - left
        digests.append(digest.hexdigest())
    arrays = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed), pa.array(count), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, part, own in _parts(batch.column("text")):
        keys.append(_names(part, own[:-1], own[1:]))
        sizes.append(np.diff(own))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes))], ["doc_id", "text", "text_key", "size"])


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """(text_key, size, spans): byte ranges of each distinct text that are covered by repeated substrings.

    ``texts`` has the column text.
    """
    spark = texts.sparkSession
    often = map_batches(texts.select("text"), _frequent, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = spark.sparkContext.broadcast(bitmap(often.select(F.shiftrightunsigned("gram", 64 - FREQUENT_BITS).alias("slot")), "slot", FREQUENT_BITS))
    strips = map_batches(texts.select("text"), lambda b: _strip_rows(b, length, frequent.value), "anchor long, content long, text_key long, size long, start int")
    scratch = Scratch(spark, "repeats")
    strips = scratch.write("strips", strips)
    counts = scratch.write("anchors", strips.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    twice = counts.select("anchor")
    share = spark.sparkContext.broadcast
    repeated = share(bitmap(twice.select(F.shiftrightunsigned("anchor", 64 - ANCHOR_BITS).alias("slot")), "slot", ANCHOR_BITS))
    hot = share(bitmap(counts.where(F.col("n") > HOT).select(F.shiftrightunsigned("anchor", 64 - ANCHOR_BITS).alias("slot")), "slot", ANCHOR_BITS))
    placed = map_batches(strips, lambda b: _anchored(b, repeated.value), strips.schema).distinct()
    placed = scratch.write("anchored", placed.join(twice, "anchor", "left_semi"))
    scratch.clear("strips")
    involved = share(bitmap(placed.select(F.shiftrightunsigned("text_key", 64 - TEXT_BITS).alias("slot")), "slot", TEXT_BITS))
    tables = lambda: (length, frequent.value, repeated.value, hot.value, involved.value)
    data = map_batches(texts.select("text"), lambda b: _strip_bytes(b, *tables()), "anchor long, content long, weight long, bytes binary")
    ordered = data.repartition("anchor").sortWithinPartitions("anchor", "content")
    merged = ordered.mapInArrow(lambda batches: _merge_parts(batches, length), _MERGED)
    if hot.value.any():
        windows = map_batches(texts.select("text"), lambda b: _strip_windows(b, *tables()), "anchor long, content long, weight long, start int, window binary")
        windows = scratch.write("windows", windows)
        again = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
        starts = windows.join(again, "window", "left_semi").groupBy("anchor", "content").agg(F.collect_set("start").alias("starts"))
        merged = merged.union(map_batches(starts, lambda b: _window_runs(b, length), _MERGED))
    merged = scratch.write("merged", merged)
    ranges = placed.join(merged, ["anchor", "content"]).select("text_key", "size", F.explode(F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))).alias("r"))
    spans = scratch.write("spans", ranges.groupBy("text_key", "size").agg(F.collect_list("r").alias("spans")))
    scratch.clear(*[name for name in scratch.paths if name != "spans"])
    return spans


def remove_repeats(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each document without the bytes of repeated substrings.

    Each byte is removed that lies in a string of ``length`` bytes that starts
    anywhere else too, in the same document or another; strings don't cross
    documents and are judged on the texts as they are.  A null text counts as
    empty; copies of a text of ``length`` bytes or more, repeated rows among
    them, lose all bytes; shorter texts stay; no rows give no rows; other
    columns are ignored, whatever their names.  A very long text is cut into
    strips piece by piece.  Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(texts, length)
    spark = documents.sparkSession
    flagged = spark.sparkContext.broadcast(bitmap(spans.select(F.shiftrightunsigned("text_key", 64 - TEXT_BITS).alias("slot")), "slot", TEXT_BITS))
    keyed = f"doc_id {kind}, text string, text_key long, size long"

    def some(batch: pa.RecordBatch, which: bool) -> pa.RecordBatch:
        keys = _keyed(batch)
        return keys.filter(pa.array(flagged.value[_slots(keys.column("text_key").to_numpy().view(np.uint64), TEXT_BITS)] == which))

    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    empty = F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans")
    # only texts with something to remove are moved to their ranges
    clean = map_batches(texts, lambda b: some(b, False), keyed).select("doc_id", "text", empty)
    rest = map_batches(texts, lambda b: some(b, True), keyed).join(spans, ["text_key", "size"], "left").select("doc_id", "text", "spans")
    return map_batches(clean, _removed, result).union(map_batches(rest, _removed, result))
