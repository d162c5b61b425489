"""Benchmark decontamination with an FM-index for each shard of training text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .shared import free_name, map_batches, written
from .textnp import ALNUM, LOWER, blocks, equal_spans, hash_spans, new_key, string_bytes, word_spans

#: Bytes of benchmark text in one block of test phrases; each block is a pass over the documents.
PHRASE_BLOCK_BYTES = 16 << 20
#: Bytes of documents in one shard, which has an FM-index of its own.
SHARD_BYTES = 2 << 20


@dataclass
class Phrases:
    """The test phrases of a block of items, as symbols of the block's own words."""

    words: np.ndarray  # sorted word hashes; a word's symbol is its place + 1
    sieve: np.ndarray  # true at the low 16 bits of each word hash
    pairs: np.ndarray  # sorted symbol pairs that stand in some phrase
    by_length: dict[int, np.ndarray] = field(default_factory=dict)  # distinct phrases, a row each
    items: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # offsets by phrase, item places
    names: list[str] = field(default_factory=list)
    key: int = 0  # of the word hashes
    spelling: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint8), np.zeros(1, np.int64))  # bytes of the words, and where each begins

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        near = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[near]), len(self.words) - 1)
        out[near] = np.where(self.words[at] == hashes[near], at + 1, 0)
        return out


def make_phrases(ids: list, texts: list, width: int) -> Phrases | None:
    """Windows of ``width`` words of each item, or the whole of a shorter one; an item without an id has no name."""
    buf, off = string_bytes(pa.array(texts, pa.string()))
    low = LOWER[buf]
    s, e, first = word_spans(low, off, ALNUM)
    if not len(s):
        return None
    while True:  # with another key, should two words of the block have one hash
        key = new_key()
        hashes = hash_spans(low, s, e, key)
        words, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if equal_spans(low, s, e, low, s[one][which], e[one][which]).all():
            break
    sizes = (e - s)[one]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    letters = low[np.repeat(s[one] - begin[:-1], sizes) + np.arange(begin[-1])]
    sieve = np.zeros(1 << 16, bool)
    sieve[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    symbols = which.reshape(-1) + 1
    names = sorted({i for i in ids if i is not None})
    place = {None: -1} | {x: k for k, x in enumerate(names)}
    found: dict[int, tuple[list, list]] = {}
    pairs = []
    for k, i in enumerate(ids):
        own = symbols[first[k] : first[k + 1]]
        if not len(own):
            continue
        pairs.append((own[:-1] << 32) | own[1:])
        size = min(width, len(own))
        rows = np.lib.stride_tricks.sliding_window_view(own, size)
        found.setdefault(size, ([], []))
        found[size][0].append(rows)
        found[size][1].append(np.full(len(rows), place[i]))
    out = Phrases(words, sieve, np.unique(np.concatenate(pairs)), names=names, key=key, spelling=(letters, begin))
    for size, (rows, items) in found.items():
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        links = np.unique(np.stack([which.reshape(-1), np.concatenate(items)]), axis=1)
        links = links[:, links[1] >= 0]
        out.by_length[size] = distinct
        out.items[size] = (np.searchsorted(links[0], np.arange(len(distinct) + 1)), links[1])
    return out


def search_shard(letters: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that are hit, and distinct (document, item) pairs, of one shard, whose words are the spans s to e of the bytes ``letters``.

    What the index locates is a hit where the bytes of all its words are the phrase's.

    Only stretches in which each word and each pair of neighbours stands in
    some phrase can hold one; the FM-index is built over those stretches.
    """
    n = len(s)
    none = np.zeros(0, np.int64)
    hit = np.zeros(n, bool)
    symbols = phrases.symbols(hash_spans(letters, s, e, phrases.key))
    spelling, spelt = phrases.spelling
    joined = np.zeros(n + 1, bool)  # word i continues the stretch of word i - 1
    left = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0)) if n else none
    if len(left) and len(phrases.pairs):
        pair = (symbols[left] << 32) | symbols[left + 1]
        at = np.minimum(np.searchsorted(phrases.pairs, pair), len(phrases.pairs) - 1)
        joined[left[phrases.pairs[at] == pair] + 1] = True
    joined[first[(first > 0) & (first < n)]] = False
    begin = np.flatnonzero((symbols > 0) & ~joined[:n])
    if not len(begin):
        return hit, none, none
    inside = (symbols > 0) & joined[:n]
    inside[begin] = True
    place = np.flatnonzero(inside)
    run = np.searchsorted(place, begin)
    size = np.diff(np.append(run, len(place)))
    keep = np.repeat(size >= min(phrases.by_length), size)
    place = place[keep]
    if not len(place):
        return hit, none, none
    cut = np.concatenate([[False], ~joined[place[1:]] | (place[1:] != place[:-1] + 1)])
    text = np.zeros(len(place) + int(cut.sum()), np.int64)
    origin = np.full(len(text), -1, np.int64)
    slots = np.arange(len(place)) + np.cumsum(cut)
    text[slots], origin[slots] = symbols[place] + 1, place
    text[text == 0] = 1  # between stretches, a symbol that no phrase has
    index = FMIndex(text)
    marks, docs, items = np.zeros(n + 1, np.int64), [none], [none]
    for length, rows in phrases.by_length.items():
        low, high = index.search(rows + 1)
        count = high - low
        which = np.repeat(np.arange(len(rows)), count)
        if not len(which):
            continue
        line = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))
        at = origin[index.locate(line)]
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        touched = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        word = symbols[touched] - 1
        wrong = np.zeros(n + 1, np.int64)
        wrong[touched + 1] = ~equal_spans(letters, s[touched], e[touched], spelling, spelt[word], spelt[word + 1])
        if wrong.any():
            wrong = np.cumsum(wrong)
            real = wrong[at + length] == wrong[at]
            at, which = at[real], which[real]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        seen = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, which]), axis=1)
        offsets, places = phrases.items[length]
        each = np.diff(offsets)[seen[1]]
        docs.append(np.repeat(seen[0], each))
        items.append(places[np.repeat(offsets[seen[1]] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
    both = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
    return np.cumsum(marks[:-1]) > 0, both[0], both[1]


def _search_batch(batch: pa.RecordBatch, text: str, phrases: Phrases):
    """Yields for each shard: first document, bytes, offsets, word spans, hits, (document, item) pairs."""
    buf, off = string_bytes(batch.column(text))
    for a, b in blocks(off, SHARD_BYTES):
        part, own = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        low = LOWER[part]
        s, e, first = word_spans(low, own, ALNUM)
        hit, docs, items = search_shard(low, s, e, first, phrases)
        yield a, part, own, s, e, first, hit, docs, items


def phrase_blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded bytes, one at a time in the driver; items without text say nothing."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    count = max(1, -(-size // PHRASE_BLOCK_BYTES))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).collect()
        if rows and (made := make_phrases([r.i for r in rows], [r.t for r in rows], width)):
            yield made


def _block_after_block(blocks: Iterator[Phrases], frame: DataFrame, step, name: str) -> DataFrame:
    """``step(frame, shared phrases, last)`` for each block; what all but the last make is written before the next block is gathered."""
    spark = frame.sparkSession
    now = next(blocks, None)
    while True:
        after = next(blocks, None) if now else None
        shared = spark.sparkContext.broadcast(now)
        frame = step(frame, shared, after is None)
        if after is None:
            return frame
        frame = written(frame, name)
        shared.destroy()
        now = after


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of each document that lie in a test phrase, and the items concerned.

    A phrase is ``width`` consecutive words of an item, or all words of a
    shorter one; words are runs of letters and digits, A-Z in lower case, and
    the same where their bytes are.  The benchmark is taken in
    blocks of bounded size, each one pass over the documents without a
    shuffle; at most two blocks are in the driver.  Each shard of documents is
    indexed and searched where it is read; a very long text is a shard of its
    own, which takes some 100 bytes for each of its words.

    A null or empty text has no words.  An item without an id hits as any
    other, but is neither counted nor named; one without text is ignored, and
    an id that occurs twice is one item.  An empty benchmark hits nothing, no
    documents give no rows, and other columns are ignored, whatever their
    names.  Repeated documents each keep their row.  Returns doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated, and spans: the merged
    byte ranges [start, end) to remove.
    """
    spans = "array<struct<start:int,end:int>>"
    got = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    kind = got.schema["doc_id"].dataType.simpleString()
    kept = f"doc_id {kind}, text string, hits array<int>, items array<string>"
    last = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {spans}"
    step = lambda frame, shared, final: map_batches(frame, lambda b: _step(b, shared.value, final), last if final else kept)
    return _block_after_block(phrase_blocks(benchmark, width, item_col, item_text), got, step, "decontamination")


def _step(batch: pa.RecordBatch, phrases: Phrases | None, final: bool) -> pa.RecordBatch:
    n = batch.num_rows
    before, named = batch.column("hits"), batch.column("items")
    hits, items, words, spans = [None] * n, [None] * n, np.zeros(n, np.int64), [[]] * n
    empty = Phrases(np.zeros(1, np.uint64), np.zeros(1 << 16, bool), np.zeros(0, np.int64), {1: np.zeros((0, 1), np.int64)}, {1: (np.zeros(1, np.int64), np.zeros(0, np.int64))})
    use = phrases or empty
    for a, part, own, s, e, first, hit, docs, places in _search_batch(batch, "text", use):
        words[a : a + len(first) - 1] = np.diff(first)
        for j in range(len(first) - 1):
            if before[a + j].is_valid:
                hit[first[j] + np.array(before[a + j].as_py(), np.int64)] = True
        by = {}
        for d, p in zip(docs.tolist(), places.tolist()):
            by.setdefault(d, set()).add(use.names[p])
        some = np.unique(np.searchsorted(first, np.flatnonzero(hit), "right") - 1)
        for j in some.tolist():
            own_hits = np.flatnonzero(hit[first[j] : first[j + 1]])
            hits[a + j] = own_hits.astype(np.int32)
            items[a + j] = sorted(by.get(j, set()) | set(named[a + j].as_py() or ()))
            edge = np.flatnonzero(np.diff(own_hits) != 1)
            starts, ends = own_hits[np.concatenate([[0], edge + 1])], own_hits[np.concatenate([edge, [len(own_hits) - 1]])]
            spans[a + j] = [{"start": int(x), "end": int(y)} for x, y in zip(s[first[j] + starts] - own[j], e[first[j] + ends] - own[j])]
    if not final:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "hits", "items"])
    count = np.array([0 if x is None else len(x) for x in hits], np.int64)
    digests = [hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in items]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrays = [batch.column("doc_id"), pa.array(words), pa.array(count), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(count > 0), pa.array(spans, kind)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def _cut_batch(batch: pa.RecordBatch, text_col: str, phrases: Phrases, changed: str | None) -> pa.RecordBatch:
    """The batch without its hit spans; ``changed`` names a column that is set where a text was cut."""
    column = batch.schema.get_field_index(text_col)
    texts = batch.column(column)
    todo = np.arange(batch.num_rows)
    new: dict[int, bytes] = {}
    while len(todo):
        now = pa.array([new.get(i) for i in todo.tolist()], pa.binary()).cast(pa.string()) if new else texts
        cut: dict[int, tuple[bytes, list]] = {}
        for a, part, own, s, e, first, hit, _, _ in _search_batch(pa.RecordBatch.from_arrays([now], ["text"]), "text", phrases):
            at = np.flatnonzero(hit)
            doc = np.searchsorted(first, at, "right") - 1
            for j in np.unique(doc).tolist():
                words = at[doc == j]
                edge = np.flatnonzero(np.diff(words) != 1)
                starts, ends = s[words[np.concatenate([[0], edge + 1])]], e[words[np.concatenate([edge, [len(words) - 1]])]]
                cut[a + j] = bytes(part[own[j] : own[j + 1]]), list(zip((starts - own[j]).tolist(), (ends - own[j]).tolist()))
        found = {}
        for j, (raw, spans) in cut.items():
            out, end = [], 0
            for x, y in spans:
                out.append(raw[end:x])
                end = y
            found[int(todo[j])] = b"".join([*out, raw[end:]])
        new |= found
        todo = np.array(sorted(found), np.int64)
    if not new:
        return batch
    values = texts.to_pylist()
    for i, raw in new.items():
        values[i] = raw.decode("utf-8")
    batch = batch.set_column(column, batch.schema.field(column), pa.array(values, texts.type))
    if changed:
        at = batch.schema.get_field_index(changed)
        flags = batch.column(at).to_numpy(zero_copy_only=False).copy()
        flags[list(new)] = True
        batch = batch.set_column(at, batch.schema.field(at), pa.array(flags))
    return batch


def remove_contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` with the hit spans cut out of the texts; every row and column stays.

    The cut is repeated while it brings words together that form a phrase
    anew, of any block of the benchmark.  A null text stays null, a text that
    is all phrases becomes the rest between them, repeated rows are cut alike,
    and an empty table or benchmark changes nothing.  Other columns stay as
    they are, whatever their names.
    """
    blocks_of = lambda: phrase_blocks(benchmark, width, item_col, item_text)
    first = blocks_of()
    one, two = next(first, None), next(first, None)
    if one is None:
        return documents
    if two is None:
        shared = documents.sparkSession.sparkContext.broadcast(one)
        return map_batches(documents, lambda b: _cut_batch(b, text_col, shared.value, None), documents.schema)
    del one, two, first
    changed = free_name(documents, "cut_again")
    again = True
    while again:
        flagged = documents.withColumn(changed, F.lit(False))
        step = lambda frame, shared, _: map_batches(frame, lambda b: _cut_batch(b, text_col, shared.value, changed), frame.schema)
        cut = written(_block_after_block(blocks_of(), flagged, step, "decontamination"), "decontamination")
        again = not cut.where(F.col(changed)).isEmpty()
        documents = cut.drop(changed)
    return documents
