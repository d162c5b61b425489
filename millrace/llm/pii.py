"""Personal data: base patterns, and terms that reveal protected values by co-occurrence.

A protected value is one matched e-mail address, IP address, card or phone
number.  The corpus tells how strongly a term reveals a value: with p the
share of documents, pmi(t, v) = log(p(t, v) / (p(t) p(v))) compared with the
information log(1 / p(v)) of the value itself.  A ratio of 1 means that the
term gives the value away.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Bits, bitmap, map_batches, written
from .textnp import ALNUM, LOWER, blocks, byte_table, hash_spans, string_bytes, word_spans

KINDS = ("email", "ip", "card", "phone", "term")
SLOT_BITS = 22
#: Disclosing terms in one block; each further block is a pass of its own.
TERM_BLOCK = 100_000

#: Pairs of values and terms that a task holds at once, but for one document's more.
PAIR_ROWS = 100_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNS = byte_table(b"@0123456789")
_LETTERS = ALNUM & ~byte_table(b"0123456789")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches in code points, sorted; kind is a place in KINDS.

    Each search is linear in the text.
    """
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", at + 1)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def _value(kind: int, found: str) -> int:
    """A digest that names the protected value without showing it."""
    plain = found.lower() if kind == 0 else found if kind == 1 else re.sub("[^0-9]", "", found)
    return int.from_bytes(hashlib.sha256(f"{KINDS[kind]}:{plain}".encode()).digest()[:8], "big", signed=True)


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, off = string_bytes(column)
    for a, b in blocks(off):
        yield a, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def _signed(part: np.ndarray, own: np.ndarray) -> list[int]:
    """Documents with a sign of a base match: only those are searched."""
    seen = np.flatnonzero(_SIGNS[part])
    return np.unique(np.searchsorted(own, seen, "right") - 1).tolist()


def _terms(low: np.ndarray, own: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents and slots of the terms: words of ``least`` bytes or more, with a letter first."""
    s, e, first = word_spans(low, own, ALNUM)
    keep = (e - s >= least) & _LETTERS[low[s]] if len(s) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(own) - 1), np.diff(first))[keep]
    s, e = s[keep], e[keep]
    return s, e, doc, (hash_spans(low, s, e) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _spots(part: np.ndarray, own: np.ndarray, j: int) -> list[tuple[int, int, int]]:
    """(start, end, value) in bytes of the base matches of document ``j``, sorted."""
    raw = bytes(part[own[j] : own[j + 1]])
    text = raw.decode("utf-8", "replace")
    ascii_only = len(raw) == len(text)
    place = lambda x: x if ascii_only else len(text[:x].encode("utf-8", "replace"))
    return [(place(x), place(y), _value(k, text[x:y])) for x, k, y in base_spans(text)]


def _free(spots: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which terms of a document lie outside its base matches."""
    free = np.ones(len(starts), bool)
    for x, y, _ in spots:
        free[np.searchsorted(ends, x, "right") : np.searchsorted(starts, y)] = False
    return free


def _holders(batch: pa.RecordBatch, width: int) -> Iterator[tuple[dict[int, int], dict[str, int]]]:
    """For each document with base matches: its values with marks of their contexts, and its distinct terms outside the matches with slots.

    A context is the ``width`` terms on either side of a value's first match.
    """
    for _, part, own in _parts(batch.column("text")):
        signed = _signed(part, own)
        if not signed:
            continue
        low = LOWER[part]
        s, e, doc, slot = _terms(low, own)
        for j in signed:
            spots = _spots(part, own, j)
            if not spots:
                continue
            of = slice(*np.searchsorted(doc, [j, j + 1]))
            ds, de = s[of] - own[j], e[of] - own[j]
            free = _free(spots, ds, de)
            ds, de, dslot = ds[free], de[free], slot[of][free]
            words = [low[own[j] + x : own[j] + y].tobytes().decode("utf-8", "replace") for x, y in zip(ds.tolist(), de.tolist())]
            marks: dict[int, int] = {}
            for x, _, value in spots:
                if value not in marks:
                    k = int(np.searchsorted(ds, x))
                    marks[value] = zlib.crc32(" ".join(words[max(0, k - width) : k + width]).encode())
            yield marks, dict(zip(words, dslot.tolist()))


def _values(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    count = Counter(pair for marks, _ in _holders(batch, width) for pair in marks.items())
    return pa.RecordBatch.from_arrays([pa.array([v for v, _ in count], pa.int64()), pa.array([m for _, m in count], pa.int64()), pa.array(list(count.values()), pa.int64())], ["value", "mark", "n"])


def _pairs(batch: pa.RecordBatch, width: int, wanted: Bits) -> Iterator[pa.RecordBatch]:
    """Documents for each (value, term, context) of the values whose slots are wanted, a bounded number of rows at once."""
    names, kinds = ("value", "term", "mark", "slot", "n"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    count: Counter[tuple[int, str, int, int]] = Counter()

    def made() -> pa.RecordBatch:
        rows = [(*pair, n) for pair, n in count.items()]
        count.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    for marks, words in _holders(batch, width):
        for value, mark in marks.items():
            if wanted[np.array([value % (1 << SLOT_BITS)])][0]:
                count.update((value, w, mark, k) for w, k in words.items())
                if len(count) >= PAIR_ROWS:
                    yield made()
    yield made()


def _term_counts(batch: pa.RecordBatch, wanted: Bits) -> pa.RecordBatch:
    count: Counter[bytes] = Counter()
    for _, part, own in _parts(batch.column("text")):
        low = LOWER[part]
        s, e, doc, slot = _terms(low, own)
        near = wanted[slot]
        for j in _signed(part, own):
            of = slice(*np.searchsorted(doc, [j, j + 1]))
            if near[of].any() and (spots := _spots(part, own, j)):
                near[of] &= _free(spots, s[of] - own[j], e[of] - own[j])
        near = np.flatnonzero(near)
        count.update(w for _, w in {(d, low[x:y].tobytes()) for d, x, y in zip(doc[near].tolist(), s[near].tolist(), e[near].tolist())})
    return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])


def disclosing_terms(documents: DataFrame, text_col: str = "text", generalise: float = 0.75, remove: float = 0.9, min_contexts: int = 3, width: int = 5) -> DataFrame:
    """Terms that reveal a protected value too strongly, and whether to remove them.

    All counts are by document over all documents: of a value, of a term
    outside matched values, and of both in one document, however far apart.
    A pair needs ``min_contexts`` different contexts of the value, the
    ``width`` terms on either side of it, so copies of one text prove nothing.
    Returns term, slot, drop (true: remove, false: generalise).
    """
    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    found = map_batches(texts, lambda b: _values(b, width), "value long, mark long, n long")
    # one row for each (value, context), then for each value: both combine before the shuffle
    values = found.groupBy("value", "mark").agg(F.sum("n").alias("n")).groupBy("value").agg(F.sum("n").alias("of_value"), F.count(F.lit(1)).alias("contexts"))
    values = written(values.where(F.col("contexts") >= min_contexts).select("value", "of_value"), "pii-values")  # no other can have a pair in so many
    context = documents.sparkSession.sparkContext
    held = context.broadcast(bitmap(values.select(F.pmod("value", F.lit(1 << SLOT_BITS)).alias("slot")).distinct(), "slot", SLOT_BITS))
    if not held.value.any():
        return values.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("slot"), F.lit(True).alias("drop")).where(F.lit(False))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _pairs(batch, width, held.value)
        pa.default_memory_pool().release_unused()

    seen = texts.mapInArrow(each, "value long, term string, mark long, slot long, n long")
    both = seen.groupBy("value", "term", "slot", "mark").agg(F.sum("n").alias("n")).groupBy("value", "term", "slot").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts"))
    strong = written(both.where(F.col("contexts") >= min_contexts), "pii-pairs")
    wanted = context.broadcast(bitmap(strong.select("slot").distinct(), "slot", SLOT_BITS))
    if not wanted.value.any():
        return strong.select("term", "slot", F.lit(True).alias("drop"))
    counts = map_batches(texts, lambda b: _term_counts(b, wanted.value), "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term"))
    total = F.lit(documents.count()).cast("double")
    pmi = F.log(total * F.col("both") / (F.col("of_term") * F.col("of_value")))
    ratio = F.when(F.col("of_value") < total, pmi / F.log(total / F.col("of_value"))).otherwise(0.0)
    scored = strong.join(values, "value").join(counts, "term").withColumn("ratio", ratio)
    found = scored.groupBy("term", "slot").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= generalise).select("term", "slot", (F.col("ratio") >= remove).alias("drop"))
    return written(found, "pii-terms")  # read once for each block of terms


def _term_blocks(terms: DataFrame, block: int) -> list[dict[bytes, bool]]:
    """The terms in blocks of bounded size."""
    count = max(1, -(-terms.count() // block))
    return [{r.term.encode(): r["drop"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(count)) == k).collect()} for k in range(count)]


def _find_terms(column: pa.Array, terms: dict[bytes, bool], slots: np.ndarray) -> dict[int, list[tuple[int, int, bool]]]:
    """Byte spans of the terms by row."""
    out: dict[int, list] = {}
    for a, part, own in _parts(column):
        low = LOWER[part]
        s, e, doc, slot = _terms(low, own)
        for i in np.flatnonzero(slots[slot]).tolist():
            drop = terms.get(low[s[i] : e[i]].tobytes())
            if drop is not None:
                out.setdefault(a + int(doc[i]), []).append((int(s[i] - own[doc[i]]), int(e[i] - own[doc[i]]), drop))
    return out


def _spans(column: pa.Array, carried: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, int, bool]]]]:
    """Rows with spans: place, text, sorted (start, kind, end, drop) in code points."""
    marked: dict[int, list] = {i: [] for a, part, own in _parts(column) for i in (a + j for j in _signed(part, own))}
    for i in np.flatnonzero(carried.is_valid().to_numpy(zero_copy_only=False)).tolist():
        marked.setdefault(i, []).extend((x["start"], x["end"], x["drop"]) for x in carried[i].as_py())
    for i, terms in sorted(marked.items()):
        text = column[i].as_py() or ""
        spans = [(x, k, y, True) for x, k, y in base_spans(text)]
        if terms:
            raw = text.encode()
            place = (lambda x: x) if len(raw) == len(text) else (lambda x: len(raw[:x].decode("utf-8", "replace")))  # noqa: B023
            spans += [(place(x), 4, place(y), drop) for x, y, drop in terms]
        if spans:
            yield i, text, sorted(spans)


def _with_terms(frame: DataFrame, text: str, carry: str, terms: DataFrame) -> DataFrame:
    """``frame`` with the spans of the terms in column ``carry``, block after block, without a shuffle."""
    kind = "array<struct<start:int,end:int,drop:boolean>>"
    out = frame.withColumn(carry, F.lit(None).cast(kind))
    for block in _term_blocks(terms, TERM_BLOCK):
        if not block:
            continue
        words = [np.frombuffer(w, np.uint8) for w in block]
        buf, ends = np.concatenate(words), np.cumsum([len(w) for w in words])
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[(hash_spans(buf, ends - [len(w) for w in words], ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
        shared = frame.sparkSession.sparkContext.broadcast((block, slots))

        def step(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = _find_terms(batch.column(text), *shared.value)
            at = batch.schema.get_field_index(carry)
            old = batch.column(carry).to_pylist()
            for i, spans in found.items():
                old[i] = (old[i] or []) + [{"start": x, "end": y, "drop": z} for x, y, z in spans]
            return batch.set_column(at, batch.schema.field(carry), pa.array(old, batch.schema.field(carry).type))

        out = map_batches(out, step, out.schema)
    return out


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Spans of personal data in each document, base patterns first, terms by disclosure added.

    A null or empty text has no spans; a very long one is searched whole, in
    time linear in its length; repeated rows each keep theirs and count each
    as a document; spans that start together stand in the order of KINDS; an
    empty table gives none; other columns are ignored, whatever their names.
    Returns doc_id,
    n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.
    """
    frame = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    carried = _with_terms(frame, "text", "carry", disclosing_terms(documents, text_col, **options))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        counts = np.zeros((5, n), np.int64)
        digest, line = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        for i, _, spans in _spans(batch.column("text"), batch.column("carry")):
            for _, k, _, _ in spans:
                counts[k, i] += 1
            said = [(k, f"{KINDS[k]}:{x}:{y}") for x, k, y, _ in spans]
            digest[i] = hashlib.sha256(",".join(w for k, w in said if k < 4).encode()).hexdigest()
            line[i] = ",".join(w for _, w in said)
        arrays = [batch.column("doc_id"), *map(pa.array, counts[:4]), pa.array(digest, pa.string()), pa.array(line, pa.string()), pa.array(counts[4])]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])

    return map_batches(carried, step, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def remove_pii(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``documents`` with base matches and disclosing terms replaced in the texts.

    A base match becomes its kind in angle brackets, a term is removed or
    becomes ``<TERM>``; overlapping spans are replaced together, by the first.
    Every row and column stays; a text without spans is left as it is, null
    and empty too.  Very long texts are rewritten whole, repeated rows alike,
    an empty table stays empty, and no column's name can clash.
    """
    carry = "_pii_carry"
    while carry in documents.columns:
        carry += "_"
    carried = _with_terms(documents, text_col, carry, disclosing_terms(documents, text_col, **options))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        column, new = batch.column(at), {}
        for i, text, spans in _spans(column, batch.column(carry)):
            out, end, label = [], 0, None
            for x, k, y, drop in spans:
                if x >= end:
                    out.append(text[end:x])
                    label = "" if k == 4 and drop else f"<{KINDS[k].upper()}>"
                    out.append(label)
                end = max(end, y)
            new[i] = "".join([*out, text[end:]])
        if new:
            values = column.to_pylist()
            for i, text in new.items():
                values[i] = text
            batch = batch.set_column(at, batch.schema.field(at), pa.array(values, column.type))
        return batch.drop_columns([carry])

    return map_batches(carried, step, documents.schema)
